"""The operators against plain Python on small tables with nulls, empty, long and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import dedup, knn, langid, licenses, mixing, packing, pii, quality, suffix, toxicity

SCHEMA = "doc_id long, text string, source string, kept string, n_words string, rid string, id string"


def table(spark, texts):
    """Extra columns have the names of results."""
    return spark.createDataFrame([(i, t, "s" if i is not None and i % 3 else None, "x", "y", "z", "q") for i, t in texts], SCHEMA)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = prose(6000, 1)
EDGE = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (4, "one"), (None, "two words here"), (5, LONG), (6, LONG)]


def test_quality(spark):
    texts = EDGE + [(7, "a b c " * 40), (8, "x y\nx y\n###\n\nx y"), (9, prose(80, 5))]
    got = collections.defaultdict(list)
    for r in quality.apply_policy(quality.ledger(table(spark, texts))).collect():
        got[r.doc_id].append(r)
    for i, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(g)
        rep = len({p for k, x in enumerate(g) if n[x] > 1 for p in (k, k + 1, k + 2)})
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), rep)
    assert len(got[4]) == 2 and got[9][0].kept and not got[7][0].kept
    assert {c for c in quality.documents_kept(table(spark, texts)).columns} == set(table(spark, []).columns)
    ab = {r.rule: r for r in quality.ablation(quality.ledger(table(spark, texts))).collect()}
    assert ab["few_words"].n_failed == 7  # 1, 2, 3, 4 twice, the null id, 8


def test_licenses(spark):
    texts = EDGE + [(7, "Under the MIT License; under the mit license"), (8, "CC BY-NC: cc by nc"), (9, "under the mIt license K İ"),
                    (10, "This program is free software; you may redistribute it and/or modify it under the terms of the GNU General Public License")]
    rows = licenses.scan(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: r for r in rows}
    assert [p.first for p in got[7].places] == [0, 4] and got[7].base_labels == ["mit"]
    assert [p.first for p in got[8].places] == [0, 3]
    assert got[9].base_labels == ["mit"] and got[9].n_words == 6
    assert got[10].base_labels == [] and got[10].labels == ["gpl-3"] and 0 < got[10].score <= 1
    assert got[1].n_words == 0 and got[1].score == 0
    assert licenses.scan(table(spark, [])).count() == 0


def test_pii(spark):
    texts = EDGE + [(7, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 300.1.1.1 x 4111 1111 1111 1111 +1 (555) 010-9999"), (8, "1" * 5000 + " " + "a." * 3000 + "@x.y"), (9, "call 555-123-4567")]
    rows = pii.find(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.base] for r in rows}
    assert got[7] == [("email", 0, 5), ("email", 5, 11), ("ip", 12, 19), ("ip", 20, 27), ("card", 40, 59), ("phone", 60, 77)]
    assert got[8] == [("email", 5001, 5001 + 6004)]
    assert got[1] == got[2] == []
    masked = {r.doc_id: r for r in pii.mask(table(spark, texts)).collect()}
    assert "4111" not in masked[7].text and masked[1].text is None and masked[5].text == LONG
    assert pii.find(table(spark, [])).count() == 0


def test_pii_only_candidate(spark):
    """A text passes the cheap search whichever kind its only candidate is of, in every form."""
    alone = [("email", "a@b.c"), ("ip", "10.2.3.4"), ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("phone", "+1 555 010 9999"), ("secret", "0a" * 16)]
    alone += [("account", "DE89 3704 0044 0532 0130 00"), ("account", "GB29NWBK60161331926819"), ("name", "Dr. Anna Bell"), ("name", "Herr Weber"), ("address", "12 Long Hill Road")]
    alone += [("local_phone", f"{a}555{b}{x}123{y}4567") for a in ("", "(") for b in ("", ")") for x in " .-" for y in ".-"]
    texts = [(i, f"call {m} now") for i, (_, m) in enumerate(alone)]
    got = {r.doc_id: {(x.kind, x.s, x.e) for x in r.spans} for r in pii.candidates(table(spark, texts)).collect()}
    for i, (kind, m) in enumerate(alone):
        found = regex.search(re.sub("\\\\G[|]", "", pii.PATTERNS[kind]), texts[i][1])
        assert got[i] == ({(kind, found.start(), found.end())} if found else set()), m
    assert got[len(alone) - 1] == {("local_phone", 5, 19)}
    assert pii.mask(table(spark, [(1, "call (555) 123-4567 now")])).first().text == "call [LOCAL_PHONE] now"


def brute_base(text):
    """The contract's base spans, by Python's own engine."""
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
    rules = {
        "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": ("[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": ("[0-9]([\\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(rules.items()) for m in re.finditer(p, text) if ok(m.group())]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def test_pii_base_against_brute_force(spark):
    """Texts of the pieces that the patterns are made of, and a real table, whole; the digest as well."""
    r = random.Random(12)
    pieces = ["@", ".", "a", "B7", "1", "23", "255", "256", "4111 1111 1111 1111", "-", " ", "+", "+1 (", ")", "ü", "\U0001f600", "x@y.z", "\n", "1.2.3.4", "0012"]
    texts = [(i, "".join(r.choice(pieces) for _ in range(r.randint(1, 40)))) for i in range(400)]
    texts += [(1000 + x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for x in pii.find(table(spark, texts)).select("doc_id", "base", pii.digest(F.col("base")).alias("d")).collect():
        want = brute_base(dict(texts)[x.doc_id])
        assert [(y.kind, y.s, y.e) for y in x.base] == want and x.d == ",".join(f"{k}:{a}:{b}" for k, a, b in want)


def test_pii_many_spans(spark):
    text = " ".join(f"u{i}@h.org" for i in range(1000))
    got = pii.find(table(spark, [(1, text)])).first().base
    assert [(y.s, y.e) for y in got] == [m.span() for m in re.finditer("[^ ]+", text)]


def test_pii_labelers_are_weighed():
    """Labelers that agree on a hidden truth are told from one that votes by chance."""
    r = random.Random(4)
    counts = collections.Counter()
    for _ in range(4000):
        truth = r.random() < 0.4
        votes = [int(truth) if r.random() < a else 1 - int(truth) for a in (0.95, 0.9, 0.5, 0.85)]
        counts[("secret", *votes, -1, 3)] += 1
    prob = pii.estimate(sorted((*k, n) for k, n in counts.items()))
    for (_, a, b, c, d, _, _), p in prob.items():
        if a == b == d:
            assert (p > 0.8) == bool(a) and (p < 0.2) == (not a), (a, b, c, d, p)


def test_pii_loose_spans(spark):
    """What labelers agree on is kept, what touches other text and has no context is not."""
    good = [(i, f"the bearer token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" was sent, write to a{i}@b.org") for i in range(30)]
    bad = [(100 + i, f"lib/{'0' * 33}{i % 10}/x") for i in range(30)]
    got = {x.doc_id: {y.kind for y in x.spans} for x in pii.find(table(spark, good + bad)).collect()}
    assert all("secret" in got[i] for i, _ in good) and not any("secret" in got[i] for i, _ in bad)
    inside = pii.find(table(spark, [(1, "call +1 (555) 123-4567 now")])).first()
    assert [y.kind for y in inside.spans] == ["phone"]


@pytest.mark.parametrize("run", [lambda d: pii.find(d), lambda d: quality.ledger(d), lambda d: licenses.scan(d), lambda d: suffix.remove(d), lambda d: dedup.link(d)])
def test_null_ids(spark, run):
    assert run(table(spark, [(None, None), (None, "some words here"), (None, "some words here"), (1, None)])).count() == 4


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return sets, comp


def test_near_duplicates(spark):
    r = random.Random(11)
    texts = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "two words")]
    for g in range(4):
        base = prose(120, 100 + g).split()
        for c in range(7):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = "zz%d" % r.randrange(99)
            texts.append((10 + 10 * g + c, " ".join(w)))
    sets, comp = brute_components(texts, 3, 85)
    rows = dedup.link(table(spark, [*texts, (None, "one")]), dedup.Near(3, 85)).collect()
    for x in rows:
        if x.doc_id is not None:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), comp[x.doc_id], comp[x.doc_id] == x.doc_id)
    assert len(rows) == len(texts) + 1
    assert dedup.link(table(spark, [])).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_rest_of_buckets(spark, monkeypatch, block):
    """What the leaders leave is compared in families, large ones block against block."""
    monkeypatch.setattr(dedup, "FAMILY", block)
    rows = []
    for g in (0, 1):
        base = prose(200, 9 + g).split()
        for i in range(12):
            w = list(base)
            for j in range(1 + i // 3):
                w[i * 15 + 3 * j] = f"q{i}"
            s = dedup.Shingler(3).set(" ".join(w))
            rows.append((100 * g + i, len(s), bytearray(s.tobytes())))
    sets = spark.createDataFrame(rows, "id long, n long, set binary")
    opened = spark.createDataFrame([(k + i // 100, i, i // 4) for i, _, _ in rows for k in (1, 3)], "key long, id long, comp long")
    got = {tuple(sorted(r)) for r in dedup._rest(opened, sets, dedup.Near(3, 90)).collect()}
    held = {i: set(np.frombuffer(s, np.uint64).tolist()) for i, _, s in rows}
    near = {(a // 4, b // 4) for a in held for b in held if a // 4 < b // 4 and 100 * len(held[a] & held[b]) >= 90 * len(held[a] | held[b])}
    assert got == near and 0 < len(near) < 6


@pytest.mark.parametrize(("sparse", "edits"), [(4, (8, 30)), (0, (8, 30)), (4, (0, 9))])
def test_large_family_is_narrowed(spark, monkeypatch, sparse, edits):
    """A family beyond FAMILY is compared by pairs that are far fewer than all, and no link is lost: copies of
    two texts, copies of those copies, and texts made of halves of both that hold the family together."""
    monkeypatch.setattr(dedup, "FAMILY", 32)
    monkeypatch.setattr(dedup, "SPARSE", sparse)
    r = random.Random(31)
    bases = [prose(240, 71).split(), prose(240, 72).split()]
    bases += [bases[0][:120] + bases[1][:120], bases[1][120:] + bases[0][120:]]
    texts = []
    for base, copies in zip(bases, (120, 60, 12, 12), strict=True):
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(*edits)):
                w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
            texts.append(w)
            if r.random() < 0.2:  # a copy of the copy, near the threshold
                w = list(w)
                for _ in range(r.randint(1, 7)):
                    w[r.randrange(len(w))] = "c%d" % r.randrange(10**6)
                texts.append(w[: r.randint(225, 240)])
    sets = {i: frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) for i, w in enumerate(texts)}
    links = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(links) > 20

    def groups(edges):
        comp = {i: i for i in sets}
        while moved := [(a, b) for a, b in edges if comp[a] != comp[b]]:
            for a, b in moved:
                comp[a] = comp[b] = min(comp[a], comp[b])
        return comp

    how = dedup.Near(3, 85)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    each = spark.createDataFrame([(1, i, i) for i in sets], "key long, id long, comp long")
    held = dedup.written(dedup.full_sets(table(spark, rows), each.select("id"), how, "doc_id", "text"), "held")
    opened = dedup._open(dedup._prefixes(each, held, how))
    assert groups([tuple(x) for x in dedup._rest(opened, held, how).collect()]) == groups(links)
    if sparse and edits[0]:
        some = held.select(F.lit(0).cast("long").alias("family"), "id", F.col("id").alias("comp"), "n", "set")
        most = spark.createDataFrame([(0, len(rows) ** 2)], "family long, most long")
        sure, pairs, crowded = dedup._narrowed(opened, some, most, how)
        assert crowded.isEmpty() and 0 < pairs.count() < len(rows) ** 2 / 20
        asked = {(x.a, x.b) for x in pairs.collect()}
        comp = groups([tuple(x) for x in sure.collect()])
        assert all((b, a) in asked or comp[a] == comp[b] for a, b in links)


def test_large_group(spark):
    """2,000 near copies of one text, some of them at the edge of the threshold, against brute force."""
    r = random.Random(17)
    base = prose(60, 70).split()
    texts = []
    for i in range(2000):
        w = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 2, 3))):
            w[r.randrange(len(w))] = "new%d" % r.randrange(9)
        texts.append((i, " ".join(w)))
    grams = [frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) for w in (t.split() for _, t in texts)]
    number = {g: k for k, g in enumerate({g for s in grams for g in s})}
    m = np.zeros((len(texts), len(number)), np.float32)
    for i, s in enumerate(grams):
        m[i, [number[g] for g in s]] = 1
    both = m @ m.T
    n = m.sum(1)
    near = 100 * both >= 85 * (n[:, None] + n[None, :] - both)
    comp = np.arange(len(texts))
    while True:
        least = np.where(near, comp[None, :], len(texts)).min(1)
        if (least == comp).all():
            break
        comp = least
    got = {x.doc_id: x.component_id for x in dedup.link(table(spark, texts), dedup.Near(3, 85)).collect()}
    assert got == dict(enumerate(comp.tolist())) and len(set(comp)) > 1


def test_prefixes_hold_every_link(spark):
    """Any two linked sets of different components share a live shingle of their prefixes."""
    r = random.Random(23)
    texts = []
    for g in range(6):
        base = prose(70, 400 + g).split()
        for _ in range(20):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = "v%d" % r.randrange(5)
            texts.append((len(texts), " ".join(w)))
    sets, _ = brute_components(texts[:0], 3, 85)
    sets = {i: frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) for i, w in ((i, t.split()) for i, t in texts)}
    opened = spark.createDataFrame([(1, i, i) for i, _ in texts], "key long, id long, comp long")
    held = dedup.full_sets(table(spark, texts), opened.select("id"), dedup.Near(3, 85), "doc_id", "text")
    keys = collections.defaultdict(set)
    for x in dedup._prefixes(opened, held, dedup.Near(3, 85)).collect():
        keys[x.id].add(x.key)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert links and all(keys[a] & keys[b] for a, b in links)


def test_sketch_estimates():
    for share in (0.3, 0.6, 0.9):
        r = np.random.default_rng(5)
        x = r.integers(0, 1 << 63, 3000).astype(np.uint64)
        n = int(3000 * 2 * share / (1 + share))
        a, b = x[:3000], np.concatenate([x[:n], r.integers(0, 1 << 63, 3000 - n).astype(np.uint64)])
        est = dedup.similarity(3000, dedup.registers(a), np.array([3000]), dedup.registers(b)[None, :])[0]
        assert abs(est - share) < 0.13
        for j in (est - 0.02, est + 0.02):
            assert dedup.reaches(3000, dedup.registers(a), np.array([3000]), dedup.registers(b)[None, :], j)[0] == (j < est)


def brute_repeats(texts):
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = collections.Counter(b[p : p + 200] for _, b in data for p in range(len(b) - 199))
    want = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        want.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()) if b else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(want, key=repr)


def removed(spark, texts):
    return sorted((tuple(r) for r in suffix.remove(table(spark, texts)).drop("kept").collect()), key=repr)


def test_repeated_bytes(spark):
    texts = EDGE + [(7, "a" * 250), (8, "b" * 199), (9, "xy" * 150), (10, "Q" + LONG[300:900] + "é" + LONG[5000:5150]), (11, LONG[700:1200] + LONG[100:320])]
    assert removed(spark, texts) == brute_repeats(texts)
    assert suffix.remove(table(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [3, 20_000])
def test_repeated_passages(spark, monkeypatch, hot):
    """A passage with other bytes on both sides in each text; below ``hot`` phrases of a trigger are compared
    in order, beyond it by digests."""
    monkeypatch.setattr(suffix, "HOT", hot)
    r = random.Random(5)
    passage = prose(120, 800)
    texts = []
    for i in range(12):
        a, n = r.randrange(100), r.choice((150, 199, 200, 201, 330))
        texts.append((i, prose(30, 900 + i) + passage[a : a + n] + prose(30, 950 + i)))
    assert removed(spark, texts) == brute_repeats(texts)


def test_identical_rows_repeat_each_other(spark):
    texts = [(1, prose(80, 60))] * 200 + [(None, prose(80, 61))] * 2 + [(2, prose(80, 62))]
    got = removed(spark, texts)
    assert got == brute_repeats(texts) and len(got) == 203


def test_windows_are_compared_by_bytes():
    """Phrases whose triggers have one hash by chance: the bytes tell them apart."""
    r = np.random.default_rng(8)
    base = r.integers(97, 99, 360).astype(np.uint8).tobytes()
    data, off, cnt = [], [], []
    for _ in range(40):
        x = bytearray(base)
        for _ in range(r.integers(0, 3)):
            x[r.integers(0, 360)] = 122
        a, c = int(r.integers(0, 60)), int(r.integers(1, 100))
        data.append(bytes(x[a : a + c + 199]))
        off.append(160 - a)
        cnt.append(c)
    off, cnt = np.array(off), np.array(cnt)
    keys = np.array([7, 8] * 20)
    found = suffix.compare(keys, cnt, off, data)
    seen = collections.Counter((k, d[j : j + 200], o - j) for k, d, o, c in zip(keys, data, off, cnt) for j in range(c))
    for i, (k, d, o, c) in enumerate(zip(keys, data, off, cnt)):
        want = {o - j for j in range(c) if 0 <= o - j <= 160 and seen[k, d[j : j + 200], o - j] > 1}
        assert set(np.flatnonzero(found[i])) == want


def test_packing(spark):
    texts = EDGE + [(i, prose(i * 7, i)) for i in range(20, 60)]
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(table(spark, texts).coalesce(1), packing.Packing(path, open_windows=4)).collect()
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, t in texts:
        copies = sum(1 for j, _ in texts if j == i)
        assert sum(r.length for r in by[i]) == copies * len(ids[i])
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(table(spark, []), packing.Packing(path)).count() == 0


def test_words_are_tokenized_as_texts():
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), 1000)
    for t in ("Ég'd it's <|endoftext|> İx ΣΑΣ. don't!?", "a1b2 日本語 ﬁ ẞ é́ a\x85b\xa0c x\x1cy", "(foo) ...x Ünïcödé, naïve; RÉSUMÉ.", ""):
        assert words.text(t) == words.encode(t)


def test_language(spark):
    en = "the of and to in is that it was for on are with as his they be at one have this from"
    fr = "le de un être et à il avoir ne je son que se qui ce dans en du elle au"
    r = random.Random(2)
    make = lambda v, n: " ".join(r.choice(v.split()) for _ in range(n))
    model = langid.fit([(make(en, 60), "en") for _ in range(20)] + [(make(fr, 60), "fr") for _ in range(20)])
    texts = [(1, None), (2, "12 ?!"), (3, make(en, 40)), (4, make(fr, 40)), (5, make(en, 50) + " " + make(fr, 30)), (5, "")]
    got = {r.doc_id: r for r in langid.predict(table(spark, texts), model, spans=True).filter("spans IS NOT NULL").collect() if r.spans or r.doc_id in (1, 2)}
    assert got[1].lang_pred == got[2].lang_pred == "und"
    assert (got[3].lang_pred, got[4].lang_pred, got[5].lang_pred) == ("en", "fr", "en")
    assert [s.lang for s in got[5].spans] == ["en", "fr"] and abs(got[5].spans[1].first - 50) <= 3


def test_letters_decide_und(spark):
    model = langid.fit([("the and of ½", "en"), ("le de un", "fr")])
    texts = [(1, "½ ² Ⅷ"), (2, "½the"), (None, "le"), (3, "Ⅷ 12 _ ³x")]
    got = {r.doc_id: r.lang_pred for r in langid.predict(table(spark, texts), model).collect()}
    assert got[1] == "und" and got[2] == "en" and got[None] == "fr" and got[3] in ("en", "fr")


def test_language_against_all_paths():
    """The label of a text by trying every labelling of its words."""
    import itertools

    model = langid.fit([("the and of to in that", "en"), ("le de un et la que", "fr"), ("der die das und ist", "de")])
    model.penalty = 3.0
    r = random.Random(8)
    for _ in range(25):
        words = r.choices("the and of le de un der das und xq ab".split(), k=6)
        s = langid.word_scores(model, words)
        best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(s[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:])))
        (got, scores, path), = langid.Labeler(model).batch([" ".join(words)])
        total = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert total(path) == pytest.approx(total(best), abs=1e-4)
        letters = collections.Counter()
        for w, k in zip(words, path):
            letters[model.langs[k]] += len(w)
        assert langid.decide(got, scores, path, model) == (max(sorted(letters), key=letters.get), pytest.approx(max(letters.values()) / sum(map(len, words))))


def test_viterbi_shortcut():
    r = np.random.default_rng(3)
    for _ in range(60):
        s = r.normal(0, 4, (30, 3))
        best, _ = -np.inf, None
        v = s[0].copy()
        for t in range(1, 30):
            v = np.maximum(v, v.max() - 12) + s[t]
        path = langid.viterbi(s, 12.0)
        score = s[np.arange(30), path].sum() - 12 * (np.diff(path) != 0).sum()
        assert score == pytest.approx(v.max())


def test_toxicity(spark):
    clean, bad = [prose(40, i) for i in range(60)], [prose(20, 100 + i) + f" you grubblox{'ab'[i % 2]} {prose(10, 300 + i)}." for i in range(30)]
    grammar = toxicity.fit([(t, 0) for t in clean] + [(t, 1) for t in bad])
    texts = EDGE + [(8, "So. You grubbloxz person. Then"), (9, clean[0])]
    got = {r.doc_id: r.score for r in toxicity.score(table(spark, texts), grammar).collect()}
    assert got[8] > 0.5 > got[9] and got[1] == got[2] < 0.5
    assert toxicity.score(table(spark, texts), toxicity.fit([])).filter("score <> 0").count() == 0


def paths(machines, symbols):
    """Every path through transducers run one after the other: (outputs, weight, accepted)."""
    if not machines:
        return [((), 0, True)] if all(s != "dead" for s in symbols) else []
    found = []

    def walk(state, at, out, weight):
        if at == len(symbols):
            if state in machines[0].final:
                found.append((out, weight))
            return
        for i, o, w, to in machines[0].arcs[state]:
            if i == symbols[at]:
                walk(to, at + 1, (*out, o), weight + w)

    for start in machines[0].starts:
        walk(start, 0, (), 0)
    return [(o, w + more, True) for out, w in found for o, more, _ in paths(machines[1:], out)]


def test_clause_weights_against_all_paths():
    machines = [toxicity.negation(), toxicity.reported(), toxicity.match()]
    matcher = toxicity.Matcher(toxicity.Grammar())
    r = random.Random(3)
    for _ in range(300):
        clause = [(s, r.choice((50, 190)) if s == "I" else 160 if s == "H" else 0) for s in r.choices("xYNRIIH", k=r.randint(1, 7))]
        best = 0
        taken = [i for i, (s, _) in enumerate(clause) if s in "IH"]
        for mask in range(1 << len(taken)):
            use = {i for j, i in enumerate(taken) if mask >> j & 1}
            read = [s if i in use or s not in "IH" else "x" for i, (s, _) in enumerate(clause)]
            gain = sum(clause[i][1] for i in use)
            best = max([best, *(gain + w for _, w, _ in paths(machines, read))])
        assert matcher.clause(clause) == best / 100, clause


def test_clauses():
    matcher = toxicity.Matcher(toxicity.Grammar({"blarg": 1.5}))
    weigh = lambda text: matcher.clause([matcher.known[w] for w in text.split()])
    assert weigh("blarg") == weigh("xx blarg xx") == weigh("kill time") == 0  # isolated words
    assert weigh("you blarg") == weigh("blarg you") == 1.9
    assert weigh("you xx xx xx xx xx xx blarg") == 1.5
    assert weigh("you never blarg") == weigh("you not xx xx blarg") == 0.9
    assert weigh("they said you blarg") == weigh("you blarg xx said") == 1.5
    assert weigh("kill you") == 1.6 and weigh("never kill you") == 0 and weigh("kill xx xx xx you") == 0
    assert weigh("said kill you") == 1.2
    assert matcher.features("You walk. Blarg!")[0] == 0 < matcher.features("You walk, blarg!")[0]


def test_executors_without_the_package():
    """What is sent to executors can be read where the package is not installed."""
    import subprocess
    import sys

    from pyspark.cloudpickle import dumps

    sent = []

    class Frame:
        sparkSession = property(lambda self: self)
        sparkContext = property(lambda self: self)

        def broadcast(self, value):
            sent.append(value)

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            sent.append(run)

    toxicity.score(Frame(), toxicity.fit([("you bad thing", 1), ("fine", 0)] * 9))
    langid.predict(Frame(), langid.fit([("the and", "en"), ("le de", "fr")]))
    for value in sent:
        subprocess.run([sys.executable, "-c", "import pickle, sys; pickle.loads(sys.stdin.buffer.read()); assert 'lectern' not in sys.modules"], input=dumps(value), cwd="/tmp", check=True, env={"PATH": "/usr/bin"})


def test_top_k(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.integers(-1024, 1024, (500, 8)), r.integers(-3, 3, (100, 8)) + 500])
    ids = np.arange(600)
    data = spark.createDataFrame([(int(i), [int(y) for y in v]) for i, v in zip(ids, x)] + [(1000, [1, 2])], "vec_id long, v array<bigint>")
    got = sorted(tuple(r) for r in knn.top_k(data.filter("vec_id % 50 = 0"), data, 10).collect())
    want = []
    for q in ids[::50]:
        order = sorted((-int(x[q] @ x[i]), int(i)) for i in ids if i != q)[:10]
        want += [(int(q), n + 1, i, -s) for n, (s, i) in enumerate(order)]
    assert [g for g in got if g[0] != 1000] == sorted(want)
    odd = spark.createDataFrame([(1, [1.0, float("nan")]), (2, None), (3, [1.0, None]), (4, [float("inf")]), (5, [0.5])], "vec_id long, e array<double>")
    assert [r.vec_id for r in odd.filter(knn.usable(F.col("e"))).collect()] == [5]


def test_cover_tree_invariants():
    r = np.random.default_rng(6)
    shapes = [r.normal(0, 1, (40, 5))[r.integers(0, 40, 900)] * 100 + r.normal(0, d, (900, 5)) for d in (0.5, 5, 40)]
    shapes += [r.normal(0, 1, (700, 64)), np.ones((200, 3)), np.zeros((1, 4)), np.repeat(r.normal(0, 1, (3, 6)), 100, 0)]
    depth = 0
    for x in shapes:
        order, nodes = knn.cover_tree(x)
        assert sorted(order) == list(range(len(x))) and (nodes["start"][0], nodes["stop"][0]) == (0, len(x))
        top = np.sqrt(((x - x[nodes["center"][0]]) ** 2).sum(1)).max()
        depth = max(depth, nodes["level"].max())
        for n in nodes:
            rows = order[n["start"] : n["stop"]]
            assert np.sqrt(((x[rows] - x[n["center"]]) ** 2).sum(1)).max() <= n["radius"] + 1e-12
            kids = nodes[n["child"] : n["last"]]
            if len(kids):
                assert n["center"] in kids["center"]  # nesting
                assert kids["start"].min() == n["start"] and kids["stop"].max() == n["stop"] and (kids["stop"] - kids["start"]).sum() == n["stop"] - n["start"]
                assert (np.sqrt(((x[kids["center"]] - x[n["center"]]) ** 2).sum(1)) <= top / knn.BASE ** n["level"] * (1 + 1e-9)).all()  # covering
        for level in set(nodes["level"]):
            c = x[nodes["center"][nodes["level"] == level]]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) + np.eye(len(c)) * 1e9
            assert (apart > top / knn.BASE**level * (1 - 1e-9)).all()  # separation
    assert depth > 3


def test_top_k_blocks(spark, monkeypatch):
    """Many blocks on both sides, repeated vectors and ties, null ids, one query alone in its length."""
    monkeypatch.setattr(knn, "DATA_BLOCK", 90)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    r = np.random.default_rng(14)
    x = np.concatenate([r.integers(-40, 40, (30, 6))[r.integers(0, 30, 400)], r.integers(-1024, 1024, (200, 6))])
    rows = [(i, [int(y) for y in v]) for i, v in enumerate(x)] + [(700, [5]), (702, [])]
    data = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    got = sorted(tuple(z) for z in knn.top_k(data.filter("vec_id % 10 = 0"), data, 10).collect())
    want = []
    for q in range(0, 600, 10):
        order = sorted((-int(x[q] @ x[i]), i) for i in range(600) if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    assert got == sorted(want)


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 5), "big" if i < 800 else f"s{i % 4}") for i in range(1000)] + [(2000, None, None), (2001, "", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = mixing.Mix(entropy=0.9, repeat=3.0, block_rows=64)
    got = mixing.mix(df, how).collect()
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s or ""] += len((t or "").split())
    live = {s: n for s, n in tokens.items() if n}
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.n_tokens
    total = sum(live.values())
    share = [taken[s] / sum(taken.values()) for s in live]
    entropy = -sum(p * np.log(p) for p in share) / np.log(len(live))
    assert entropy > 0.87 and all(taken[s] <= 3.05 * live[s] for s in live) and abs(sum(taken.values()) - total) < 0.02 * total
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(7), how).collect()))
    assert mixing.mix(df.limit(0), how).count() == 0


def test_mixing_against_plain_python(spark):
    """The exponent by plain bisection, passes and prefixes by sorting; Spark only hashes."""
    r = random.Random(31)
    rows = [(i, "w " * r.randint(0, 9), "abcd"[min(r.randrange(9), 3)]) for i in range(600)] + [(None, "x y", "a"), (7, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = mixing.Mix(entropy=0.97, repeat=2.5, block_rows=50)
    hashed = df.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64(F.lit(how.seed), "doc_id", "text").alias("h"), F.xxhash64("doc_id", "text").alias("tie")).collect()
    by = collections.defaultdict(list)
    for x in hashed:
        by[x.source].append((x.h, x.tie, len((x.text or "").split()), x.doc_id))
    tokens = {s: sum(n for _, _, n, _ in v) for s, v in by.items()}
    live = {s: n for s, n in tokens.items() if n}
    total = sum(live.values())

    def fits(alpha):
        w = {s: (n / total) ** alpha for s, n in live.items()}
        z = sum(w.values())
        entropy = -sum(x / z * np.log(x / z) for x in w.values())
        return entropy >= how.entropy * np.log(len(live)), max(w[s] / z * total / live[s] for s in live) <= how.repeat

    grid = np.linspace(0, 1, 20001)
    alpha = max([a for a in grid if fits(a)[0]], default=0.0)
    alpha = max(alpha, min(a for a in grid if fits(a)[1]))
    found = mixing.exponent(df.select(F.coalesce("source", F.lit("")).alias("source"), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), " "), "")).cast("long").alias("t")).groupBy("source").agg(F.sum("t").alias("tokens")), how)
    assert abs(found - alpha) < 1e-3
    z = sum(n**found for n in live.values())
    want = collections.Counter()
    for s, docs in by.items():
        quota = int(tokens[s] ** found / z * total) if tokens[s] else 0
        passes, prefix = divmod(quota, tokens[s]) if tokens[s] else (1, 0)
        blocks, at = max(1, -(-len(docs) // how.block_rows)), 0
        for h, tie, n, i in sorted(docs, key=lambda d: (d[0] % blocks, d[0], d[1])):
            at += n
            want[i] += passes + (at <= prefix)
    got = collections.Counter(x.row.doc_id for x in mixing.mix(df, how).collect())
    assert got == +want


def test_samples_refill(spark):
    """Long texts take no short text's place; where there is nothing else, their heads train."""
    n = 60
    docs = spark.createDataFrame([(i, f"{i} " + "x" * (2 if i % 4 == 0 else 100), "aa" if i % 2 == 0 else "bb") for i in range(n)], "doc_id long, text string, lang string")
    got = langid.sample(docs, F.lit(True), per_lang=10, most_chars=50)
    assert collections.Counter(lang for _, lang in got) == {"aa": 10, "bb": 10}
    assert all(len(t) <= 5 for t, lang in got if lang == "aa") and all(len(t) == 50 for t, lang in got if lang == "bb")
    labels = docs.select("doc_id", (F.col("lang") == "aa").cast("int").alias("toxic"))
    got = toxicity.sample(docs, labels, per_label=10, most_chars=50)
    assert collections.Counter(y for _, y in got) == {1: 10, 0: 10}
    assert all(len(t) <= 5 for t, y in got if y == 1) and all(len(t) == 50 for t, y in got if y == 0)
