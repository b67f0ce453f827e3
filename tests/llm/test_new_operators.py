"""Chat formatting, spelling variants and integer k-means against plain Python."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import chat, lloyd, spelling

TURNS = "conv_id long, turn long, role string, text string, piece string, loss string, content string"
T = chat.Template()
SPICED = st.lists(st.sampled_from(["\\", "<", "|", ">", "[", "]", "/", "s", "INST", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|", "<|image_1|>", "é", "\n", " "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(SPICED, st.sampled_from(["user", "assistant", "system", "tool", "", "<|x"]), st.lists(SPICED, max_size=4))
def test_escape_round_trip(text, role, texts):
    escaped = T.escape(text)
    assert T.unescape(escaped) == text and not any(c in escaped for c in T.controls)
    out = ""
    for t in [text, *texts]:
        before, after = T.around(role)
        flat = chat.Flatten(T, chat.Expand()).flatten([t, {"type": "image", "url": "u"}, t])
        out += before + flat + after
    assert list(T.parse(out)) == [(role, [p for p in (("text", t), ("image", "1"), ("text", t)) if p[1]]) for t in [text, *texts]]


def test_template_refuses_markers_that_join():
    for turns in ((("user", "<u", "</u>"), ("x", "<u", "u>")), (("user", "[[", "]]"),), (("user", "a\\b", "</u>"),)):
        with pytest.raises(ValueError):
            chat.Template(turns=turns)


def test_parts():
    doc = {"type": "document", "url": "d.pdf", "parts": ["in <s>", {"type": "image", "width": 29, "height": 56}, {"type": "document", "pages": 2}]}
    v = chat.Flatten(T, chat.Expand(), len)
    flat = v.flatten(["a", doc, {"type": "audio", "seconds": 2}, {"type": "film", "x": 1}, 7, {"type": "text", "text": None}])
    assert flat == "a<|document_1|>in <\\s><|image_2|><|document_3|><|/document|><|/document|><|audio_4|><|other_5|><|other_6|>"
    got = [(a["number"], a["parent"], a["kind"], a["reference"], a["n_tokens"]) for a in v.attachments]
    assert got == [(1, 0, "document", "d.pdf", 0), (2, 1, "image", None, 4), (3, 1, "document", None, 512), (4, 0, "audio", None, 50), (5, 0, "other", '{"type": "film", "x": 1}', 256), (6, 0, "other", "7", 256)]
    assert v.n_tokens == 4 + 512 + 50 + 512 + len("a") + len("in <s>")
    deep = "x"
    for _ in range(5000):
        deep = {"type": "document", "parts": [deep]}
    assert chat.Flatten(T, chat.Expand()).flatten([deep]).count("<|/document|>") == 5000
    assert chat.parts_of("t", '["a", null]') == ["a", ""] and chat.parts_of("t", "{") == ["{"] and chat.parts_of(None, None) == [""]


def test_chat(spark):
    rows = [(1, 1, "assistant", "</s>[INST] \\ <|image_1|>"), (1, 0, "user", None), (1, 2, "tool", "x"), (1, 2, "tool", "x"), (1, None, None, "first"), (None, 0, "user", "n"), (2, 0, "assistant", "a" * 300_000), (2, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "p", "l", None) for r in rows], TURNS)
    pieces = chat.format_turns(df)
    assert {r.piece[s.start : s.stop] for r in pieces.collect() for s in r.loss} == {T.escape(rows[0][3]), "a" * 300_000}
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    for conv in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] for r in mine if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 3 and chat.read_back(chat.format_turns(df.limit(0))).count() == 0
    parts = json.dumps(["see ", {"type": "image", "url": "i.png", "width": 28, "height": 28}])
    one = chat.format_turns(spark.createDataFrame([(1, 0, "assistant", "unused", "p", "l", parts)], TURNS), content="content").first()
    assert one.piece == "<s>see <|image_1|></s>" and one.n_tokens == 1 and one.attachments[0].reference == "i.png" and [tuple(s) for s in one.loss] == [(3, 7)]


def brute_variants(texts, how=None):
    how = how or spelling.Spelling()
    n = collections.Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda x: x.group().lower(), run)
            if (h := zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())) % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= how.least_length and c >= how.least_n}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: f for w, f in form.items() if n[f] >= how.ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def test_spelling(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abàß") for _ in range(r.randint(4, 7))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "Ünder", "under", "UNDER"]
    texts = [(i % 7 if i % 11 else None, " ".join(r.choice(words[: 8 + i]) for _ in range(80))) for i in range(50)]
    texts += [(1, None), (2, ""), (3, "İ K 12345"), (4, " ".join(["chain"] * 24 + ["chains"] * 12 + ["xchains"] * 6 + ["xchainsy"] * 3))]
    long = "ab" * 3000
    texts += [(5, " ".join([long] * 4 + [long + "x"] * 3 + ["a" * 4000] * 3 + ["a" * 3999] * 9))]
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in texts], "doc_id long, text string, word string, n int")
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(spelling.planted_words(df)).collect()}
    want = brute_variants(texts)
    assert got == want and want["xchainsy"][1] == "chain" and want["a" * 4000][0] == "a" * 3999
    assert spelling.variants(spelling.planted_words(df.limit(0))).count() == 0


def test_deletion_keys():
    words = ["abcde", "aabbc", "zzzzz", "é" * 3 + "x"]
    key, number, first, last = spelling.deletion_keys(words)
    said = collections.defaultdict(set)
    for k, w, a, b in zip(key, number, first, last):
        for p in range(a, b + 1):
            said[words[w] if a < 0 else words[w][:p] + words[w][p + 1 :]].add(k)
    assert all(len(v) == 1 for v in said.values()) and len({next(iter(v)) for v in said.values()}) == len(said)
    assert len(key) == 5 + 3 + 1 + 2 + 4


def test_collisions_are_told_apart():
    assert spelling.meet([("abcde", 5, 0, 0), ("xyzzz", 9, 0, 0)]) == []
    assert spelling.meet([("abcde", 5, 0, 0), ("xbcde", 9, 0, 0), ("other", 3, -1, -1)]) == [("abcde", 5, 1, 9, "xbcde"), ("xbcde", 9, 1, 5, "abcde")]


def brute_lloyd(rows, how):
    kept = [(i, [math.floor(x * how.scale) if abs(x) < 2**53 else int(x) * how.scale for x in v]) for i, v in rows if v is not None and len(v) == how.dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{how.salt}:{r[0]}".encode()).hexdigest(), r[1]))[: how.k]
    cents = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))
    for _ in range(how.rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(cents)):
            if mine := [v for (_, v), o in zip(kept, own) if o == k]:
                cents[k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    fit = lambda x: x if x < 2**63 else None
    per = collections.Counter()
    for _, k, d in found:
        per[k] += d
    return sorted(
        ((i, k, fit(d), fit(per[k]), fit(sum(per.values())), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, k, d in found), key=repr
    )


@pytest.mark.parametrize("scale_of", [1.0, 1e5, 3e30])
def test_lloyd(spark, scale_of, monkeypatch):
    monkeypatch.setattr(lloyd, "BLOCK", 16)
    r = random.Random(8)
    how = lloyd.Lloyd(k=5, rounds=4, dim=3)
    rows = [(i if i % 9 else None, [scale_of * r.gauss(i % 4, 1) for _ in range(3)]) for i in range(120)]
    rows += [(500, rows[1][1]), (500, rows[1][1]), (501, rows[0][1]), (600, None), (601, [1.0, None, 2.0]), (602, [1.0, math.nan, 2.0]), (603, [math.inf, 0.0, 0.0]), (604, [1.0]), (605, [])]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, v array<double>, cluster string")
    got = sorted(map(tuple, lloyd.summed(*lloyd.cluster(df, how)).collect()), key=repr)
    assert got == brute_lloyd(rows, how)


def test_lloyd_small(spark):
    how = lloyd.Lloyd(k=8, rounds=10, dim=2)
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, -1.0])]
    schema = "vec_id long, v array<double>"
    got = sorted(map(tuple, lloyd.summed(*lloyd.cluster(spark.createDataFrame(rows, schema), how)).collect()), key=repr)
    assert got == brute_lloyd(rows, how)
    assert lloyd.summed(*lloyd.cluster(spark.createDataFrame([], schema), how)).count() == 0


def test_lloyd_rounds_move_only_what_changed(spark):
    """Transfers of later rounds name moved vectors only, and no plan after the first shuffles vectors."""
    how = lloyd.Lloyd(k=2, rounds=3, dim=1)
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "vec_id long, v array<double>").repartition(2)
    held = lloyd.bucketed(lloyd.blocks(rows, how).repartition(2, "block"), 2, "vectors")
    state = lloyd.bucketed(lloyd.assign(held, None, [[0], [39 * 1024]], {0, 1}), 2, "owners")
    then = lloyd.assign(held, state, [[0], [30 * 1024]], {1})
    assert "Exchange" not in then._jdf.queryExecution().executedPlan().toString()
    moves = {(m.c, m.limb): m.v for r in then.select(F.explode("moves").alias("m")).select("m.*").filter("d = 1").groupBy("c", "limb").agg(F.sum("v").alias("v")).collect() for m in [r]}
    assert moves == {(0, 0): -4, (1, 0): 4}
