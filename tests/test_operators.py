"""Behaviour of single operators on small inputs of our own."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunks, links, structure, sync
from lectern.plans import relational


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("x")).first().x


def test_terms_keep_stopwords_only_if_alone(spark):
    assert one(spark, T.terms("t"), "The Pump of the Well") == ["pump", "well"]
    assert one(spark, T.terms("t"), "to be or not") == ["to", "be", "or", "not"]


def test_numbers(spark):
    assert one(spark, T.numbers("t"), "1,234 and 2,5 and 3.10 [4]") == ["1234", "2.5", "3.1"]


def test_canonical_numbers(spark, tmp_path):
    texts = ["1,234.50 and 1234.5 and 1234", "1.234 equals 1234 and 1 234", "3,10 = 3.1 = 3.100, not 31 [4]", "1,234,567 1234567.0", "none", "", None, "10.20.30.40 and 10.2"]
    r = random.Random(8)
    texts += ["".join(r.choice("0123,. x") for _ in range(30)) for _ in range(60)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, t in rows:
        t = re.sub(r"\[\d{1,2}\]", " ", t or "")
        t = re.sub(r"(?<=\d),(?=\d{1,2}(?!\d))", ".", re.sub(r"(?<=\d)[,.\s](?=\d{3}(?!\d))", "", t))
        want[i] = len({n.rstrip("0").rstrip(".") if "." in n else n for n in re.findall(r"\d+(?:\.\d+)?", t)})
    got = {x.doc_id: x.n_numbers for x in relational.canonical_numbers(spark, str(tmp_path)).collect()}
    assert got == {i: n for i, n in want.items() if n}
    assert [want[i] for i in range(4)] == [2, 1, 3, 1]


def test_lead(spark):
    assert one(spark, T.lead("t", 2), " a  b\nc ") == "a b ..."
    assert one(spark, T.lead("t", 3), " a  b\nc ") == "a b c"


def test_stem_and_fold(spark):
    assert one(spark, T.content_terms("t"), "Città grandi, the cities [1] 2024") == ["citta", "grand", "citie"]


def test_claim_sentences(spark):
    assert one(spark, T.claim_sentences("t"), "It is 3.5 m. Then (next) e.g. this.\nLast") == ["It is 3.5 m.", "Then (next) e.g. this.", "Last"]


def greedy(sizes, limit):
    out, b, used = [], 0, 0
    for n in sizes:
        if used and used + n > limit:
            b, used = b + 1, 0
        used += n
        out.append(b)
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 260), min_size=1, max_size=30))
def test_greedy_bins(spark, sizes):
    got = spark.createDataFrame([(sizes,)], "s array<int>").select(chunks.greedy_bins(F.col("s"), 260).alias("b")).first().b
    assert got == greedy(sizes, 260)


def test_chunks_keep_all_words_in_order(spark):
    rnd = random.Random(3)
    text = " ".join(f"w{i}" + ("." if rnd.random() < 0.02 else "") for i in range(2000))
    rows = chunks.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ordinal").collect()
    assert " ".join(r.text for r in rows).split() == text.split()
    assert max(r.words for r in rows) <= 260


def test_numbered_runs(spark):
    lines = ["1. Alpha part", "2. Beta part", "3. Gamma part", "4. Delta part", "Some text that ends here.", "1.1 Sub part"]
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, idx int, text string")
    assert sorted((r.idx, r.level, r.strong) for r in structure.numbering(b).collect()) == [(0, 1, False), (2, 1, False), (3, 1, False), (5, 2, True)]


def test_identifiers_and_citations(spark):
    docs = spark.createDataFrame(
        [(1, "arXiv:1706.03762v5 Title", "arXiv:1706.03762v5 Title"), (2, "About", "see arXiv 1706.03762 and doi 10.1000/XYZ.1."), (3, "Copy", "nothing")],
        "doc_id long, head string, text string",
    )
    assert [tuple(r) for r in links.citations(docs).collect()] == [(2, 1, "arxiv:1706.03762")]
    assert docs.filter("doc_id = 2").select(links.identifiers("text").alias("x")).first().x == ["arxiv:1706.03762", "doi:10.1000/xyz.1"]


def test_profiles_need_agreement(spark):
    v = spark.createDataFrame([("md", "a", 1, 2), ("md", "b", 1, 1), ("md", "c", 1, 2), ("md", "c", 2, 3)], "format string, style string, level int, weight int")
    assert [tuple(r) for r in structure.learned_levels(v).collect()] == [("md", "a", 1)]


def test_sync_actions(spark):
    known = spark.createDataFrame([("a", "1", 1, 9, "v"), ("b", "2", 1, 9, "v"), ("c", "3", 1, 9, "old"), ("d", "4", 1, 9, "v"), ("e", "5", 1, 9, "v")], "path string, sha string, mtime long, size long, index_sig string")
    listing = spark.createDataFrame([("a", "9", 2, 9, True), ("c", "3", 1, 9, True), ("x", "2", 1, 9, True), ("y", "7", 1, 9, True), ("z", "8", 1, 9, False), ("e", "5", 1, 9, True), ("w", "5", 1, 1, True)], "path string, sha string, mtime long, size long, settled boolean")
    got = {r.path: r.action for r in sync.actions(known, listing, "v").collect()}
    assert got == {"a": "updated", "c": "rebuilt", "x": "renamed", "y": "added", "d": "removed", "w": "duplicate"}
