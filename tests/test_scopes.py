"""Shortlists, excerpts and sinks on small inputs."""

import random

import duckdb
from lectern import sinks
from lectern.operators import scopes
from lectern.plans import scopes as plans
from pyspark.sql import functions as F


def test_shortlist(spark):
    hits = spark.createDataFrame([(1, 9, 1), (1, 8, 41), (2, 3, 1)], "qid long, doc_id long, rank int")
    cards = spark.createDataFrame([(1, i, float(i % 7)) for i in range(10)], "qid long, doc_id long, score double")
    many, few = spark.range(10).withColumnRenamed("id", "doc_id"), spark.range(3).withColumnRenamed("id", "doc_id")
    got = sorted(tuple(r) for r in scopes.shortlist(many, cards, hits).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 9), (2, 3)]
    assert sorted(tuple(r) for r in scopes.shortlist(few, cards, hits).collect()) == [(q, d) for q in (1, 2) for d in range(3)]


def test_excerpt(spark):
    text = "One apple fell. Two pears grew. The river pump broke down. Repairs took days. Nobody paid. Extra sentence here."
    row = spark.createDataFrame([(text, "the pump of the river broke")], "p string, c string").select(scopes.excerpt("p", "c").alias("x"), scopes.excerpt("p", "c", 0, 10).alias("y")).first()
    assert row.x == "One apple fell. Two pears grew. The river pump broke down. Repairs took days. Nobody paid." and row.y == "The river "


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "store")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    sinks.write_documents({"chunks": one}, root, "001")
    sinks.write_documents({"chunks": one}, root, "001")
    sinks.write_documents({"chunks": spark.createDataFrame([(2, "new")], "doc_id long, text string")}, root, "002")
    assert sorted(tuple(r) for r in sinks.read_documents(spark, root, "chunks").select("doc_id", "text").collect()) == [(1, "a"), (2, "new")]
    old, new = one, spark.createDataFrame([(2, "z"), (3, "c")], "doc_id long, text string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["doc_id"]).collect()) == [(1, "a"), (2, "z"), (3, "c")]
    for _ in range(2):
        sinks.append_events(one, str(tmp_path / "events"), "b")
    assert spark.read.json(str(tmp_path / "events")).count() == 2
    sinks.write_report(one.orderBy("doc_id"), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).agg(F.count("*")).first()[0] == 2


def _tables(spark, folder, docs, pages):
    spark.createDataFrame(docs, "doc_id long, n_chars long, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_document_shortlist_odd_rows(spark, tmp_path):
    """Repeated and missing ids, lengths and languages, against the SQL. In the second cluster of lengths other ids are French, so an id is
    searchable by some rows only; no page has rows in both, so no ORDER BY leaves the language open."""
    rng = random.Random(5)
    docs, pages = [(1, None, "en"), (2, 30, None), (9, 1030, "en")], [(3, None), (4, "x" * 5000)]
    for cluster in (0, 1):
        for _ in range(150):
            doc = rng.choice([None, *range(40)])
            lang = "fr" if doc is not None and doc % 3 == cluster else "en"
            docs += [(doc, 1000 * cluster + rng.randrange(160), lang)] * rng.choice([1, 1, 4])
        for _ in range(30):
            page = rng.choice([None if cluster else 99, *range(100 + 20 * cluster, 115 + 20 * cluster)])
            pages += [(page, "é" * (1000 * cluster + rng.randrange(200)))] * rng.choice([1, 1, 3])
    sf = _tables(spark, tmp_path, docs, pages)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(plans.SQL["document_shortlist"]).fetchall(), key=repr)
    got = sorted((tuple(r) for r in plans.document_shortlist(spark, sf).select("qid", "doc_id").collect()), key=repr)
    assert got == want and any(r[1] is None for r in want) and any(r[0] is None for r in want)


def test_document_shortlist_lists_no_near_pairs(spark, tmp_path, monkeypatch):
    sf = _tables(spark, tmp_path, [(i, 500 + i % 7, "en") for i in range(400)], [(i, "x" * (500 + i % 5)) for i in range(60)])
    given = {}
    monkeypatch.setattr(scopes, "shortlist", lambda searchable, cards, hits: given.update(cards=cards, hits=hits))
    plans.document_shortlist(spark, sf)
    assert given["cards"].count() == 60 * scopes.CARDS and given["hits"].count() == 60 * 3
