"""Files that settle, fail and come back; vectors that are made once."""

import datetime as dt

from lectern.operators import retrieval, vectors
from lectern.streaming import watcher

START = dt.datetime(2024, 1, 1)


def test_a_file_counts_once_it_stands_still(spark, tmp_path):
    box, listings, table, state = (str(tmp_path / x) for x in ("in", "listings", "table", "state"))
    (tmp_path / "in").mkdir()
    file = lambda name: tmp_path / "in" / name
    names = lambda df: sorted({r.path.rsplit("/", 1)[1] for r in df.collect()})

    def look(minute, run=True):
        watcher.sweep(spark, box, listings, START + dt.timedelta(minutes=minute))
        if run:  # each run is a restart from the checkpoint
            watcher.watch(spark, listings, table, state, dt.timedelta(minutes=2)).awaitTermination(120)

    file("a.md").write_text("# A\ntext")
    file("bad.docx").write_bytes(b"not a zip")
    file("odd.bin").write_bytes(b"?")
    file("grow.md").write_text("# G")
    look(0)
    assert watcher.blocks(spark, table).count() == 0
    file("grow.md").write_text("# G\nmore and more")
    look(2)
    assert names(watcher.blocks(spark, table)) == ["a.md"]
    assert {(r.path.rsplit("/", 1)[1], r.size) for r in watcher.failures(spark, table).collect()} == {("bad.docx", 9), ("odd.bin", 1)}
    look(3, run=False)
    look(4)
    assert names(watcher.blocks(spark, table)) == ["a.md", "grow.md"]
    assert {r.text for r in watcher.blocks(spark, table).filter("kind = 'para'").collect()} == {"text", "more and more"}
    look(9)
    assert watcher.failures(spark, table).count() == 2  # not tried again as they are
    file("bad.docx").write_bytes(b"still not a zip")
    file("a.md").write_text("# A\nnew words")
    look(10, run=False)
    look(13)
    assert watcher.failures(spark, table).count() == 3
    assert {r.text for r in watcher.blocks(spark, table).filter("kind = 'para'").collect()} == {"new words", "more and more"}


def test_vectors_are_made_once(spark, tmp_path):
    rows = [(i, f"v{i % 3}", f"alpha beta{i} gamma{i % 4}") for i in range(40)] + [(99, "v", "")]
    place = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, version string, text string").write.parquet(place)
    docs, cache = spark.read.parquet(place), vectors.VectorCache(spark, str(tmp_path / "v"), 4)
    assert cache.refresh(docs) == 41 and cache.refresh(docs) == 0
    plan = cache.vectors()._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and cache.tables.manifest()["version"] == 1
    rows[7] = (7, "new", "delta")
    changed = spark.createDataFrame([r for r in rows if r[0] != 8], "doc_id long, version string, text string")
    assert cache.refresh(changed) == 1
    key = lambda df: sorted((r.doc_id, r.bucket, round(r.weight, 9)) for r in df.collect())
    assert key(cache.vectors()) == key(retrieval.hash_embedding(changed))
    asked = spark.createDataFrame([(1, "delta")], "qid long, text string")
    assert [r.doc_id for r in cache.search(asked, changed, 1).collect()] == [7]
