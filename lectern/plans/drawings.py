"""Clusters of boxes made of events: 25 to a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import drawings
from lectern.plans.common import read


def _pages(spark, sf_dir):
    e, at = read(spark, sf_dir, "events"), F.col("event_id")
    x, y = (at * 7919) % 211, (at * 104_729) % 173
    return e.select(
        (F.floor(at / 2500)).alias("doc_id"), F.floor(at / 25).alias("page"), F.lit(600.0).alias("width"), F.lit(500.0).alias("height"), x.alias("x0"), y.alias("y0"),
        (x + 5 + at % 60).alias("x1"), (y + 5 + at % 40).alias("y1"), (at % 25 == 0).alias("picture"), "event_id",
    )


def figure_clusters(spark, sf_dir):
    return drawings.clusters(_pages(spark, sf_dir).filter("NOT picture")).select("doc_id", "page", "x0", "y0", "x1", "y1", "strokes")


def figure_selection(spark, sf_dir):
    """The first box of a page is a picture, grown by its number; every fifth page is scanned."""
    rows = _pages(spark, sf_dir)
    grown = F.col("event_id") % 7 * 30
    pictures = rows.filter("picture").withColumn("x1", F.col("x1") + grown).withColumn("y1", F.col("y1") + grown)
    scanned = rows.filter("page % 5 = 0").select("doc_id", "page")
    found = drawings.figures(drawings.clusters(rows.filter("NOT picture")), pictures.select(*(F.col(c).cast("double") if c[0] in "xy" else c for c in ("doc_id", "page", "width", "height", "x0", "y0", "x1", "y1"))), scanned)
    return found.select("doc_id", "page", "x0", "y0", "x1", "y1", "vector")


_BOXES = """WITH RECURSIVE e AS (SELECT event_id AS i, event_id // 2500 AS doc_id, event_id // 25 AS page, (event_id * 7919) % 211 AS x0, (event_id * 104729) % 173 AS y0,
    (event_id * 7919) % 211 + 5 + event_id % 60 AS x1, (event_id * 104729) % 173 + 5 + event_id % 40 AS y1 FROM events),
s AS MATERIALIZED (SELECT * FROM e WHERE i % 25 <> 0),
near AS MATERIALIZED (SELECT a.i AS a, b.i AS b FROM s a JOIN s b ON a.page = b.page AND a.x0 - 14 <= b.x1 AND b.x0 - 14 <= a.x1 AND a.y0 - 14 <= b.y1 AND b.y0 - 14 <= a.y1),
reach AS (SELECT i, i AS there FROM s UNION SELECT reach.i, near.b FROM reach JOIN near ON near.a = reach.there),
comp AS (SELECT i, min(there) AS c FROM reach GROUP BY i),
box AS MATERIALIZED (SELECT doc_id, page, greatest(0, min(x0) - 8)::DOUBLE AS x0, greatest(0, min(y0) - 8)::DOUBLE AS y0, least(600, max(x1) + 8)::DOUBLE AS x1, least(500, max(y1) + 8)::DOUBLE AS y1, count(*) AS strokes
    FROM s JOIN comp USING (i) GROUP BY doc_id, page, c HAVING count(*) >= 8)"""
QUERIES = {f.__name__: f for f in (figure_clusters, figure_selection)}
SQL = {
    "figure_clusters": f"{_BOXES} SELECT * FROM box",
    "figure_selection": f"""{_BOXES}, pic AS (SELECT doc_id, page, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x1 + i % 7 * 30)::DOUBLE AS x1, (y1 + i % 7 * 30)::DOUBLE AS y1 FROM e WHERE i % 25 = 0),
        alle AS (SELECT doc_id, page, x0, y0, x1, y1, true AS vector FROM box WHERE NOT EXISTS (SELECT 1 FROM pic WHERE pic.page = box.page AND box.x0 < pic.x1 AND pic.x0 < box.x1 AND box.y0 < pic.y1 AND pic.y0 < box.y1)
            UNION ALL SELECT *, false FROM pic)
        SELECT * FROM alle WHERE (x1 - x0) * (y1 - y0) / 300000 BETWEEN 0.06 AND 0.85 AND page % 5 <> 0""",
}
