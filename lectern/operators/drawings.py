"""Figures of pages: strokes clustered into drawings, and the drawings and pictures worth reading.

A page is the unit: its strokes go to one task, where clusters grow from a stroke to all that is near and not yet taken,
so no pairs are listed and dense pages are the fastest. Selection is joins and filters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points between strokes of one drawing, its least number of strokes, points around it, the share of a page that a
# frame has; shares of a page that a figure may have; pixels of a side and of a picture.
GAP, STROKES, PAD, FRAME = 14.0, 8, 8.0, 0.9
SMALLEST, LARGEST, SIDE, AREA = 0.06, 0.85, 48, 6000
PAGE = "doc_id bigint, page bigint, width double, height double"
CLUSTERS = f"{PAGE}, x0 double, y0 double, x1 double, y1 double, strokes bigint"


def components(box: np.ndarray, gap: float) -> np.ndarray:
    """Labels of boxes (x0, y0, x1, y1): the same for boxes that a chain of neighbours at most ``gap`` apart connects."""
    label, left, n = np.full(len(box), -1), np.arange(len(box)), 0
    while len(left):
        todo, left = [left[0]], left[1:]
        label[todo[0]] = n
        while todo and len(left):
            a, b = box[todo.pop()], box[left]
            near = (a[0] - gap <= b[:, 2]) & (b[:, 0] - gap <= a[2]) & (a[1] - gap <= b[:, 3]) & (b[:, 1] - gap <= a[3])
            label[left[near]] = n
            todo += left[near].tolist()
            left = left[~near]
        n += 1
    return label


def clusters(strokes: DataFrame, gap: float = GAP, least: int = STROKES) -> DataFrame:
    """strokes(doc_id, page, width, height of the page, x0, y0, x1, y1) -> CLUSTERS, padded and inside the page. Page frames and strokes
    with a missing edge are left out."""
    sides = ["x0", "y0", "x1", "y1"]

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        of = components(pdf[sides].to_numpy(float), gap)
        ends = pdf.assign(of=of).groupby("of").agg(x0=("x0", "min"), y0=("y0", "min"), x1=("x1", "max"), y1=("y1", "max"), strokes=("x0", "size"))
        ends = ends[ends.strokes >= least]
        first = pdf.iloc[0]
        w, h = first["width"], first["height"]
        return pd.DataFrame({
            "doc_id": first["doc_id"], "page": first["page"], "width": w, "height": h, "x0": (ends.x0 - PAD).clip(lower=0), "y0": (ends.y0 - PAD).clip(lower=0),
            "x1": (ends.x1 + PAD).clip(upper=w), "y1": (ends.y1 + PAD).clip(upper=h), "strokes": ends.strokes,
        })

    whole = [F.col(c).cast("double").alias(c) for c in ("width", "height", *sides)]
    some = strokes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page").cast("bigint").alias("page"), *whole).dropna()
    some = some.filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < FRAME * F.col("width") * F.col("height"))
    return some.groupBy("doc_id", "page").applyInPandas(page, CLUSTERS)


def share() -> Column:
    return (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("width") * F.col("height"))


def figures(drawings: DataFrame, pictures: DataFrame, scanned: DataFrame) -> DataFrame:
    """CLUSTERS, pictures(PAGE, x0 ..), scanned(doc_id, page) -> what is worth reading, with ``vector``: a fair share of its page, not on a scanned
    page, drawings only where no picture overlaps them."""
    edges = ["doc_id", "page", "width", "height", "x0", "y0", "x1", "y1"]
    p = pictures.select("doc_id", "page", *(F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")))
    over = (F.col("x0") < F.col("p_x1")) & (F.col("p_x0") < F.col("x1")) & (F.col("y0") < F.col("p_y1")) & (F.col("p_y0") < F.col("y1"))
    same = (F.col("d.doc_id") == F.col("p.doc_id")) & (F.col("d.page") == F.col("p.page"))
    alone = drawings.select(*edges).alias("d").join(p.alias("p"), same & over, "left_anti").withColumn("vector", F.lit(True))
    every = alone.unionByName(pictures.select(*edges).withColumn("vector", F.lit(False)))
    return every.filter(share().between(SMALLEST, LARGEST)).join(scanned.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def legible(images: DataFrame) -> DataFrame:
    """images(w, h in pixels, ..) that are large enough to read."""
    return images.filter((F.least("w", "h") >= SIDE) & (F.col("w") * F.col("h") >= AREA))
