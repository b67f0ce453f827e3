"""Clusters of strokes against all pairs, and a page of twenty thousand."""

import random
import time

import numpy as np

from lectern.operators import drawings

STROKES = "doc_id long, page long, width double, height double, x0 double, y0 double, x1 double, y1 double"


def brute(boxes, gap):
    of = list(range(len(boxes)))
    for _ in boxes:
        for i, a in enumerate(boxes):
            for j, b in enumerate(boxes):
                if a[0] - gap <= b[2] and b[0] - gap <= a[2] and a[1] - gap <= b[3] and b[1] - gap <= a[3]:
                    of[i] = of[j] = min(of[i], of[j])
    return of


def same(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_components():
    r = random.Random(1)
    for _ in range(40):
        boxes = [(x, y, x + r.random() * 20, y + r.random() * 20) for x, y in ((r.random() * 300, r.random() * 300) for _ in range(r.randint(1, 25)))]
        assert same(drawings.components(np.array(boxes), 14.0).tolist(), brute(boxes, 14.0))
    for spread in (100, 1e6):
        x = np.random.default_rng(2).random((20_000, 2)) * spread
        began = time.monotonic()
        label = drawings.components(np.hstack([x, x + 1]), 0.5)
        assert len(label) == 20_000 and time.monotonic() - began < 60


def test_figures(spark):
    grid = [(1, 1, 600.0, 800.0, 100.0 + 10 * i, 100.0 + 20 * j, 105.0 + 10 * i, 110.0 + 20 * j) for i in range(20) for j in range(8)]
    few = [(1, 2, 600.0, 800.0, 10.0 * i, 5.0, 10.0 * i + 5, 9.0) for i in range(5)]
    frame = [(1, 1, 600.0, 800.0, 0.0, 0.0, 600.0, 800.0), (1, 1, 600.0, 800.0, None, 0.0, 1.0, 1.0)]
    found = drawings.clusters(spark.createDataFrame(grid + few + frame, STROKES))
    assert [tuple(x)[4:] for x in found.collect()] == [(92.0, 92.0, 303.0, 258.0, 160)]
    none = spark.createDataFrame([], STROKES)
    pages = spark.createDataFrame([(1, 1)], "doc_id long, page long")
    over = spark.createDataFrame([(1, 1, 600.0, 800.0, 250.0, 250.0, 500.0, 500.0)], STROKES)
    assert [x.vector for x in drawings.figures(found, none, pages.limit(0)).collect()] == [True]
    assert [x.vector for x in drawings.figures(found, over, pages.limit(0)).collect()] == [False]
    assert drawings.figures(found, over, pages).count() == 0
    sizes = spark.createDataFrame([(48, 125), (47, 900), (60, 99)], "w int, h int")
    assert [tuple(x) for x in drawings.legible(sizes).collect()] == [(48, 125)]
