"""Blocks of vectors against sorting all products."""

import numpy as np
import pytest

from lectern.operators import retrieval


@pytest.mark.parametrize("blocks", [(50, 3), (16_384, 2_048)])
def test_vector_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(retrieval, "VECTORS", blocks[0])
    monkeypatch.setattr(retrieval, "QUESTIONS", blocks[1])
    r = np.random.default_rng(3)
    x = r.integers(-2, 3, (200, 4)).astype(float)  # many ties
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    asked = held.filter("vec_id % 20 = 0").selectExpr("vec_id AS qid", "v AS q")
    got = sorted((z.qid, z["rank"], z.vec_id, z.score) for z in retrieval.vector_top_k(asked, held, 5).collect())
    want = []
    for q in range(0, 200, 20):
        order = sorted((-float(x[q] @ x[i]), i) for i in range(200) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    assert got == sorted(want)
    assert retrieval.vector_top_k(asked, held.limit(0), 5).count() == 0
