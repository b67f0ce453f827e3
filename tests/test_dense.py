"""Sparse vectors against sorting all products, sent to the tasks and joined on buckets."""

import numpy as np
import pytest

from lectern.operators import retrieval


@pytest.mark.parametrize("sent, block, rows", [(2_000_000, 2_048, 2_000), (2_000_000, 3, 7), (1, 2_048, 2_000)])
def test_dense(spark, monkeypatch, sent, block, rows):
    monkeypatch.setattr(retrieval, "ENTRIES", sent)
    monkeypatch.setattr(retrieval, "QUESTIONS", block)
    monkeypatch.setattr(retrieval, "DENSE_ROWS", rows)
    r = np.random.default_rng(5)
    x = r.integers(-2, 3, (80, 12)) * (r.random((80, 12)) < 0.3)  # many ties, zeros, pairs without a common bucket
    entries = [(i, b, float(x[i, b])) for i in range(80) for b in range(12) if x[i, b]]
    held = spark.createDataFrame(entries, "doc_id long, bucket int, weight double")
    asked = held.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "qid")
    got = sorted((z.qid, z["rank"], z.doc_id, z.score) for z in retrieval.dense(asked, held, 5).collect())
    want = []
    for q in range(0, 80, 10):
        order = sorted((-float(x[q] @ x[i]), i) for i in range(80) if (x[q] * x[i] != 0).any())[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    assert got == sorted(want)
    assert retrieval.dense(asked, held.limit(0), 5).count() == 0
    assert retrieval.dense(asked.limit(0), held, 5).count() == 0
