"""Vectors of texts kept from one query to the next, by the version of each text.

``VectorCache`` holds (doc_id, version, bucket, weight) in ``Versions``. ``refresh`` compares ids and versions only; texts are
read of the documents whose version is not there, and the buckets these fall into are published. When nothing has
changed no text is read at all. A document without a term keeps a row without a bucket, so it is not taken for a new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import retrieval
from lectern.versions import Versions

SCHEMA = "doc_id bigint, version string, bucket bigint, weight double"


class VectorCache:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.tables = spark, Versions(spark, root, {"vectors": "doc_id"}, buckets)

    def _held(self, at: dict, buckets: list[int] | None = None) -> DataFrame:
        return self.tables.read("vectors", buckets, at) if at["tables"] else self.spark.createDataFrame([], SCHEMA)

    def refresh(self, docs: DataFrame) -> int:
        """docs(doc_id, version, text): all documents. Returns the number of texts that were read."""
        at = self.tables.manifest()
        there = docs.select("doc_id", "version")
        known = self._held(at).select("doc_id", "version").distinct()
        stale = there.join(known, ["doc_id", "version"], "left_anti")
        gone = known.join(there, ["doc_id", "version"], "left_anti")
        buckets = self.tables.of(stale.select("doc_id").unionByName(gone.select("doc_id")))
        if not buckets:
            return 0
        new = docs.join(stale, ["doc_id", "version"], "left_semi")
        made = new.select("doc_id", "version").join(retrieval.hash_embedding(new), "doc_id", "left")
        kept = self._held(at, buckets).join(there, ["doc_id", "version"], "left_semi")
        n = stale.count()
        self.tables.publish({"vectors": (kept.select("doc_id", "version", "bucket", "weight").unionByName(made.select("doc_id", "version", F.col("bucket").cast("bigint"), "weight")), buckets)}, at)
        return n

    def vectors(self) -> DataFrame:
        """doc_id, bucket, weight."""
        return self._held(self.tables.manifest()).filter("bucket IS NOT NULL").select("doc_id", "bucket", "weight")

    def search(self, questions: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
        """questions(qid, text) -> qid, doc_id, score, rank by the kept vectors."""
        self.refresh(docs)
        return retrieval.dense(retrieval.hash_embedding(questions, "qid"), self.vectors(), k)
