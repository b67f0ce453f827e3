"""Document tables that change together.

Tables are dealt into buckets by document. A batch writes the buckets it changes to new folders and then
publishes all of them by renaming one manifest into place, so a reader sees every table of a batch or none,
and a failed batch leaves files that no manifest names. Buckets that a batch does not touch are the same
files before and after.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.shared import filesystem


class Conflict(RuntimeError):
    """Another batch was published in between."""


class Versions:
    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = 64):
        """``keys``: for each table the column that deals its rows."""
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    def bucket(self, column) -> F.Column:
        return F.pmod(F.xxhash64(F.col(column).cast("bigint") if isinstance(column, str) else column), F.lit(self.buckets)).cast("int")

    def of(self, ids: DataFrame, column: str = "doc_id") -> list[int]:
        """The buckets of some ids: at most ``buckets`` numbers."""
        return sorted(r[0] for r in ids.select(self.bucket(column)).distinct().collect())

    def manifest(self) -> dict:
        """The newest one: {version, tables: {name: {schema, files: {bucket: path}}}}."""
        folder, system = filesystem(self.spark, f"{self.root}/_versions")
        found = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("v")] if system.exists(folder) else []
        if not found:
            return {"version": 0, "tables": {}}
        newest = max(found, key=lambda p: p.getName())
        return json.loads("".join(r[0] for r in self.spark.read.text(newest.toString(), wholetext=True).collect()))

    def read(self, name: str, buckets: list[int] | None = None, at: dict | None = None) -> DataFrame:
        """A table, or some buckets of it, as the manifest ``at`` (the newest) has it."""
        table = (at or self.manifest())["tables"][name]
        paths = [p for b, p in table["files"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], table["schema"])
        return self.spark.read.schema(table["schema"]).parquet(*paths)

    def publish(self, tables: dict[str, tuple[DataFrame, list[int]]], before: dict | None = None) -> int:
        """{name: (rows, buckets)}: these buckets now hold these rows and nothing else. ``before``: the manifest
        the rows were computed from; if another batch was published since, nothing changes and Conflict is raised."""
        before = before or self.manifest()
        after = {"version": before["version"] + 1, "tables": dict(before["tables"])}
        for name, (rows, buckets) in tables.items():
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            dealt = rows.withColumn("_bucket", self.bucket(self.keys[name])).filter(F.col("_bucket").isin(buckets))
            dealt.repartition(max(1, len(buckets)), "_bucket").write.partitionBy("_bucket").parquet(path)
            files = {b: p for b, p in before["tables"].get(name, {"files": {}})["files"].items() if int(b) not in buckets}
            folder, system = filesystem(self.spark, path)
            for s in system.listStatus(folder):
                if (part := s.getPath().getName()).startswith("_bucket="):
                    files[part.split("=")[1]] = f"{path}/{part}"
            after["tables"][name] = {"schema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "files": files}
        self._name(after)
        return after["version"]

    def _name(self, manifest: dict) -> None:
        draft, system = filesystem(self.spark, f"{self.root}/_versions/draft-{uuid.uuid4().hex}")
        out = system.create(draft)
        out.write(json.dumps(manifest).encode())
        out.close()
        final, _ = filesystem(self.spark, f"{self.root}/_versions/v{manifest['version']:012d}")
        if system.exists(final) or not system.rename(draft, final):
            system.delete(draft, False)
            raise Conflict(f"version {manifest['version']} is there already")
