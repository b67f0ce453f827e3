"""The reference graph kept up to date: after a batch of documents only what can have changed is computed.

``Graph`` holds five tables in ``Versions``: chunks, the positional postings of their tokens, the names and
identifiers each document offers, those its chunks cite, and the edges. A batch replaces or removes whole
documents. What it can change elsewhere goes through a key (a name or identifier) that a document of the
batch offered before or offers now: only chunks that hold such a key as a phrase, found in the postings, or cite
it, can gain, lose or change an edge. Their buckets are read, their citations computed anew against the whole
directory, and all tables are published at once. The texts of other buckets are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import aliases, links, mentions, phrases
from lectern.shared import written
from lectern.versions import Versions

KEYS = {"chunks": "doc_id", "postings": "owner", "offers": "doc_id", "cites": "doc_id", "edges": "src_doc"}
#: A bound of the terms of one batch's names, for broadcasts.
TERMS = 500_000


def offers(docs: DataFrame) -> DataFrame:
    """docs(doc_id, title, path, head) -> doc_id, kind, key: all that a document may be cited by, whoever wins."""
    named = aliases.names(docs, every=True).select("doc_id", F.when(F.col("exact"), "proper").otherwise("name").alias("kind"), F.col("alias").alias("key"))
    front = docs.select("doc_id", F.concat_ws("\n", "title", "head").alias("front"))
    return named.unionByName(front.select("doc_id", F.lit("ident").alias("kind"), F.explode(links.identifiers("front")).alias("key"))).distinct()


def resolved(offered: DataFrame) -> DataFrame:
    """offers -> key, kind, doc_id as ``mentions.directory`` gives it."""
    per = offered.groupBy("key", "kind").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    return per.filter("kind <> 'ident' OR n = 1").select("key", "kind", "doc_id")


def cited(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges to whole documents."""
    found = mentions.find(chunks, keys)
    return found.select(F.col("chunk_id").alias("src"), "src_doc", "dst_doc", F.lit(None).cast("bigint").alias("dst"), F.lit("doc").alias("kind"), "label")


def full(docs: DataFrame, chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """All edges from scratch."""
    return links.inside(chunks, heads).unionByName(cited(chunks, mentions.directory(docs)))


class Graph:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.tables = spark, Versions(spark, root, KEYS, buckets)

    def edges(self) -> DataFrame:
        return self.tables.read("edges")

    def refresh(self, docs: DataFrame, chunks: DataFrame, heads: DataFrame, gone: DataFrame | None = None) -> int:
        """docs(doc_id, title, path, head), chunks(chunk_id, doc_id, text, kind, loc) and heads(doc_id, ordinal, title, first_chunk)
        of the documents that are new or changed; gone(doc_id): those removed. Returns the version published."""
        at = self.tables.manifest()
        ids = docs.select("doc_id")
        touched = ids.unionByName(gone.select("doc_id")).distinct() if gone is not None else ids.distinct()
        buckets = self.tables.of(touched)
        held = chunks.select("chunk_id", "doc_id", "text", "kind", "loc")
        new = {"chunks": held, "offers": offers(docs), "cites": held.select("doc_id", "chunk_id", F.explode(links.identifiers("text")).alias("key")).distinct()}
        new["postings"] = phrases.index(held.select(F.struct("doc_id", "chunk_id").alias("doc_id"), "text")).select(F.col("doc_id.doc_id").alias("owner"), F.col("doc_id.chunk_id").alias("doc_id"), "dl", "term", "at")
        first = not at["tables"]
        old = {name: new[name].limit(0) if first else self.tables.read(name, at=at) for name in new}

        # Keys that the batch offers or no longer offers, and chunks elsewhere that may hold them.
        new["offers"] = written(new["offers"], "offers")
        was = old["offers"].join(touched, "doc_id", "left_semi")
        moved = was.select("kind", "key").unionByName(new["offers"].select("kind", "key")).distinct()
        spelled = moved.filter("kind <> 'ident'").select(phrases.phrase_of("key").alias("phrase")).distinct()
        rest = old["postings"].join(touched.withColumnRenamed("doc_id", "owner"), "owner", "left_anti")
        spoken = phrases.matches(spelled, rest.select("doc_id", "dl", "term", "at"), TERMS).select(F.col("doc_id").alias("chunk_id")).join(rest.select(F.col("doc_id").alias("chunk_id"), "owner").distinct(), "chunk_id")
        coded = old["cites"].join(moved.filter("kind = 'ident'"), "key", "left_semi").join(touched, "doc_id", "left_anti").select("chunk_id", F.col("doc_id").alias("owner"))
        others = written(spoken.unionByName(coded).distinct(), "reached")
        reached = sorted(set(buckets) | set(self.tables.of(others, "owner")))

        # Their edges, computed anew; what else is in these buckets stays.
        fresh = {name: self.kept(old[name] if first else self.tables.read(name, buckets, at), touched, "owner" if name == "postings" else "doc_id").unionByName(new[name]) for name in new}
        everyone = resolved(old["offers"].join(touched, "doc_id", "left_anti").unionByName(new["offers"]))
        again = (old["chunks"] if first else self.tables.read("chunks", reached, at)).join(others.select("chunk_id"), "chunk_id", "left_semi").join(touched, "doc_id", "left_anti")
        edges = links.inside(held, heads).unionByName(cited(held.unionByName(again.select(held.columns)), everyone))
        if not first:
            before = self.kept(self.tables.read("edges", reached, at), touched, "src_doc")
            stay = before.join(others.select(F.col("chunk_id").alias("src"), F.lit("doc").alias("kind")), ["src", "kind"], "left_anti")
            edges = edges.unionByName(stay.select(edges.columns))
        return self.tables.publish({name: (df, buckets) for name, df in fresh.items()} | {"edges": (edges, reached)}, at)

    @staticmethod
    def kept(df: DataFrame, touched: DataFrame, key: str) -> DataFrame:
        return df.join(touched.withColumnRenamed("doc_id", key), key, "left_anti").select(df.columns)
