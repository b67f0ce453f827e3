"""The search path over a corpus: shortlist of documents, three rankings, fusion, reranking, links, context.

Terms and vectors are made row by row, without a shuffle. A question's shortlist bounds what the scoped
rankings compare: its chunks are joined by document, so no scoped ranking meets all chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import context, rerank, retrieval, scopes
from lectern.shared import written

# Hits of a ranking, the weight of the section ranking, chunks that are reranked.
POOL, SECTION_WEIGHT, RERANKED = 40, 0.5, 30
# Hits that links are followed from, passages that links may add and, of a cited document, offer; the share of a
# context kept for them.
SEEDS, LINKED, BEST, SHARE = 3, 3, 3, 4


@dataclass
class Corpus:
    """chunks: chunk_id, doc_id, section_id, text; cards: doc_id, text; sections: section_id, doc_id, text (their cards)."""

    chunks: DataFrame
    cards: DataFrame
    sections: DataFrame

    def prepare(self, questions: DataFrame) -> Prepared:
        """Tables that several steps read: vectors, and the scores of all chunks with a term of a question."""
        texts = self.chunks.select(F.col("chunk_id").alias("doc_id"), "text")
        members = self.chunks.select(F.col("chunk_id").alias("doc_id"), F.col("doc_id").alias("owner"), "section_id")
        asked = written(retrieval.hash_vectors(questions, "qid"), "asked")
        return Prepared(self, questions, members, written(retrieval.hash_vectors(texts), "vectors"), asked, written(retrieval.bm25_scores(questions, texts), "scores"))


@dataclass
class Prepared:
    corpus: Corpus
    questions: DataFrame
    cut: DataFrame
    vectors: DataFrame
    asked: DataFrame
    scores: DataFrame

    def cosines(self, pairs: DataFrame, vectors: DataFrame) -> DataFrame:
        """pairs(qid, doc_id) -> qid, doc_id, score of pairs with a common bucket."""
        maps = self.asked.select("qid", F.map_from_entries("v").alias("q"))
        met = F.filter(F.transform("v", lambda e: F.try_element_at("q", e["bucket"]) * e["weight"]), lambda x: x.isNotNull())
        both = pairs.join(vectors, "doc_id").join(maps, "qid").select("qid", "doc_id", met.alias("m")).filter("size(m) > 0")
        return both.select("qid", "doc_id", F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 6).alias("score"))

    def best(self, pairs: DataFrame, keys: list[str], n: int, pool: int = POOL) -> DataFrame:
        """The n best chunks of each group of pairs(keys, doc_id): BM25 and vectors fused."""
        ranked = []
        for scored in (self.scores.join(pairs, ["qid", "doc_id"]), self.cosines(pairs, self.vectors).join(pairs, ["qid", "doc_id"])):
            ranked.append(scopes.first_by(scored, keys, [F.desc("score"), "doc_id"], pool).select(*keys, "doc_id", (1.0 / (F.col("rank") + retrieval.RRF)).alias("w")))
        fused = ranked[0].unionByName(ranked[1]).groupBy(*keys, "doc_id").agg(F.round(F.sum("w"), 9).alias("score"))
        return scopes.first_by(fused, keys, [F.desc("score"), "doc_id"], n)

    def scope(self) -> DataFrame:
        """qid, owner: documents to search in."""
        owners = self.cut.select("doc_id", "owner")
        flat = self.asked.select("qid", F.explode("v").alias("e")).select("qid", "e.*")
        near = retrieval.dense(flat, retrieval.hash_vectors(self.corpus.cards), scopes.CARDS).select("qid", "doc_id", "score")
        found = retrieval.top(self.scores, "doc_id", POOL).join(owners, "doc_id").select("qid", F.col("owner").alias("doc_id"), "rank")
        return scopes.shortlist(self.corpus.cards.select("doc_id"), near, found).withColumnRenamed("doc_id", "owner")

    def search(self, k: int = 8, scorer: rerank.Scorer = rerank.overlap) -> DataFrame:
        """qid, rank, chunk_id, doc_id, section_id, score, text."""
        scope = written(self.scope(), "scope")
        pairs = scope.join(self.cut.select("doc_id", "owner"), "owner").select("qid", "doc_id")
        lexical = retrieval.top(self.scores.join(pairs, ["qid", "doc_id"]), "doc_id", POOL)
        dense = retrieval.top(self.cosines(pairs, self.vectors), "doc_id", POOL)
        places = self.corpus.sections.select(F.col("section_id").alias("doc_id"), F.col("doc_id").alias("owner"), "text")
        sections = self.cosines(scope.join(places.select("doc_id", "owner"), "owner").select("qid", "doc_id"), retrieval.hash_vectors(places))
        members = self.cut.select(F.col("doc_id").alias("chunk_id"), "section_id")
        expanded = scopes.section_chunks_ranked(sections.withColumnRenamed("doc_id", "section_id"), members).withColumnRenamed("chunk_id", "doc_id")
        fused = retrieval.fuse((dense, 1.0), (lexical, 1.0), (expanded, SECTION_WEIGHT)).filter(F.col("rank") <= max(k, RERANKED))
        pool = written(self.with_texts(fused.select("qid", F.col("doc_id").alias("chunk_id"), F.col("rank").alias("at"))), "pool")
        scored = pool.join(rerank.rerank(pool.withColumnRenamed("chunk_id", "id"), scorer).withColumnRenamed("id", "chunk_id"), ["qid", "chunk_id"])
        return self.different(scored, ["at"], k)

    def with_texts(self, found: DataFrame) -> DataFrame:
        """found(qid, chunk_id, ..) with the question and the chunk."""
        return found.join(self.corpus.chunks, "chunk_id").join(self.questions.select("qid", F.col("text").alias("question")), "qid")

    @staticmethod
    def different(scored: DataFrame, then: list[str], k: int, *more: str) -> DataFrame:
        """The first k of each question by score; of equal texts (case and white space aside) the first."""
        order = [F.desc("score"), *then]
        first = scopes.first_by(scored.withColumn("key", F.xxhash64(T.norm_key("text"))), ["qid", "key"], order, 1, "r").drop("r")
        kept = scopes.first_by(first, ["qid"], order, k)
        return kept.select("qid", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "doc_id", "section_id", "score", "text", *more)

    def linked(self, hits: DataFrame, edges: DataFrame, scorer: rerank.Scorer = rerank.overlap, least: float = 0.0) -> DataFrame:
        """hits of ``search``, edges(src, dst_doc, dst, label; dst null for a whole document) -> qid, rank, chunk_id, doc_id, section_id,
        score, text, seed, via. One hop from the first hits: chunks they cite, the best chunks of documents they cite, chunks
        that cite them; never a hit, only what the scorer finds relevant to the question. ``via`` holds ``{n}`` for the number of
        the seed's source."""
        seeds = hits.filter(F.col("rank") <= SEEDS).select("qid", F.col("rank").alias("at"), F.col("chunk_id").alias("seed"))
        out = seeds.join(edges.withColumnRenamed("src", "seed"), "seed").withColumn("via", F.format_string('cited as "%s" in [{n}]', "label"))
        into = seeds.join(edges.filter("dst IS NOT NULL").select(F.col("dst").alias("seed"), "src", "label"), "seed")
        into = into.select("qid", "at", "seed", F.lit(1).alias("way"), F.col("src").alias("chunk_id"), F.format_string('cites [{n}] as "%s"', "label").alias("via"))
        direct = out.filter("dst IS NOT NULL").select("qid", "at", "seed", F.lit(0).alias("way"), F.col("dst").alias("chunk_id"), "via")
        whole = scopes.first_by(out.filter("dst IS NULL"), ["qid", "dst_doc"], ["at", "via"], 1, "r")
        whole = scopes.first_by(whole, ["qid"], ["at", "dst_doc"], LINKED, "r").select("qid", "at", "seed", "via", F.col("dst_doc").alias("owner"))
        inside = self.best(whole.select("qid", "owner").join(self.cut.select("doc_id", "owner"), "owner"), ["qid", "owner"], BEST)
        cited = whole.join(inside.select("qid", "owner", F.col("doc_id").alias("chunk_id")), ["qid", "owner"]).select("qid", "at", "seed", F.lit(2).alias("way"), "chunk_id", "via")
        new = direct.unionByName(into).unionByName(cited).join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
        first = scopes.first_by(new, ["qid", "chunk_id"], ["way", "at", "via"], 1, "r").drop("r")
        pool = written(self.with_texts(first), "linked")
        scored = pool.join(rerank.rerank(pool.withColumnRenamed("chunk_id", "id"), scorer).withColumnRenamed("id", "chunk_id"), ["qid", "chunk_id"])
        able = scopes.first_by(scored.filter(F.col("score") >= least), ["qid"], [F.desc("score"), "way", "at", "chunk_id"], 2 * LINKED, "r").drop("r")
        return self.different(able, ["way", "at", "chunk_id"], LINKED, "seed", "via")


def contexts(hits: DataFrame, linked: DataFrame, sections: DataFrame, budget: int = context.BUDGET) -> DataFrame:
    """hits of ``search``, linked, sections(section_id, full) -> qid, n, section_id, chunk_id, whole, score, text, via.

    Sections of hits come first, within the budget less what linked passages may claim (their length, up to 1/SHARE); these
    follow with what is left, if the source that led to them is shown, they are not in a shown section's text and enough room is
    left. Both queues are folds over a handful of rows a question."""
    size = lambda c: F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x["text"])), F.lit(0))
    home = hits.select("qid", F.col("chunk_id").alias("seed"), F.col("section_id").alias("home"))
    queue = linked.join(home, ["qid", "seed"]).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "section_id", "home", "score", "text", "via"))).alias("l"))
    both = context.grouped(hits, sections).join(queue, "qid", "left")
    reserve = F.least(size("l"), F.lit(budget // SHARE))
    main = both.select("qid", "l", reserve.alias("reserve"), context.shown("g", F.lit(budget) - reserve).alias("m"))
    row = "struct<section_id:bigint,chunk_id:bigint,score:double,text:string,via:string>"
    state = f"struct<left:int,out:array<{row}>>"
    start = F.struct((F.col("m.left") + F.col("reserve")).alias("left"), F.array().cast(f"array<{row}>").alias("out")).cast(state)

    def step(a, x):
        n = F.array_position(F.transform("m.out", lambda o: o["section_id"]), x["home"].cast("bigint"))
        there = F.exists("m.out", lambda o: (o["section_id"] == x["section_id"]) & F.contains(o["text"], x["text"]))
        fits = (n > 0) & (a["left"] >= F.least(F.lit(context.LEAST), F.length(x["text"]))) & ~there
        text = F.substring(x["text"], F.lit(1), F.greatest(a["left"], F.lit(0)))
        one = F.struct(x["section_id"].cast("bigint").alias("section_id"), x["chunk_id"].cast("bigint").alias("chunk_id"), x["score"].cast("double").alias("score"), text.alias("text"), F.replace(x["via"], F.lit("{n}"), n.cast("string")).alias("via"))
        return F.when(fits, F.struct((a["left"] - F.length(text)).alias("left"), F.concat(a["out"], F.array(one)).alias("out")).cast(state)).otherwise(a)

    extra = F.coalesce(F.aggregate("l", start, step, lambda a: a["out"]), F.array().cast(f"array<{row}>"))
    shown = F.transform("m.out", lambda o: F.struct(o["section_id"].alias("section_id"), F.lit(None).cast("bigint").alias("chunk_id"), o["whole"].alias("whole"), o["score"].alias("score"), o["text"].alias("text"), F.lit("").alias("via")))
    added = F.transform(extra, lambda o: F.struct(o["section_id"].alias("section_id"), o["chunk_id"].alias("chunk_id"), F.lit(False).alias("whole"), o["score"].alias("score"), o["text"].alias("text"), o["via"].alias("via")))
    return main.select("qid", F.posexplode(F.concat(shown, added)).alias("i", "c")).select("qid", (F.col("i") + 1).cast("bigint").alias("n"), "c.*")
