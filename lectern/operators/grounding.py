"""Sentence-level verification of answers against numbered passages, and refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

MARK = "\\[([0-9]{1,2})\\]"
# A note that the sources lack the answer, English and Italian. Not, then within 60 characters a word for being
# listed, within 20 more a preposition and the sources, and nothing after them: "not found in the source code" is a claim.
NOT = "(?:not|no|non|nessun\\w*|senza)"
LISTED = "(?:listed|mentioned|stated|specified|provided|found|elencat\\w*|menzionat\\w*|riportat\\w*|indicat\\w*|specificat\\w*|fornit\\w*|trovat\\w*)"
IN = "(?:in|nei|nel|nelle|nello|nella|from)\\s+(?:(?:the|these|this|those|i|le|questi|queste|gli)\\s+)?(?:(?:provided|given|available|forniti|fornite|disponibili)\\s+)?"
SOURCES = "(?:passages?|documents?|sources?|context|passagg\\w*|documenti|fonti|contesto)(?:\\s+(?:provided|given|above|forniti|fornite))?"
ABSENT = f"(?iU)\\b{NOT}\\b[^.;]{{0,60}}?\\b{LISTED}\\b[^.;]{{0,20}}?\\b{IN}{SOURCES}\\W*$"
LACKS, NUMBER, UNSUPPORTED = "says the sources lack the answer", "number not in the sources", "not supported by the sources"


def citations(text: Column) -> Column:
    """Declared passage numbers in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MARK), F.lit(1)), lambda x: x.cast("int")))


def body(sentence: Column) -> Column:
    """The sentence without citation marks, blanks before punctuation, bullets and dashes."""
    bare = F.regexp_replace(F.regexp_replace(sentence, MARK, ""), "\\s+(?=[.,;:!?])", "")
    return F.regexp_replace(bare, "^[\\s*•\\-–—]+|[\\s*•\\-–—]+$", "")


def check(answers: DataFrame, passages: DataFrame, min_support: float = 0.2) -> DataFrame:
    """answers(qid, answer), passages(qid, n, text) -> qid, sent, text, cites, support, reason: one row
    per sentence with a word; ``reason`` is null for claims that stand. A sentence meets the passages
    of its own question only (an equi-join on qid)."""
    rows = answers.select("qid", F.posexplode(T.claim_sentences("answer")).alias("sent", "s")).select("qid", "sent", body(F.col("s")).alias("text"), citations(F.col("s")).alias("declared"))
    rows = rows.filter(F.length(F.regexp_replace("text", "[^\\p{L}\\p{N}_]", "")) >= 2)
    rows = rows.select("*", T.content_terms("text").alias("terms"), T.numbers("text").alias("nums"), F.rlike("text", F.lit(ABSENT)).alias("absent"))
    held = passages.select("qid", "n", T.content_terms("text").alias("p_terms"), T.numbers("text").alias("p_nums"))
    pairs = rows.join(held, "qid", "left").withColumn("cov", T.coverage(F.col("terms"), F.col("p_terms")))
    place = F.array_position("declared", F.col("n"))
    fits = (F.col("cov") >= min_support) & (F.size(F.array_except("nums", "p_nums")) == 0)
    seen = F.struct(F.when(place > 0, place).otherwise(1000 + F.col("n")).alias("order"), F.col("n").alias("n"), F.round("cov", 2).alias("cov"))
    found = pairs.groupBy("qid", "sent", "text", "absent", F.size("nums").alias("n_nums")).agg(
        F.sort_array(F.collect_list(F.when(fits & F.col("n").isNotNull(), seen))).alias("fit"), F.max("cov").alias("best")
    )
    mine = F.filter("fit", lambda x: x["order"] < 1000)
    cites = F.when(F.size(mine) > 0, F.transform(mine, lambda x: x["n"])).otherwise(F.transform(F.slice("fit", 1, 1), lambda x: x["n"]))
    reason = (
        F.when(F.col("absent"), LACKS)
        .when(F.size("fit") > 0, F.lit(None))
        .when((F.col("n_nums") > 0) & (F.col("best") >= min_support), NUMBER)
        .otherwise(UNSUPPORTED)
    )
    out = found.select("qid", "sent", "text", cites.alias("cites"), F.get("fit", F.lit(0))["cov"].alias("support"), reason.alias("reason"))
    stands = F.col("reason").isNull()
    return out.select("qid", "sent", "text", F.when(stands, F.col("cites")).alias("cites"), F.when(stands, F.col("support")).alias("support"), "reason")


def render(claims: DataFrame) -> DataFrame:
    """qid, answer: claims that stand, their citations before the final punctuation."""
    marks = F.array_join(F.transform("cites", lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))), "")
    end = F.regexp_extract("text", "[.!?]*$", 0)
    text = F.concat(F.expr("substring(text, 1, length(text) - length(regexp_extract(text, '[.!?]*$', 0)))"), F.lit(" "), marks, end)
    kept = claims.filter("reason IS NULL").select("qid", "sent", text.alias("t"))
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent", "t"))), lambda x: x["t"]), " ").alias("answer"))


def best_evidence(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, sent, evidence: of the first cited passage the sentence that shares most terms, then the
    one nearest to 160 characters."""
    first = claims.filter("reason IS NULL").select("qid", "sent", "text", F.get("cites", F.lit(0)).alias("n"))
    parts = passages.select("qid", "n", F.explode(T.claim_sentences("text")).alias("s"))
    score = F.struct(T.coverage(T.content_terms("text"), T.content_terms("s")).alias("c"), (-F.abs(F.length("s") - 160)).alias("l"), F.col("s").alias("s"))
    return first.join(parts, ["qid", "n"]).groupBy("qid", "sent").agg(F.substring(F.max(score)["s"], 1, 400).alias("evidence"))


def relevant(questions: DataFrame, contexts: DataFrame, least: float) -> DataFrame:
    """questions(qid), contexts(qid, score, via) -> qid, ok: the best score of a question's own contexts (those that links added do not
    count) reaches the gate. A question without contexts has a row and does not pass."""
    best = contexts.filter("coalesce(via, '') = ''").groupBy("qid").agg(F.max("score").alias("best"))
    return questions.select("qid").distinct().join(best, "qid", "left").select("qid", F.coalesce(F.col("best") >= least, F.lit(False)).alias("ok"))
