"""The explicit reference graph: captions, references inside a document, identifiers, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of references and captions, English and Italian.
REFERENCE = "(?iU)\\b(fig(?:ure|ura)?|tab(?:le|ella)?)\\.?\\s*([0-9]{1,3}[a-z]?)\\b"
CAPTION = "(?imU)^\\W*(fig(?:ure|ura)?|tab(?:le|ella)?)\\.?\\s*([0-9]{1,3}[a-z]?)\\b"
ARXIV = "(?i)arxiv[:\\s]*([0-9]{4}\\.[0-9]{4,5})"
DOI = "(?i)\\b(10\\.[0-9]{4,9}/[^\\s\"<>]+?)(?=[.,;)\\]]*(?:\\s|$))"
# Words before an act's number, and an act by its date ("30 giugno 2003, n. 196").
ACT_WORDS = "legge|l\\.|d\\.?\\s?lgs\\.?|decreto|d\\.?p\\.?r\\.?|regolamento|direttiva|reg\\.|dir\\.|n\\.|n°|nr\\.?|no\\."
ACT_NUMBER = f"(?iU)\\b(?:{ACT_WORDS})\\s*(?:\\((?:ue|ce|cee|eu|ec)\\)\\s*)?(?:n\\.?\\s*)?([0-9]{{1,4}}\\s*/\\s*[0-9]{{2,4}})"
ACT_DATE = "(?iU)\\b[0-9]{1,2}\\s+[a-zà-ù]+\\s+((?:19|20)[0-9]{2}),?\\s*n\\.?\\s*([0-9]{1,4})"


# Words before a section's number, its number or letter, and the family that words belong to.
SECTION_WORDS = "sections?|sec\\.|sezion[ei]|paragraph|paragrafo|chapter|capitolo|cap\\.|appendix|appendice|allegato|annex|art(?:icolo|icle|\\.)?"
SECTION_NUMBER = "[0-9]{1,3}(?:\\.[0-9]{1,3}){0,3}"
SECTION_REFERENCE = f"(?iU)(?:\\b({SECTION_WORDS})|(§))\\s*({SECTION_NUMBER}|(?-i:[A-Z]))(?!\\w)"
SECTION_HEAD = f"(?iU)^\\s*(?:({SECTION_WORDS})\\s*({SECTION_NUMBER}|(?-i:[A-Z]))|({SECTION_NUMBER}))(?:\\s|[.:)]|$)"
EDGES = ("src", "src_doc", "dst_doc", "dst", "kind", "label")


def found(rows: DataFrame, pattern: str, groups: int) -> DataFrame:
    """rows with one row (pos, m, g1, g2 ..) for each match of ``pattern`` in text; g of a group that is not there is empty."""
    every = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(groups + 1)))
    each = rows.select("*", F.posexplode(every).alias("pos", "x")).drop("text")
    return each.select("*", *(F.col(f"x.g{i}").alias(f"g{i}" if i else "m") for i in range(groups + 1))).drop("x")


def figure_or_table(word: str) -> Column:
    return F.when(F.lower(F.substring(word, 1, 1)) == "f", F.lit("figure")).otherwise(F.lit("table"))


def family(word: str) -> Column:
    w = F.lower(word)
    return F.when(w.startswith("art"), F.lit("art")).when(F.rlike(w, F.lit("^(app|all|ann)")), F.lit("app")).otherwise(F.lit("sec"))


def inside(chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """EDGES inside documents. chunks: chunk_id, doc_id, text, kind, loc; heads: doc_id, ordinal, title, first_chunk of every section.

    "Figure 3" leads to the chunks captioned so and to the images on their pages, "Section 3.2" to the first chunk of the first section
    numbered so. All are joins on equal keys inside a document; a chunk does not lead to itself, and of several references with the same
    ends the last one's wording stays."""
    texts = chunks.select("chunk_id", "doc_id", "text")
    refs = found(texts, REFERENCE, 2).select(F.col("chunk_id").alias("src"), "doc_id", "pos", "m", figure_or_table("g1").alias("kind"), F.lower("g2").alias("num"))
    caps = found(texts, CAPTION, 2).select(F.col("chunk_id").alias("dst"), "doc_id", figure_or_table("g1").alias("kind"), F.lower("g2").alias("num")).distinct()
    captioned = refs.join(caps, ["doc_id", "kind", "num"]).filter("src <> dst").select("src", "doc_id", "pos", "m", "kind", "dst")
    places = chunks.filter("loc <> ''").select(F.col("chunk_id").alias("dst"), "doc_id", "loc")
    images = chunks.filter("kind = 'image' AND loc <> ''").select(F.col("chunk_id").alias("image"), "doc_id", "loc")
    beside = captioned.join(places, ["doc_id", "dst"]).join(images, ["doc_id", "loc"]).filter("src <> image")
    shown = beside.select("src", "doc_id", "pos", "m", "kind", F.col("image").alias("dst"))
    named = found(texts, SECTION_REFERENCE, 3).select(F.col("chunk_id").alias("src"), "doc_id", "pos", "m", family("g1").alias("family"), F.lower("g3").alias("num"))
    number = lambda i: F.regexp_extract("title", SECTION_HEAD, i)
    numbered = heads.select("doc_id", "ordinal", "first_chunk", family(number(1)).alias("family"), F.lower(F.concat(number(2), number(3))).alias("num")).filter("num <> ''")
    first = numbered.groupBy("doc_id", "family", "num").agg(F.min_by("first_chunk", "ordinal").alias("dst"))
    sections = named.join(first, ["doc_id", "family", "num"]).filter("src <> dst").select("src", "doc_id", "pos", "m", F.lit("section").alias("kind"), "dst")
    each = captioned.unionByName(shown).unionByName(sections)
    last = each.groupBy("src", "doc_id", "dst", "kind").agg(F.max_by("m", "pos").alias("label"))
    return last.select("src", F.col("doc_id").alias("src_doc"), F.col("doc_id").alias("dst_doc"), "dst", "kind", "label")


def identifiers(text) -> Column:
    """Works that a text names by identifier, in one form: ``arxiv:``, ``doi:`` and ``act:`` (number/year)."""
    t = F.col(text)
    of = lambda kind, found: F.transform(found, lambda x: F.concat(F.lit(f"{kind}:"), x))
    arxiv = of("arxiv", F.regexp_extract_all(t, F.lit(ARXIV), F.lit(1)))
    doi = of("doi", F.transform(F.regexp_extract_all(t, F.lit(DOI), F.lit(1)), lambda x: F.rtrim(F.lower(x), F.lit("."))))
    numbered = of("act", F.transform(F.regexp_extract_all(t, F.lit(ACT_NUMBER), F.lit(1)), lambda x: F.replace(x, F.lit(" "))))
    dated = F.arrays_zip(F.regexp_extract_all(t, F.lit(ACT_DATE), F.lit(2)).alias("n"), F.regexp_extract_all(t, F.lit(ACT_DATE), F.lit(1)).alias("y"))
    return F.array_distinct(F.concat(arxiv, doi, numbered, of("act", F.transform(dated, lambda x: F.concat(x["n"], F.lit("/"), x["y"])))))


def citations(docs: DataFrame) -> DataFrame:
    """src_doc, dst_doc, ident: an identifier that exactly one document's head claims, found elsewhere."""
    owned = docs.select("doc_id", F.explode(identifiers("head")).alias("ident")).distinct()
    sole = owned.groupBy("ident").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("dst_doc")).filter("n = 1").drop("n")
    cited = docs.select(F.col("doc_id").alias("src_doc"), F.explode(identifiers("text")).alias("ident")).distinct()
    return cited.join(sole, "ident").filter("src_doc <> dst_doc").select("src_doc", "dst_doc", "ident")


def rollup(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_doc", "dst_doc", "kind").agg(F.count(F.lit(1)).alias("n"))


def capped(edges: DataFrame, by: str, most: int = 5) -> DataFrame:
    """At most so many references per direction: a top-k report."""
    order = Window.partitionBy(by).orderBy("kind", "label", "src", "dst")
    return edges.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")
