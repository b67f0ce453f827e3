"""Which documents a text cites, by name or by identifier.

``directory`` lists what can be cited: (key, kind, doc_id), kind ``name`` (several words, any case),
``proper`` (one word, exact case) or ``ident``. ``find`` gives every citation of a chunk once per cited
document, with the reference as written.

Up to BROADCAST names a word trie goes to all tasks and every text is walked once. Beyond, each name is
keyed by the pair of neighbouring words that the fewest names have, texts are joined on their word pairs,
and a text is walked with a trie of the few names that may stand in it: "history of ..." does not gather all
names that begin so. Both ways choose alike: of names that start at one place the longest, from left to
right, without overlap; names and proper words are chosen separately, an own name is no candidate, and a name
labels its document before an identifier does.

Defined results: null texts cite nothing; a key that several documents offer belongs to the smallest id,
an identifier that several first pages carry belongs to none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import aliases, links

#: Names in a broadcast trie (some 100 bytes each), and the words that a text is cut into.
BROADCAST = 300_000
WORD = re.compile(r"\w+")
FOUND = "chunk_id bigint, src_doc bigint, dst_doc bigint, label string"


def directory(docs: DataFrame) -> DataFrame:
    """docs(doc_id, title, path, head) -> key, kind, doc_id."""
    named = aliases.names(docs).select(F.col("alias").alias("key"), F.when(F.col("exact"), "proper").otherwise("name").alias("kind"), "doc_id")
    heads = docs.select("doc_id", F.concat_ws("\n", "title", "head").alias("front"))
    claims = heads.select("doc_id", F.explode(links.identifiers("front")).alias("key")).distinct()
    sole = claims.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
    return named.unionByName(sole.select("key", F.lit("ident").alias("kind"), "doc_id"))


class Names:
    """Tries of words, one for names (folded) and one for proper words (as written)."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.tries: dict[str, dict] = {"name": {}, "proper": {}}
        self.patterns: dict[str, re.Pattern] = {}
        for key, kind, doc in rows:
            if words := WORD.findall(key):
                at = self.tries[kind]
                for w in words:
                    at = at.setdefault(w, {})
                at.setdefault("", []).append((key, doc))  # no word is empty

    def pattern(self, key: str, kind: str) -> tuple[re.Pattern, int]:
        """The key with any white space between its words, and how much of it stands before its first word."""
        if (kind, key) not in self.patterns:
            body = r"\s+".join(re.escape(p) for p in key.split(" "))
            self.patterns[kind, key] = re.compile(rf"(?<!\w){body}(?!\w)", re.I if kind == "name" else 0), WORD.search(key).start()
        return self.patterns[kind, key]

    def chosen(self, text: str, kind: str, own: int) -> Iterator[tuple[int, str]]:
        trie, fold = self.tries[kind], kind == "name"
        if not trie:
            return
        tokens = [(m.start(), m.group().lower() if fold else m.group()) for m in WORD.finditer(text)]
        until = 0
        for i, (start, _) in enumerate(tokens):
            at, offered = trie, []
            for _, word in tokens[i:]:
                if (at := at.get(word)) is None:
                    break
                offered += [c for c in at.get("", ()) if c[1] != own]
            for key, doc in sorted(offered, key=lambda c: -len(c[0])):
                pattern, lead = self.pattern(key, kind)
                m = pattern.match(text, start - lead) if start - lead >= until else None
                if m and (not fold or " ".join(m.group().split()).lower() == key):
                    yield doc, m.group()
                    until = m.end()
                    break

    def cited(self, text: str, own: int) -> dict[int, str]:
        found: dict[int, str] = {}
        for kind in ("name", "proper"):
            for doc, label in self.chosen(text, kind, own):
                found.setdefault(doc, label)
        return found


def anchored(names: DataFrame) -> DataFrame:
    """key, kind, doc_id, anchor: the rarest pair of neighbouring words of a name (its word, if it has one)."""
    w = F.regexp_extract_all(F.lower("key"), F.lit("(?U)\\w+"), F.lit(0))
    held = names.select("key", "kind", "doc_id", w.alias("w"))
    each = held.select("key", "kind", "doc_id", F.explode(F.array_distinct(_pairs("w"))).alias("anchor"))
    n = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("key", "kind").orderBy("n", "anchor"))
    return each.join(n, "anchor").withColumn("r", first).filter("r = 1").select("key", "kind", "doc_id", "anchor")


def _pairs(words: str) -> F.Column:
    two = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, 2), " "))
    return F.when(F.size(words) == 1, F.col(words)).when(F.size(words) > 1, two)


def find(chunks: DataFrame, keys: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """chunks(chunk_id, doc_id, text), keys of ``directory`` -> chunk_id, src_doc, dst_doc, label."""
    names = keys.filter("kind <> 'ident'").select("key", "kind", "doc_id")
    some = names.limit(limit + 1).toPandas()  # no more than limit + 1 rows
    if len(some) <= limit:
        spoken = _walk(chunks, list(some.itertuples(index=False, name=None)))
    else:
        spoken = _joined(chunks, names)
    idents = keys.filter("kind = 'ident'").select(F.col("key").alias("ident"), F.col("doc_id").alias("dst_doc"))
    each = chunks.select("chunk_id", F.col("doc_id").alias("src_doc"), F.explode(links.identifiers("text")).alias("ident"))
    label = F.regexp_replace("ident", "^[a-z]+:", "")
    coded = each.join(idents, "ident").filter("src_doc <> dst_doc").groupBy("chunk_id", "src_doc", "dst_doc").agg(F.min(label).alias("label"))
    both = spoken.withColumn("way", F.lit(0)).unionByName(coded.withColumn("way", F.lit(1)))
    best = both.groupBy("chunk_id", "src_doc", "dst_doc").agg(F.min(F.struct("way", "label")).alias("x"))
    return best.select("chunk_id", "src_doc", "dst_doc", F.col("x.label").alias("label"))


def _rows(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["chunk_id", "src_doc", "dst_doc", "label"])


def _walk(chunks: DataFrame, rows: list[tuple]) -> DataFrame:
    sent = chunks.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(sent.value)
        for pdf in batches:
            yield _rows([(c, d, doc, label) for c, d, text in pdf.itertuples(index=False, name=None) if text for doc, label in names.cited(text, d).items()])

    return chunks.select("chunk_id", "doc_id", "text").mapInPandas(run, FOUND)


def _joined(chunks: DataFrame, names: DataFrame) -> DataFrame:
    w = F.regexp_extract_all(F.lower("text"), F.lit("(?U)\\w+"), F.lit(0))
    cut = chunks.select("chunk_id", w.alias("w"))
    there = cut.select("chunk_id", F.explode(F.array_distinct(F.concat("w", F.coalesce(F.when(F.size("w") > 1, _pairs("w")), F.array().cast("array<string>"))))).alias("anchor"))
    may = there.join(anchored(names), "anchor").groupBy("chunk_id").agg(F.collect_list(F.struct("key", "kind", "doc_id")).alias("names"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for chunk, own, text, some in pdf.itertuples(index=False, name=None):
                names = Names([(n["key"], n["kind"], n["doc_id"]) for n in some])
                out += [(chunk, own, doc, label) for doc, label in names.cited(text, own).items()]
            yield _rows(out)

    return chunks.join(may, "chunk_id").select("chunk_id", "doc_id", "text", "names").mapInPandas(run, FOUND)
