"""Masking of personal data: labelled spans of a text, and stable placeholders in their place.

Detectors for EMAIL, TELEPHONENUM, IBAN, CREDITCARDNUMBER and IP; names and addresses need a model."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.shared import written

# The detectors' patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")
PHONES = (
    re.compile(r"\+(?:\([0-9]|[0-9])(?:[ ().-]*[0-9]){8,14}(?![0-9])"),
    re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
)
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
CARD = re.compile(r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{12,19})(?![0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")


def luhn(digits: str) -> bool:
    doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and luhn(digits)


def iban(value: str) -> bool:
    v = value.replace(" ", "").upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, label of every detection; they may overlap."""
    found, at = [], 0
    for m in DOMAIN.finditer(text):
        s = m.start()
        while s > at and text[s - 1] in LOCAL:
            s -= 1
        if s < m.start():
            found.append((s, m.end(), "EMAIL"))
            at = m.end()
    for p in PHONES:
        found += [(*m.span(), "TELEPHONENUM") for m in p.finditer(text)]
    for m in IBAN.finditer(text):
        # Words may follow in the same form: the longest valid run that ends with a word.
        ends = (e for e in range(m.end(), m.start() + 14, -1) if text[e - 1] != " " and not text[e : e + 1].isalnum())
        e = next((e for e in ends if iban(text[m.start() : e])), None)
        if e:
            found.append((m.start(), e, "IBAN"))
    for m in DIGITS.finditer(text):
        # Other numbers may stand before or after: the whole run, or else cards in their usual groups.
        within = [m.span()] if card(re.sub("[ -]", "", m[0])) else [c.span() for c in CARD.finditer(text, *m.span()) if card(re.sub("[ -]", "", c[0]))]
        found += [(s, e, "CREDITCARDNUMBER") for s, e in within]
    found += [(*m.span(), "IP") for m in IP.finditer(text) if all(int(x) < 256 for x in m[0].split("."))]
    return found


def masked(text: str | None) -> str | None:
    """The text with placeholders, numbered per label by first appearance, case aside; of overlapping
    spans the first, then the longest, stays."""
    if text is None:
        return None
    ids: dict[tuple[str, str], str] = {}
    counts: dict[str, int] = {}
    found = chosen(text)
    for s, e, label in found:
        key = (label, text[s:e].casefold())
        if key not in ids:
            counts[label] = counts.get(label, 0) + 1
            ids[key] = f"[{label}_{counts[label]}]"
    return replaced(text, [(s, e, ids[label, text[s:e].casefold()]) for s, e, label in found])


def chosen(text: str) -> list[tuple[int, int, str]]:
    """Of overlapping spans the first, then the longest."""
    out, pos = [], 0
    for s, e, label in sorted(spans(text), key=lambda x: (x[0], -x[1], x[2])):
        if s >= pos:
            out.append((s, e, label))
            pos = e
    return out


def replaced(text: str, places: list[tuple[int, int, str]]) -> str:
    out, pos = [], 0
    for s, e, new in places:
        out += [text[pos:s], new]
        pos = e
    return "".join(out) + text[pos:]


def mask(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, masked. One row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([masked(t.as_py()) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "masked"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, masked string")


SPANS = "array<struct<s:int,e:int,label:string,value:string>>"


def mask_fields(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fields(doc_id, seq, text): all texts of a document, in the order of ``seq`` (different inside a document). -> (doc_id, seq,
    masked) and counts (doc_id, label, n): the same value has the same placeholder in every field of its document, numbered by its
    first appearance.

    Values are found field by field and numbered by a window over a document's different values; only fields with a value meet the
    placeholders of their document, the others keep their text. A null text stays null."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("label", pa.string()), ("value", pa.string())]))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [[{"s": s, "e": e, "label": label, "value": t[s:e].casefold()} for s, e, label in chosen(t)] if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=["doc_id", "seq", "text", "spans"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, known in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                names = {(k["label"], k["value"]): f"[{k['label']}_{k['n']}]" for k in known}
                out.append(replaced(text, [(x["s"], x["e"], names[x["label"], x["value"]]) for x in spans]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["doc_id", "seq", "masked"])

    rows = fields.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("seq").cast("bigint").alias("seq"), "text")
    held = written(rows.mapInArrow(detect, f"doc_id bigint, seq bigint, text string, spans {SPANS}"), "spans")
    each = held.select("doc_id", "seq", F.explode("spans").alias("x")).select("doc_id", "seq", "x.*")
    first = each.groupBy("doc_id", "label", "value").agg(F.min(F.struct("seq", "s")).alias("at"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("at")))
    known = numbered.groupBy("doc_id").agg(F.collect_list(F.struct("label", "value", "n")).alias("known"))  # a document's values
    filled = held.filter("size(spans) > 0").join(known, "doc_id").select("doc_id", "seq", "text", "spans", "known").mapInArrow(fill, "doc_id bigint, seq bigint, masked string")
    plain = held.filter("size(spans) = 0").select("doc_id", "seq", F.col("text").alias("masked"))
    return plain.unionByName(filled), numbered.groupBy("doc_id", "label").agg(F.max("n").cast("bigint").alias("n"))


def mask_sections(sections: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sections(doc_id, section_id, ordinal, title, path, summary), chunks(doc_id, chunk_id, section_id, ordinal, text, ctx) -> both
    masked, sections with their card, and the counts.

    Order of a document's fields: section by section, each chunk's text and what stands before it in ctx, then title, path and
    summary. A ctx that ends in the chunk's text is rebuilt of its two masked parts, so text and ctx agree."""
    ordinal = sections.select("section_id", F.col("ordinal").alias("place"))
    before = F.when(F.col("ctx") == F.col("text"), "").otherwise(F.left("ctx", F.length("ctx") - F.length("text") - 1))
    parts = F.posexplode(F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("t")), F.struct(F.lit("before").alias("field"), before.alias("t"))))
    inner = chunks.join(ordinal, "section_id").select("doc_id", "place", F.lit(0).alias("of"), F.col("ordinal").alias("i"), parts.alias("j", "x"), F.col("chunk_id").alias("id"))
    named = F.posexplode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("t")) for c in ("title", "path", "summary"))))
    outer = sections.select("doc_id", F.col("ordinal").alias("place"), F.lit(1).alias("of"), F.lit(0).alias("i"), named.alias("j", "x"), F.col("section_id").alias("id"))
    order = Window.partitionBy("doc_id").orderBy("place", "of", "i", "id", "j")
    every = inner.unionByName(outer).select("*", F.row_number().over(order).alias("seq"))
    every = written(every.select("doc_id", "seq", "of", "id", F.col("x.field").alias("field"), F.col("x.t").alias("text")), "fields")
    masked, counts = mask_fields(every)
    done = every.select("doc_id", "seq", "of", "id", "field").join(masked, ["doc_id", "seq"])
    back = lambda of, key, names: done.filter(F.col("of") == of).groupBy(F.col("id").alias(key)).pivot("field", names).agg(F.first("masked"))
    heads = sections.drop("title", "path", "summary").join(back(1, "section_id", ["title", "path", "summary"]), "section_id")
    texts = chunks.drop("text", "ctx").join(back(0, "chunk_id", ["text", "before"]), "chunk_id")
    ctx = F.when(F.col("before") == "", F.col("text")).otherwise(F.concat_ws("\n", "before", "text"))
    return heads.withColumn("card", F.concat_ws("\n", "path", "summary")), texts.withColumn("ctx", ctx).drop("before"), counts
