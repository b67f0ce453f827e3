"""Text primitives as column expressions, shared by all operators. All JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic, English and Italian.
STOPWORDS = tuple(
    """the a an and or of to in on at for with by is are was were be been it its this that these those as from
    how what who whom which when where why do does did not no yes can could should would will
    il lo la i gli le un uno una e ed o di da del della dei delle degli al allo alla ai alle
    in con su per tra fra che chi cui come dove quando perché non si sono è era ho ha hanno""".split()
)
# Words about the sources themselves, which say nothing on a claim.
META = tuple(
    """context passage passages document documents answer answers according provided mentioned stated
    states state based given text information source sources paragraph section question contesto
    passaggio documento documenti risposta secondo fornito indicato testo fonte fonti domanda""".split()
)
# Words that tell Italian from English.
ITALIAN = tuple(
    """il lo la gli le un una di del della che come quando dove quanto quale quali chi perché
    non sono è era ha hanno fu nel nella dei delle con per""".split()
)


def _accents() -> tuple[str, str]:
    """Lower-case letters of Latin-1 and Latin Extended-A with a plain ASCII base."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(text) -> Column:
    """Lower-case, diacritics removed."""
    return F.translate(F.lower(_col(text)), ACCENTED, PLAIN)


def index_tokens(text) -> Column:
    """Tokens of the inverted index: folded alphanumeric runs, one letter and stopwords included."""
    return F.regexp_extract_all(fold(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def terms(text) -> Column:
    """Lower-case words of two or more characters without stopwords, unless nothing else is there."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))
    content = F.filter(words, lambda w: ~w.isin(*STOPWORDS))
    return F.when(F.size(content) > 0, content).otherwise(words)


def words(text) -> Column:
    return F.array_remove(F.split(F.trim(_col(text)), "\\s+"), "")


def lead(text, n: int) -> Column:
    """The first n words, with a mark where more followed."""
    w = words(text)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(" ..."))).otherwise(F.array_join(w, " "))


def norm_key(text) -> Column:
    """Equal for texts that differ in case and white space only."""
    return F.lower(F.trim(F.regexp_replace(_col(text), "\\s+", " ")))


def chunk_sentences(text) -> Column:
    return F.split(_col(text), "(?<=[.!?])\\s+")


def claim_sentences(text) -> Column:
    """After . ! ? before an upper-case letter or digit (a quote or bracket may open), and at newlines."""
    parts = F.split(_col(text), "(?<=[.!?])\\s+(?=[\"'(\\[]?[\\p{Lu}0-9])|\\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def stem(word: Column) -> Column:
    """A final vowel of long words goes, then a final s."""
    first = F.when(F.length(word) > 5, F.regexp_replace(word, "[aeio]$", "")).otherwise(word)
    return F.when(F.length(first) > 4, F.regexp_replace(first, "s$", "")).otherwise(first)


def content_terms(text) -> Column:
    """Terms that a claim and its passage are compared by: 3 or more characters, no stopword, no word
    about sources, no number; folded and stemmed, citation marks removed."""
    bare = F.regexp_replace(F.lower(_col(text)), "\\[[0-9]{1,2}\\]", " ")
    found = F.regexp_extract_all(bare, F.lit("[\\p{L}\\p{N}_]{3,}"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*STOPWORDS, *META) & ~F.rlike(w, F.lit("^[0-9]+$")))
    return F.array_distinct(F.transform(kept, lambda w: stem(F.translate(w, ACCENTED, PLAIN))))


def numbers(text) -> Column:
    """Numbers in one form: no thousands separators, a point for a decimal comma, no trailing zeros."""
    t = F.regexp_replace(_col(text), "\\[[0-9]{1,2}\\]", " ")
    t = F.regexp_replace(t, "(?<=[0-9])[,.\\s\u00a0\u202f](?=[0-9]{3}(?![0-9]))", "")
    t = F.regexp_replace(t, "(?<=[0-9]),(?=[0-9]{1,2}(?![0-9]))", ".")
    found = F.regexp_extract_all(t, F.lit("[0-9]+(?:\\.[0-9]+)?"), F.lit(0))
    short = lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, "\\.?0+$", "")).otherwise(x)
    return F.array_sort(F.array_distinct(F.transform(found, short)))


def coverage(claim: Column, passage: Column) -> Column:
    """Share of the claim's terms in the passage; 1 without terms."""
    return F.when(F.size(claim) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(claim, passage)).cast("double") / F.size(claim))


def italian(text) -> Column:
    w = F.regexp_extract_all(F.lower(_col(text)), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    return F.size(F.filter(w, lambda x: x.isin(*ITALIAN))) >= F.greatest(F.lit(1), F.floor(F.size(w) / 8))
