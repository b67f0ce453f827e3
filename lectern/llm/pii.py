"""Personal data by weak supervision (native: DataFrame functions only).

Candidates come from the contract's four patterns and from looser ones: a phone number without the plus, a
long hexadecimal secret, a bank account, a titled name, a street address. Five labelers vote on each
candidate, of every kind: form (a stricter pattern or a check sum), gazetteer (domain endings, card
prefixes, calling codes, countries, given names, street words), context (key words just before it),
boundary (what touches it) and company (candidates of another kind in the text). They vote for, against
or abstain. Votes are counted by pattern over all documents; expectation-maximisation over these
counts (a bounded number of vote patterns) estimates each labeler's reliability per kind and the
probability that a pattern is personal data. A final logistic span classifier is trained on those
probabilities over the same votes and the candidate's length, and decides on all loose candidates;
candidates of the four base patterns always stay, and loose ones that overlap them are no candidates.

``find`` reads the texts once: candidates are written to the shared folder, and both the counting and the
decision read that table.

Defined results: null and empty texts have no span; repeated rows are answered each; an empty table
gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import let, read, written

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the method's own spans.
LOOSE = ("local_phone", "secret", "account", "name", "address")
EM_STEPS = 25

# The patterns of the contract. Possessive where the next character cannot be given
# back, and (for e-mail and ip) started only at the start of a run or after a match, so that long runs
# take linear time; the matches are the same.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9]){11,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "local_phone": "(?<![0-9A-Za-z+])\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "secret": "(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "account": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": "(?<![\\p{L}0-9])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sra)\\.?\\x20\\p{Lu}\\p{Ll}+(?:\\x20\\p{Lu}\\p{Ll}+)?",
    "address": "(?<![\\p{L}0-9])[0-9]{1,5}\\x20(?:\\p{Lu}\\p{L}+\\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Square)(?!\\p{L})",
}
#: A text without any of these has no candidate; implied by the patterns (tests hold each form to it).
SOME = (
    "@|[0-9]\\.[0-9]|\\+[0-9]|[0-9](?:[ -]?[0-9]){9}|[0-9]{3}\\)[ .-][0-9]{3}[.-][0-9]{4}|[0-9a-f]{32}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"
    "|(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sra)\\.? \\p{Lu}|[0-9] \\p{Lu}\\p{L}+ "
)
#: A text without these has no match; a plain search is much cheaper than the pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
# Gazetteers and context words.
ENDINGS = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|eu|ch|at|example"
CALLING = "1|7|20|27|3[0-9]|4[0-9]|5[0-8]|6[0-6]|8[1246]|9[0-58]"
CONTEXT = {
    "email": "mail|contact|write|address|@",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|payment|pay",
    "phone": "phone|call|tel|mobile|fax|contact",
    "local_phone": "phone|call|tel|mobile|fax|contact",
    "secret": "token|secret|key|password|passwd|pwd|api|bearer",
    "account": "iban|account|konto|bank|compte|cuenta|transfer",
    "name": "contact|name|by|from|dear|author|signed|call|ask",
    "address": "address|at|live[sd]?|office|street|home|ship(?:ped)? to|located",
}
COUNTRIES = "AD|AT|BE|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK"
GIVEN = "Anna|Maria|Peter|Paul|John|James|Mary|Robert|Michael|Linda|David|Susan|Thomas|Laura|Hans|Klaus|Petra|Jean|Pierre|Marie|Claire|Carlos|Jose|Juan|Carmen|Luis|Giulia|Marco"
#: How strictly each kind is written.
FORMS = {
    "email": "^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}$",
    "ip": "^(?:(?:0|[1-9][0-9]{0,2})\\.){3}(?:0|[1-9][0-9]{0,2})$",
    "card": "^(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{3,6}){2,4})$",
    "phone": "^\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,5}\\)[ .-]?)?[0-9]+(?:[ .-][0-9]+)*$",
    "local_phone": "^(?:\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\\1[0-9]{4})$",
    "secret": "^(?:[0-9a-f]{8}){4,8}$",
    "name": "\\x20\\p{Lu}\\p{Ll}+\\x20\\p{Lu}\\p{Ll}+$",
    "address": "^[0-9]{1,4}\\x20",
}
#: What is on a list of its kind, and what says the contrary.
LISTED = {
    "email": f"(?i)\\.(?:{ENDINGS})$",
    "ip": "^(?!(?:0|127|255)\\.)",
    "card": "^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": f"^\\+(?:{CALLING})",
    "local_phone": "^\\(?[2-9]",
    "secret": "^(?=.*[0-9])(?=.*[a-f])(?!.*(.)\\1{4})",
    "account": f"^(?:{COUNTRIES})",
    "name": f"\\x20(?:{GIVEN})",
    "address": "(?:Street|Avenue|Road|Lane|Drive|Boulevard|Square)$",
}
#: Characters before a candidate that the context labeler reads.
BEFORE = 40
VOTERS = ("form", "gazetteer", "context", "boundary", "company")
#: Matches that are placed together, so that long lists are not copied for each of them.
CHUNK = 128


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 0, d).otherwise(doubled(d))))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """What a match of a base pattern must hold besides."""
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda d: (F.length(d) < 3) | ((F.length(d) == 3) & (d <= "255"))))
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & luhn(F.substring(_digits(match), 1, 19))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Leftmost non-overlapping matches with their places: what stands between matches is split off,
    and the running length of both gives the starts. Code points; end exclusive."""
    pattern = F.lit(PATTERNS[kind])
    span = "struct<s:int,e:int,m:string,b:string,c:string>"
    empty = F.array().cast(f"array<{span}>")

    def place(parts: Column, matches: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            between, match = F.get(parts, i), F.get(matches, i)
            after = F.left(F.concat(F.get(parts, i + 1), F.coalesce(F.get(matches, i + 1), F.lit(""))), F.lit(1))
            return let(
                F.struct((a["at"] + F.length(between)).alias("s"), F.length(match).alias("n")),
                lambda p: F.struct(
                    (p["s"] + p["n"]).alias("at"),
                    F.concat(a["out"], F.array(F.struct(p["s"].alias("s"), (p["s"] + p["n"]).alias("e"), match.alias("m"), F.right(between, F.lit(BEFORE)).alias("b"), after.alias("c")))).alias("out"),
                ).cast(f"struct<at:int,out:array<{span}>>"),
            )

        def chunk(a: Column, k: Column) -> Column:
            start = F.struct(a["at"].alias("at"), empty.alias("out")).cast(f"struct<at:int,out:array<{span}>>")
            some = F.sequence(k * CHUNK, F.least((k + 1) * CHUNK, F.size(matches)) - 1)
            return let(F.aggregate(some, start, add), lambda x: F.struct(x["at"].alias("at"), F.concat(a["out"], F.array(x["out"])).alias("out")).cast(f"struct<at:int,out:array<array<{span}>>>"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span}>>").alias("out")).cast(f"struct<at:int,out:array<array<{span}>>>")
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int")), start, chunk, lambda a: F.flatten(a["out"]))

    found = let(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda m: F.when(F.size(m) == 0, empty).otherwise(let(F.split(text, PATTERNS[kind]), lambda p: place(p, m))),
    )
    found = F.filter(found, lambda x: valid(kind, x["m"]))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(empty) if kind in NEEDS else found


def _form(kind: str, match: Column) -> Column:
    if kind != "account":
        return F.rlike(match, F.lit(FORMS[kind]))
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    values = F.transform(F.split(turned, "(?!^)(?!$)"), lambda c: F.ascii(c) - F.when(c.between("0", "9"), F.lit(48)).otherwise(F.lit(55)))
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v < 10, F.lit(10)).otherwise(F.lit(100)) + v) % 97) == 1


def _voted(kind: str, k: int):
    def voted(x: Column) -> Column:
        vote = lambda yes: yes.cast("int")
        touched = F.rlike(F.right(x["b"], F.lit(1)), F.lit("[\\p{L}0-9@/_+-]")) | F.rlike(x["c"], F.lit("[\\p{L}0-9@/_-]"))
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(k).alias("k"),
            x["s"].alias("s"),
            x["e"].alias("e"),
            vote(_form(kind, x["m"])).alias("form"),
            vote(F.rlike(x["m"], F.lit(LISTED[kind]))).alias("gazetteer"),
            vote(F.rlike(x["b"], F.lit(f"(?i)(?:{CONTEXT[kind]})[^A-Za-z]*$"))).alias("context"),
            vote(~touched).alias("boundary"),
            F.lit(-1).alias("company"),
            F.least(F.lit(4), F.floor((x["e"] - x["s"]) / 10)).cast("int").alias("size"),
        )

    return voted


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind,k,s,e,form,gazetteer,context,boundary,company,size>>; the votes are 1, 0
    or, to abstain, -1 (company abstains where a text has candidates of one kind only). One row for each
    input row."""
    # One cheap pass tells the many texts apart that have nothing to find.
    read_ = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind_of = "array<struct<kind:string,k:int,s:int,e:int,form:int,gazetteer:int,context:int,boundary:int,company:int,size:int>>"
    of = [F.transform(_spans(kind, F.col("t")), _voted(kind, k)).cast(kind_of) for k, kind in enumerate(PATTERNS)]
    base, loose = F.concat(*of[: len(KINDS)]), F.concat(*of[len(KINDS) :])
    apart = let(base, lambda b: F.concat(b, F.filter(loose, lambda x: ~F.exists(b, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))))
    company = lambda spans: let(
        F.size(F.array_distinct(F.transform(spans, lambda x: x["k"]))),
        lambda n: F.transform(spans, lambda x: x.withField("company", F.when(n > 1, F.lit(1)).otherwise(F.lit(-1)))),
    )
    return read_.select("doc_id", F.when(F.rlike("t", F.lit(SOME)), let(apart, company)).otherwise(F.array().cast(kind_of)).alias("spans"))


def estimate(counts: list[tuple]) -> dict[tuple, float]:
    """counts: (kind, votes of VOTERS.., size, n) -> probability per (kind, votes.., size).

    EM with two accuracies per kind and labeler (for what is and what is not personal data), then a
    logistic classifier over votes and length fitted to the probabilities. The number of patterns is
    bounded by kinds x 3^labelers x lengths."""
    out: dict[tuple, float] = {}
    width = len(VOTERS)
    for kind in sorted({c[0] for c in counts}):
        rows = [(tuple(c[1 : 1 + width]), c[1 + width], c[2 + width]) for c in counts if c[0] == kind]
        right, prior = {v: [0.8, 0.8] for v in range(width)}, 0.5  # P(vote = truth | truth), for 1 and 0
        prob: dict[tuple, float] = {}
        for _ in range(EM_STEPS):
            for votes, _, _ in rows:
                a, b = math.log(prior), math.log(1 - prior)
                for v, vote in enumerate(votes):
                    if vote >= 0:
                        a += math.log(right[v][0] if vote else 1 - right[v][0])
                        b += math.log(1 - right[v][1] if vote else right[v][1])
                prob[votes] = 1 / (1 + math.exp(max(-50.0, min(50.0, b - a))))
            total = sum(n for _, _, n in rows)
            prior = min(0.99, max(0.01, (sum(prob[v] * n for v, _, n in rows) + 1) / (total + 2)))
            for v in range(width):
                yes = [(prob[x], x[v], n) for x, _, n in rows if x[v] >= 0]
                right[v][0] = (sum(p * n for p, vote, n in yes if vote) + 4) / (sum(p * n for p, _, n in yes) + 5)
                right[v][1] = (sum((1 - p) * n for p, vote, n in yes if not vote) + 4) / (sum((1 - p) * n for p, _, n in yes) + 5)
        total = sum(n for _, _, n in rows)

        def features(votes: tuple, size: int) -> list[float]:
            return [1.0, *(float(2 * v - 1) if v >= 0 else 0.0 for v in votes), size / 4]

        beta = [0.0] * (width + 2)
        for _ in range(300):
            grad = [0.0] * len(beta)
            for votes, size, n in rows:
                x = features(votes, size)
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(b * y for b, y in zip(beta, x, strict=True))))))
                for i in range(len(beta)):
                    grad[i] += (prob[votes] - p) * x[i] * n / total
            beta = [b + g * 1.5 for b, g in zip(beta, grad, strict=True)]
        for votes, size, _ in rows:
            z = sum(b * y for b, y in zip(beta, features(votes, size), strict=True))
            out[kind, *votes, size] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return out


def _weighed(found: DataFrame) -> dict[tuple, float]:
    patterns = (
        found.filter(F.size("spans") > 0)
        .select(F.explode("spans").alias("x"))
        .groupBy("x.kind", *(f"x.{v}" for v in VOTERS), "x.size")
        .count()
        .collect()
    )
    return estimate(sorted(tuple(r) for r in patterns))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, base and spans: array<struct<kind,k,s,e>>, sorted by start, then kind."""
    found = written(candidates(df, id_col, text_col), "pii")
    return decided(found, _weighed(found), threshold)


def decided(found: DataFrame, prob: dict[tuple, float], threshold: float = 0.5) -> DataFrame:
    accepted = [":".join(map(str, pattern)) for pattern, p in sorted(prob.items()) if pattern[0] in LOOSE and p >= threshold]
    key = lambda x: F.concat_ws(":", x["kind"], *(x[v] for v in VOTERS), x["size"])
    order = lambda spans: F.transform(
        F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")),
    )
    base = F.filter("spans", lambda x: x["k"] < len(KINDS))
    kept = F.filter("spans", lambda x: (x["k"] < len(KINDS)) | (key(x).isin(accepted) if accepted else F.lit(False)))
    rest = [c for c in found.columns if c != "spans"]
    return found.select(*rest, order(base).alias("base"), order(kept).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span of its text replaced by its kind in brackets; overlapping spans are
    replaced as one, under the first one's kind. Rows and all other columns stay."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    # The texts are searched twice, for the counts and for the decision, and whole rows never written.
    prob = _weighed(candidates(df.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text"))
    found = candidates(df.select(row.alias("row"), F.col(text_col).alias("text")), "row", "text")
    # The spans pass through a generator of one row, so that they are computed once for a text.
    once = found.select("doc_id", F.explode(F.array("spans")).alias("spans"))
    spans = decided(once, prob).select(F.col("doc_id").alias("row"), F.explode(F.array("spans")).alias("spans"))
    text = F.col(f"row.`{text_col}`")
    state = "struct<at:int,out:array<string>>"

    def step(a: Column, x: Column) -> Column:
        fresh = F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0))), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out")).cast(state)
        inside = F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")).cast(state)
        return F.when(x["s"] < a["at"], inside).otherwise(fresh)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
    masked = F.when(F.size("spans") == 0, text).otherwise(
        F.aggregate("spans", start, step, lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), ""))
    )
    return spans.select(*((masked if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    spans = find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint")
    return spans.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )
