"""Masked texts: every label, overlaps, numbering, and plain text left alone."""

import time

from lectern.operators import pii
from lectern.plans import relational

CASES = [
    ("mail Ann@x.org, bob@y.org and ann@X.org", "mail [EMAIL_1], [EMAIL_2] and [EMAIL_1]"),
    ("a@b.c_d@e.f then @none", "[EMAIL_1][EMAIL_2] then @none"),
    ("call +1 (555) 010-9999 or (555) 123-4567 or 555.123.4567", "call [TELEPHONENUM_1] or [TELEPHONENUM_2] or [TELEPHONENUM_3]"),
    ("pay 4111 1111 1111 1111 or 378282246310005, not 4111 1111 1111 1112", "pay [CREDITCARDNUMBER_1] or [CREDITCARDNUMBER_2], not 4111 1111 1111 1112"),
    ("item 12 4111 1111 1111 1111 7", "item 12 [CREDITCARDNUMBER_1] 7"),
    ("to DE89 3704 0044 0532 0130 00 thanks, GB82WEST12345698765432; DE89370400440532013001", "to [IBAN_1] thanks, [IBAN_2]; DE89370400440532013001"),
    ("host 10.2.3.4 and 300.1.1.1 and 10.2.3.4", "host [IP_1] and 300.1.1.1 and [IP_1]"),
    ("1.2.3.4@x.org 10.0.0.1", "[EMAIL_1] [IP_1]"),
    ("plain 1,234.50 text", "plain 1,234.50 text"),
    ("  \n", "  \n"),
    ("", ""),
    (None, None),
]


def test_masked_texts(spark, tmp_path):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.masked for r in relational.pii_mask_text(spark, str(tmp_path)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_long_runs_take_linear_time():
    text = "a." * 200_000 + " " + "1" * 200_000 + " @x.y " + "+1 " * 50_000 + "1 " * 100_000
    start = time.monotonic()
    pii.masked(text)
    assert time.monotonic() - start < 20
