"""The stages, one after the other, against what plain Python expects of them."""

import random
import time

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm.common import written


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_stages(spark):
    clean = [prose(90, i) for i in range(12)]
    near = clean[0].split()
    near[5] = "changed"
    texts = [*clean, clean[1], " ".join(near), clean[2] + " write to anna.b@mail.example.com or 10.1.2.3", "too short", None, "again and again " * 60, prose(90, 50) + " write to anna.b@mail.example.com or 10.1.2.3"]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        seen.append({r.doc_id: r for r in docs.collect()} if "text" in docs.columns else docs.collect())
    kept, single, masked, mixed, pieces = seen
    assert set(kept) == {*range(15), 18}
    # 12 repeats 1; 13 is near 0; 14 adds eight words to 2, 86 of some 94 shingles are shared.
    assert set(single) == {*range(12), 18}
    assert set(masked) == set(single) and all(r.n_chars == len(r.text) for r in masked.values())
    assert masked[18].text.endswith("write to [EMAIL] or [IP]") and masked[3].text == clean[3]
    assert set(mixed) <= set(masked)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {p.doc_id for p in pieces} == set(mixed)
    for p in pieces:
        assert p.doc_tokens == len(tok.encode(mixed[p.doc_id].text, add_special_tokens=False).ids) + 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_whole_table(spark):
    """All stages over a given table, whole; what is packed are documents that the first stage kept."""
    sf_dir = "/root/testdata/sf0.001"
    began = time.monotonic()
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert time.monotonic() - began < 120
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).select("doc_id").collect()}
    assert pieces and {p.doc_id for p in pieces} <= kept
