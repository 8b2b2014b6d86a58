"""The stages one after the other against a plain version of each."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import tiktoken

from assayer.llm import bpe

from .test_operators import brute_similar, language_rows


def test_stages(spark):
    rng = random.Random(8)
    rows = [(i, t, lang, rng.choice("abc")) for i, t, lang in language_rows(200)]
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:10])]  # copies
    rows += [(2000, None, "en", "a"), (2001, "123 456", "en", "a"), (2002, "", None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused").persist()
        kept.append(docs.collect())
    languages, singles, mixed, tokens = kept
    clean = {r[0] for r in rows if r[0] < 2000}
    assert {r["doc_id"] for r in languages} == clean
    text = {r[0]: r[1] for r in rows}
    ids = sorted(clean)
    expected = set(brute_similar([(i, text[i]) for i in ids]))
    assert sorted(r["doc_id"] for r in singles) == sorted(expected)
    assert {r["doc_id"] for r in mixed} <= expected and len(mixed) >= len(expected)
    words = lambda table: sum(len(r["text"].split()) for r in table)
    assert 0.9 * 1.5 * words(singles) <= words(mixed) <= 1.5 * words(singles)
    one = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted(r["doc_id"] for r in tokens) == sorted(r["doc_id"] for r in mixed)
    for r in tokens:
        assert list(r["ids"]) == one.encode_ordinary(text[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
