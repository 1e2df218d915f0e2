import base64

import pytest
import tiktoken
from pyspark.sql import functions as F

from wordloom.llm import token_lengths as tl
from wordloom.llm.common import vocabulary_path


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary_path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(rows, lengths):
    n = len(lengths)
    assert {r["n_tokens"] for r in rows} == set(lengths)
    for r in rows:
        at = r["n_tokens"]
        assert r["n_docs"] == lengths.count(at)
        assert r["docs_at_least"] == sum(x >= at for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= at)
        assert r["docs_cut"] == sum(x > at for x in lengths)
        assert r["tokens_lost"] == sum(max(0, x - at) for x in lengths)
        assert r["share_at_most"] == pytest.approx(sum(x <= at for x in lengths) / n)


def test_query(spark, small, encoder):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(tl.op4_length_histogram(spark, small).collect(), [len(encoder.encode_ordinary(t)) for t in texts])


def test_cases_limits_and_quantiles(spark, encoder):
    texts = [None, "", "a", "a", "word " * 5000, "x", "the cat <|endoftext|>"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int")
    lengths = [len(encoder.encode_ordinary(t or "")) for t in texts]
    sums = tl.suffix_sums(tl.histogram(tl.encoded_lengths(df))).cache()
    check(sums.collect(), lengths)
    limits = spark.createDataFrame([(x,) for x in (0, 1, 3, 4000, 10**6)], "context_limit long")
    for r in tl.answer_limits(sums, limits).collect():
        at = r["context_limit"]
        assert (r["docs_cut"], r["tokens_lost"], r["tokens_kept"]) == (sum(x > at for x in lengths), sum(max(0, x - at) for x in lengths), sum(min(x, at) for x in lengths))
    for q in (0.1, 0.5, 0.9, 1.0):
        assert tl.quantile(sums, q).first()[0] == next(x for x in sorted(lengths) if sum(y <= x for y in lengths) / len(lengths) >= q)


def test_empty(spark):
    sums = tl.suffix_sums(tl.histogram(tl.encoded_lengths(spark.createDataFrame([], "text string"))))
    assert sums.count() == 0
    assert tl.quantile(sums, 0.5).first()[0] is None
    got = tl.answer_limits(sums, spark.createDataFrame([(5,)], "context_limit long")).first()
    assert (got["docs_cut"], got["tokens_lost"], got["tokens_kept"]) == (0, 0, 0)
    assert F is not None
