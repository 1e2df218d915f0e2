"""Exact length histogram: documents are aggregated by encoded length, and suffix sums over the lengths answer
totals, quantiles and truncated totals for every context limit without touching the documents again.

Every text is encoded whole. Cases: null and empty texts have length 0; an empty table gives an empty
histogram, whose answers are zeros and whose quantiles are null; repeated rows count each time; other columns
are not looked at. The histogram has a row per distinct length, so its size doesn't follow the row count.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.llm.common import map_rows, vocabulary_path
from wordloom.session import materialise, table

#: Lengths per bucket of the two-level suffix sums.
BUCKET = 64


def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pattern() -> str:
    """The word pattern that belongs to byte-level vocabularies of this family."""
    return r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoded_lengths(df: DataFrame, text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """n_tokens of every row's whole text."""
    path, words = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken"), pattern or _pattern()
    held: dict = {}

    def run(x: dict) -> dict:
        if "e" not in held:
            held["e"] = _encoder(path, words)
        encode = held["e"].encode_ordinary
        return {"n_tokens": [len(encode(t)) if t else 0 for t in x["text"]]}

    return map_rows(df.select(F.col(text).cast("string").alias("text")), "n_tokens bigint", run, ["text"])


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """n_tokens, n_docs."""
    return lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For every length L: documents and tokens at L or above, tokens that remain if texts are cut at L, tokens
    lost by the cut, the share of documents that fit. Sums run over buckets of lengths first, then inside each,
    so no task sees more than a bucket's lengths or the list of buckets."""
    h = hist.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    tops = (
        h.groupBy("bucket")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select("bucket", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_above"), F.sum("d").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all_docs"))
    )
    inside = W.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = h.join(tops, "bucket").select(
        "n_tokens", "n_docs", "tokens", "all_docs",
        (F.sum("n_docs").over(inside) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("tokens_above")).alias("tokens_at_least"),
    )
    over = F.col("docs_at_least") - F.col("n_docs")
    lost = F.col("tokens_at_least") - F.col("tokens") - over * F.col("n_tokens")
    return x.select("n_tokens", "n_docs", "tokens", "docs_at_least", "tokens_at_least", over.alias("docs_cut"), lost.alias("tokens_lost"), (over == 0).alias("is_longest"), (F.col("all_docs") - over).alias("docs_at_most"), ((F.col("all_docs") - over) / F.col("all_docs")).alias("share_at_most"))


def answer_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """For each row of `limits` (context_limit): documents cut, tokens kept and lost. A limit's answer comes from the
    shortest length above it: with d documents and t tokens from there on, t - d * limit are lost."""
    asked = limits.select(F.col("context_limit").cast("bigint").alias("context_limit")).distinct()
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    above = asked.join(sums, F.col("n_tokens") > F.col("context_limit"), "left").groupBy("context_limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("s"))
    d, t = F.coalesce(F.col("s.docs_at_least"), F.lit(0)), F.coalesce(F.col("s.tokens_at_least"), F.lit(0))
    lost = t - d * F.col("context_limit")
    return above.join(F.broadcast(total)).select("context_limit", d.alias("docs_cut"), lost.alias("tokens_lost"), (F.col("all_tokens") - lost).alias("tokens_kept"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The shortest length that at least the share q of the documents doesn't exceed; null without documents."""
    return sums.where(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op4_length_histogram(spark, sf_dir: str) -> DataFrame:
    return suffix_sums(materialise(histogram(encoded_lengths(table(spark, sf_dir, "documents")))))  # read twice
