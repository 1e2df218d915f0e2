"""Word selection strategies: GCF, ICC and CED, top words per class, unions and overlaps.

With f a word's count in an image, F its sum over a class, N_c the class's images and M the number of classes:
GCF = F; ICC = F * H_intra; CED = ICC * (1 - H_inter). The entropies come of one pass over aggregates,
H = (log2 F - sum(f log2 f) / F) / log2 N, and are exactly 0 where a word has one image or one class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def entropies(dense: DataFrame) -> DataFrame:
    """h_intra and h_inter for the rows of stats.densified."""
    word = W.partitionBy("word_id")
    intra = (F.log2("freq") - F.col("flogf") / F.col("freq")) / F.log2("n_images")
    x = dense.withColumn("h_intra", F.when((F.col("n_images") > 1) & (F.col("df") > 1), _clamped(intra)).otherwise(0.0))
    total = F.sum("freq").over(word)
    logs = F.sum(F.when(F.col("freq") > 0, F.col("freq") * F.log2("freq")).otherwise(0.0)).over(word)
    holding, classes = F.count_if(F.col("freq") > 0).over(word), F.count(F.lit(1)).over(word)
    inter = (F.log2(total) - logs / total) / F.log2(classes)
    return x.withColumn("h_inter", F.when((classes > 1) & (holding > 1), _clamped(inter)).otherwise(0.0))


#: name -> score of a row of `entropies`.
STRATEGIES: dict[str, Callable[[], Column]] = {
    "GCF": lambda: F.col("freq").cast("double"),
    "ICC": lambda: F.col("freq") * F.col("h_intra"),
    "CED": lambda: F.greatest(F.lit(0.0), F.col("freq") * F.col("h_intra") * (1 - F.col("h_inter"))),
}


def register_strategy(name: str):
    def add(fn: Callable[[], Column]) -> Callable[[], Column]:
        STRATEGIES[name] = fn
        return fn

    return add


def strategy(name: str) -> Callable[[], Column]:
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[name]


def scores(dense: DataFrame, names: list[str] | None = None) -> DataFrame:
    """strategy, class, word_id, score for several strategies in one pass."""
    each = [F.struct(F.lit(n).alias("strategy"), strategy(n)().alias("score")) for n in names or list(STRATEGIES)]
    return entropies(dense).select("class", "word_id", F.explode(F.array(*each)).alias("s")).select("s.strategy", "class", "word_id", "s.score")


def ranked(scored: DataFrame, *keys: str) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "word_id"))


def select_top_n(scored: DataFrame, n: int | None) -> DataFrame:
    """The n best words of every class by themselves, zero scores included, equal scores by word id; None: all."""
    x = scored.withColumn("rank", ranked(scored, "strategy", "class"))
    return x if n is None else x.where(F.col("rank") <= n)


def union_vocabulary(selection: DataFrame) -> DataFrame:
    return selection.select("strategy", "word_id").distinct()


def overlap(selection: DataFrame, one: str, other: str) -> DataFrame:
    """Words that two classes both selected."""
    words = lambda c: selection.where(F.col("class") == c).select("strategy", "word_id")
    return words(one).intersect(words(other))


def top_n_for_vocabulary(k: int, classes: int) -> int:
    return max(1, k // max(classes, 1))
