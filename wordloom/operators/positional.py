"""Per-position reconstruction: words ranked by position and class, representatives, synthetic images.

rows: image_id, position, word_id, prob; at most one word per image and position, so a word's total is its image
count. Classes and their sizes are those of all images with a word at any position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.operators.selection import scores


def position_bags(rows: DataFrame) -> DataFrame:
    """position, and how many rows and images it has; the rows themselves stay keyed by position."""
    return rows.groupBy("position").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("image_id").alias("n_images"))


def positional_stats(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """position, class, word_id, freq (= df)."""
    return rows.join(labels, "image_id").groupBy("position", "class", "word_id").agg(F.count(F.lit(1)).alias("freq"))


def position_words(rows: DataFrame, labels: DataFrame, top_n: int, names: list[str] | None = None) -> DataFrame:
    """strategy, position, class, rank, word_id: the best positive scores; entropies are taken position by position."""
    stats = positional_stats(rows, labels)
    seen = rows.select("image_id").distinct().join(labels, "image_id")
    sizes = seen.groupBy("class").agg(F.count(F.lit(1)).alias("n_images"))
    words = stats.select("position", "word_id").distinct()
    zero = F.lit(0).cast("bigint")
    dense = words.join(sizes).join(stats, ["position", "class", "word_id"], "left")
    # a word of a position is a key of its own, so one pass scores all positions
    key = F.struct("position", "word_id")
    dense = dense.select("class", key.alias("word_id"), "n_images", F.coalesce("freq", zero).alias("freq"), F.coalesce("freq", zero).alias("df"), F.lit(0.0).alias("flogf"))
    s = scores(dense, names).where("round(score, 9) > 0").select("strategy", "class", "word_id.position", "word_id.word_id", "score")
    rank = F.row_number().over(W.partitionBy("strategy", "position", "class").orderBy(F.round("score", 9).desc(), "word_id"))
    return s.withColumn("rank", rank).where(F.col("rank") <= top_n).select("strategy", "position", "class", "rank", "word_id")


def representatives(rows: DataFrame, words: DataFrame) -> DataFrame:
    """position, word_id, image_id: the most probable row of each needed word, over all classes."""
    needed = words.select("position", "word_id").distinct()
    order = W.partitionBy("position", "word_id").orderBy(F.desc("prob"), "image_id")
    return rows.join(needed, ["position", "word_id"], "left_semi").withColumn("r", F.row_number().over(order)).where("r = 1").select("position", "word_id", "image_id")


def synthetic(words: DataFrame, reps: DataFrame, classes: DataFrame, positions: DataFrame, n: int) -> DataFrame:
    """strategy, class, j, position, word_id, image_id: image j takes at each position the word of rank j mod their
    number, and its representative's row; null where a class has no word (a zero vector)."""
    sizes = words.groupBy("strategy", "position", "class").agg(F.count(F.lit(1)).alias("n_words"))
    grid = classes.join(positions).join(words.select("strategy").distinct()).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    x = grid.join(sizes, ["strategy", "position", "class"], "left").withColumn("rank", (F.col("j") % F.col("n_words") + 1).cast("int"))
    return x.join(words, ["strategy", "position", "class", "rank"], "left").join(reps, ["position", "word_id"], "left").select("strategy", "class", "j", "position", "word_id", "image_id")


def with_vectors(images: DataFrame, descriptors: DataFrame, dim: int) -> DataFrame:
    """Vectors of the synthetic rows, zeros where there is none."""
    from wordloom.functions.vectors import zeros

    d = descriptors.select("image_id", F.col("local_idx").alias("position"), F.col("vec").cast("array<float>").alias("vec"))
    return images.join(d, ["image_id", "position"], "left").withColumn("vec", F.coalesce("vec", zeros(dim)))


def empty_pairs(words: DataFrame, classes: DataFrame, positions: DataFrame) -> DataFrame:
    """Per strategy the (position, class) pairs without a word."""
    grid = classes.join(positions).join(words.select("strategy").distinct())
    return grid.join(words.select("strategy", "position", "class").distinct().withColumn("has", F.lit(1)), ["strategy", "position", "class"], "left").groupBy("strategy").agg(F.count_if(F.col("has").isNull()).alias("n_empty"))


def default_synthetic_count(n_train: int, n_classes: int) -> int:
    return max(1, n_train // max(n_classes, 1))
