"""Occurrence counts and class statistics of visual words, in sparse long form.

occurrence: image_id, word_id, f (> 0); labels: image_id, class; class_word: class, word_id, freq, df, flogf;
class_size: class, n_images. Images without any word have no rows and don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def occurrence(assignments: DataFrame) -> DataFrame:
    """How often each word occurs in each image."""
    return assignments.groupBy("image_id", "word_id").agg(F.count(F.lit(1)).alias("f"))


def l1_normalised(occ: DataFrame) -> DataFrame:
    """Counts over their image's sum."""
    return occ.withColumn("share", F.col("f") / F.sum("f").over(W.partitionBy("image_id")))


def class_word(occ: DataFrame, labels: DataFrame) -> DataFrame:
    """Per class and word: occurrences, images with it, and the sum of f log2 f that entropies need."""
    return (
        occ.join(labels, "image_id")
        .groupBy("class", "word_id")
        .agg(F.sum("f").cast("bigint").alias("freq"), F.count(F.lit(1)).alias("df"), F.sum(F.col("f") * F.log2("f")).alias("flogf"))
    )


def class_size(occ: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with any word per class; classes that only the labels know have none."""
    seen = occ.select("image_id").distinct().join(labels, "image_id").groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return labels.select("class").distinct().join(seen, "class", "left").select("class", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_images"))


def densified(cw: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for every class and word; both lists are small beside the images."""
    grid = sizes.join(cw.select("word_id").distinct())
    zero = F.lit(0).cast("bigint")
    return grid.join(cw, ["class", "word_id"], "left").select("class", "word_id", "n_images", F.coalesce("freq", zero).alias("freq"), F.coalesce("df", zero).alias("df"), F.coalesce("flogf", F.lit(0.0)).alias("flogf"))


def out_of_class(dense: DataFrame) -> DataFrame:
    """Images of other classes: how many hold the word, how many there are, and the share."""
    word = W.partitionBy("word_id")
    df_out, n_out = F.sum("df").over(word) - F.col("df"), F.sum("n_images").over(word) - F.col("n_images")
    return dense.select("class", "word_id", df_out.alias("df_out"), n_out.alias("n_out"), (df_out / F.greatest(n_out, F.lit(1))).alias("rho_out"))


def classes_containing(cw: DataFrame) -> DataFrame:
    return cw.groupBy("word_id").agg(F.count_if(F.col("df") > 0).alias("n_classes"))


def masked_zero(occ: DataFrame, selected: DataFrame, words: DataFrame) -> DataFrame:
    """Every word for every image, 0 where it isn't selected or doesn't occur."""
    kept = occ.join(selected.select("word_id").distinct(), "word_id", "left_semi")
    grid = occ.select("image_id").distinct().join(words.select("word_id").distinct())
    return grid.join(kept, ["image_id", "word_id"], "left").select("image_id", "word_id", F.coalesce("f", F.lit(0)).cast("bigint").alias("f"))


def masked_compact(occ: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected words alone, renumbered from 0 in order of their ids."""
    number = F.row_number().over(W.orderBy("word_id")) - 1
    ids = selected.select("word_id").distinct().withColumn("dim", number)
    return occ.join(ids, "word_id").select("image_id", "dim", "f")


def survivors(clustered: DataFrame) -> DataFrame:
    """Rows in a cluster (label not -1), labels renumbered from 0 without gaps in their order."""
    kept = clustered.where(F.col("label") != -1)
    ids = kept.select("label").distinct().withColumn("cluster_id", F.row_number().over(W.orderBy("label")) - 1)
    return kept.join(ids, "label").drop("label")


def noise_share(clustered: DataFrame) -> DataFrame:
    return clustered.agg(F.count_if(F.col("label") == -1).alias("n_noise"), F.avg((F.col("label") == -1).cast("double")).alias("share"))
