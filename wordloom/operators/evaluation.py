"""Splits, metrics from stored predictions, comparison tables.

predictions: image_id, true_label, predicted_label, proba (map of class to probability, null if there are none),
and any number of run columns to group by.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordloom.operators.allocation import allocate

log = logging.getLogger("wordloom")


def stratified_split(labels: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """labels (image_id, class) with is_test. ceil(test_size * n) test rows are shared by classes in proportion to
    their rows; inside a class the smallest md5 of id and seed are test rows."""
    n = labels.count()
    counts = labels.groupBy("class").agg(F.count(F.lit(1)).alias("__n")).withColumn("__all", F.lit(0))
    quota = allocate(counts, ["__all"], "class", "__n", F.lit(math.ceil(round(test_size * n, 9))), "__test").select("class", "__test")
    key = F.md5(F.concat(F.col("image_id").cast("string"), F.lit(f"|{seed}")).cast("binary"))
    x = labels.select("image_id", "class", key.alias("__key")).withColumn("__cut", F.substring("__key", 1, 3))
    # a class is cut by the first digits of the hash: counts tell all cuts but one whether their rows are test rows
    upto = F.sum("n").over(W.partitionBy("class").orderBy("__cut"))
    cuts = x.groupBy("class", "__cut").agg(F.count(F.lit(1)).alias("n")).select("class", "__cut", (upto - F.col("n")).alias("__before"))
    place = F.row_number().over(W.partitionBy("class", "__cut").orderBy("__key", "image_id"))
    x = x.withColumn("__place", place).join(cuts, ["class", "__cut"]).join(quota, "class")
    return x.select("image_id", "class", (F.col("__before") + F.col("__place") <= F.col("__test")).alias("is_test"))


# --- metrics ----------------------------------------------------------------------------------------

Metric = Callable[[DataFrame, list[str]], DataFrame]
METRICS: dict[str, Metric] = {}


def metric(name: str):
    """Register fn(predictions, run columns) -> run columns, value."""

    def add(fn: Metric) -> Metric:
        METRICS[name] = fn
        return fn

    return add


def available_metrics() -> list[str]:
    return sorted(METRICS)


@metric("accuracy")
def accuracy(p: DataFrame, by: list[str]) -> DataFrame:
    return p.groupBy(*by).agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double")).alias("value"))


def class_counts(p: DataFrame, by: list[str]) -> DataFrame:
    """run columns, label, tp, n_true, n_predicted for every label that is true or predicted somewhere."""
    pair = F.array(F.struct(F.col("true_label").alias("label"), F.lit(1).alias("t")), F.struct(F.col("predicted_label").alias("label"), F.lit(0).alias("t")))
    hit = F.col("true_label") == F.col("predicted_label")
    x = p.select(*by, hit.alias("hit"), F.explode(pair).alias("x")).select(*by, "hit", "x.label", "x.t")
    return x.groupBy(*by, "label").agg(F.count_if(F.col("hit") & (F.col("t") == 1)).alias("tp"), F.sum("t").alias("n_true"), F.sum(1 - F.col("t")).alias("n_predicted"))


def confusion(p: DataFrame, by: list[str]) -> DataFrame:
    return p.groupBy(*by, "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


@metric("f1_macro")
def f1_macro(p: DataFrame, by: list[str]) -> DataFrame:
    f1 = 2 * F.col("tp") / (F.col("n_true") + F.col("n_predicted"))
    return class_counts(p, by).groupBy(*by).agg(F.avg(f1).alias("value"))


@metric("recall_macro")
def recall_macro(p: DataFrame, by: list[str]) -> DataFrame:
    recall = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    return class_counts(p, by).groupBy(*by).agg(F.avg(recall).alias("value"))


@metric("auc_macro_ovr")
def auc_macro_ovr(p: DataFrame, by: list[str]) -> DataFrame:
    """One class against the rest by average ranks, then the mean; of two classes the second in order is positive. NaN
    without probabilities, with fewer than two classes, or if the probabilities' classes aren't the labels'."""
    x = p.select(*by, "true_label", F.explode_outer("proba").alias("label", "s"))
    known = class_counts(p, by).groupBy(*by).agg(F.sort_array(F.collect_set("label")).alias("classes"), F.count_if(F.col("n_true") == 0).alias("absent"))
    # rows of one score are counted first; scores are cut into 8,192 steps, which are summed up before each is run through
    y = F.col("true_label") == F.col("label")
    step = F.floor(F.col("s") / (1 + F.abs("s")) * 4096)
    tied = x.withColumn("step", step).groupBy(*by, "label", "step", "s").agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    own = [*by, "label"]
    steps = tied.groupBy(*own, "step").agg(F.sum("n").alias("all"))
    steps = steps.select(*own, "step", (F.sum("all").over(W.partitionBy(*own).orderBy("step")) - F.col("all")).alias("below"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*own, "step"]]
    met = tied.alias("a").join(steps.alias("b"), reduce(lambda u, v: u & v, same)).select("a.*", "b.below")
    less = F.col("below") + F.sum("n").over(W.partitionBy(*own, "step").orderBy("s")) - F.col("n")
    sums = met.withColumn("wins", F.col("p") * (less + F.col("n") / 2.0)).groupBy(*own).agg(F.sum("wins").alias("wins"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    auc = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("wins") / (F.col("pos") * F.col("neg"))).otherwise(F.lit(float("nan")))
    each = sums.withColumn("auc", auc).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("label", "auc"))).alias("a"))
    joined = each.join(known, by) if by else each.join(known)
    mean = F.aggregate("a", F.lit(0.0), lambda t, z: t + z["auc"]) / F.size("a")
    value = F.when(F.transform("a", lambda z: z["label"]) != F.col("classes"), F.lit(float("nan"))).when(F.size("classes") < 2, F.lit(float("nan"))).when(F.size("classes") == 2, F.element_at("a", 2)["auc"]).otherwise(mean)
    return joined.select(*by, F.coalesce(value, F.lit(float("nan"))).alias("value"))


def evaluate(p: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """Long table run columns, metric, value. No names: every metric. Unknown names fail before anything is evaluated;
    a metric that fails on these predictions is NaN, with a warning."""
    wanted = names or available_metrics()
    missing = [n for n in wanted if n not in METRICS]
    if missing:
        raise KeyError(f"no metrics {missing}; there are {available_metrics()}")
    out = None
    for n in wanted:
        try:
            one = METRICS[n](p, by)
        except Exception as e:  # noqa: BLE001  a registered metric may do anything
            log.warning("metric %s failed: %s", n, e)
            one = (p.groupBy(*by) if by else p.groupBy()).agg(F.lit(float("nan")).alias("value"))
        one = one.select(*by, F.lit(n).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def recompute_all(spark, folder: str, names: list[str] | None = None) -> DataFrame:
    """Metrics of all prediction files under a folder in one job, by file."""
    p = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(folder).withColumn("file", F.col("_metadata.file_path"))
    return evaluate(with_proba_map(p), ["file"], names)


def with_proba_map(p: DataFrame, prefix: str = "predicted_proba_") -> DataFrame:
    """Columns predicted_proba_<class> as one map, in order of their names; null without any."""
    if "proba" in p.columns:
        return p
    found = [c for c in sorted(p.columns) if c.startswith(prefix)]
    if not found:
        return p.withColumn("proba", F.lit(None).cast("map<string,double>"))
    made = F.map_filter(F.create_map(*[v for c in found for v in (F.lit(c[len(prefix) :]), F.col(f"`{c}`").cast("double"))]), lambda _, v: v.isNotNull())
    return p.withColumn("proba", made).drop(*found)


def with_proba_columns(p: DataFrame, classes: list[str], prefix: str = "predicted_proba_") -> DataFrame:
    return p.select("*", *[F.col("proba")[c].alias(prefix + c) for c in sorted(classes)]).drop("proba")


def comparison_table(runs: DataFrame) -> DataFrame:
    """Rows ordered by dataset, approach, feature_variant, classifier; these columns first, the others by name."""
    first = [c for c in ("dataset", "approach", "feature_variant", "classifier") if c in runs.columns]
    rest = sorted(c for c in runs.columns if c not in first)
    return runs.select(*first, *rest).orderBy(*first)
