import math

import pytest
from pyspark.sql import functions as F

from wordloom.operators import evaluation
from wordloom.operators.classify import CLASSIFIERS, classify

ROWS = [("a", "cat", "cat", 0.9, 0.1), ("b", "dog", "dog", 0.2, 0.8), ("c", "cat", "dog", 0.4, 0.6), ("d", "dog", "dog", 0.1, 0.9)]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(ROWS, "image_id string, true_label string, predicted_label string, predicted_proba_cat double, predicted_proba_dog double")


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_metrics(wide):
    got = values(evaluation.evaluate(evaluation.with_proba_map(wide), []))
    assert got == {"accuracy": 0.75, "recall_macro": 0.75, "f1_macro": pytest.approx(0.733333, abs=1e-6), "auc_macro_ovr": 1.0}


def test_without_probabilities(spark):
    p = spark.createDataFrame([("a", "cat", "cat"), ("b", "dog", "dog")], "image_id string, true_label string, predicted_label string")
    got = values(evaluation.evaluate(evaluation.with_proba_map(p), [], ["accuracy", "auc_macro_ovr"]))
    assert got["accuracy"] == 1.0
    assert math.isnan(got["auc_macro_ovr"])


def test_registry(wide):
    with pytest.raises(KeyError):
        evaluation.evaluate(wide, [], ["none"])
    evaluation.metric("rows")(lambda p, by: p.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("value")))
    evaluation.metric("broken")(lambda p, by: p.select("not_there"))
    try:
        got = values(evaluation.evaluate(wide, [], ["rows", "broken"]))
        assert got["rows"] == 4
        assert math.isnan(got["broken"])
    finally:
        del evaluation.METRICS["rows"], evaluation.METRICS["broken"]


def test_recompute_files(spark, wide, tmp_path):
    wide.write.parquet(str(tmp_path / "one"))
    wide.drop("predicted_proba_cat", "predicted_proba_dog").write.parquet(str(tmp_path / "two"))
    got = evaluation.recompute_all(spark, str(tmp_path), ["accuracy"])
    assert {round(r["value"], 2) for r in got.collect()} <= {0.0, 0.5, 0.75, 1.0}
    back = evaluation.with_proba_columns(evaluation.with_proba_map(wide), ["cat", "dog"])
    assert sorted(back.columns) == sorted(wide.columns)


def test_split_counts(spark):
    labels = spark.createDataFrame([(f"x{i}", "abc"[i % 3]) for i in range(50)], "image_id string, class string")
    got = evaluation.stratified_split(labels, 0.2)
    n = {r["class"]: r["n"] for r in got.where("is_test").groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(n.values()) == 10
    assert max(n.values()) - min(n.values()) <= 1
    assert got.collect() == evaluation.stratified_split(labels, 0.2).collect()


def blobs(spark, seed):
    import numpy as np

    r = np.random.default_rng(seed)
    return spark.createDataFrame([(f"{c}{i}{seed}", c, [float(v) for v in abs(r.normal(m, 0.3, 3))]) for c, m in (("a", (1, 5, 1)), ("b", (5, 1, 1)), ("c", (1, 1, 5))) for i in range(12)], "image_id string, label string, vec array<double>").cache()


@pytest.mark.parametrize("name", ["knn", "naive_bayes", "logistic_regression", "decision_tree", "svc"])
def test_classifiers(spark, name):
    p = classify(name, blobs(spark, 1), blobs(spark, 2))
    assert p.columns == ["image_id", "true_label", "predicted_label", "proba"]
    assert evaluation.accuracy(p, []).first()["value"] > 0.9
    assert "xgboost" in CLASSIFIERS


def test_unknown_classifier(spark):
    with pytest.raises(ValueError):
        classify("none", None, None)
