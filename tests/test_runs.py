import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.plans import approaches, config
from wordloom.plans.checkpoint import Steps
from wordloom.sources import images
from wordloom.streaming.incremental import drain, drain_occurrence


def test_config_checks_and_hashes(tmp_path):
    c = config.Config()
    assert config.ensure_run_id(c) == config.ensure_run_id(config.Config())
    assert config.override(config.Config(), ["vocabulary.k=12"]).vocabulary.k == 12
    for bad in (["vocabulary.q=1"], ["nothing=1"], ["selection.mode=x"]):
        with pytest.raises(ValueError):
            config.override(config.Config(), bad)
    with pytest.raises(ValueError):
        config.from_dict({"data": {"dataset_name": "a b"}})
    (tmp_path / "c.yaml").write_text("vocabulary:\n  k: 9\n")
    assert config.load(str(tmp_path / "c.yaml")).vocabulary.k == 9


def test_steps_follow_settings_inputs_and_outputs(spark, tmp_path):
    import shutil

    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("1")
    steps = Steps(spark, str(tmp_path / "steps"))
    run = lambda s: steps.step("one", s, make, [str(source)]).count()
    assert run(1) == run(1) == 3
    assert len(calls) == 1
    run(2)  # other settings
    (source / "b.txt").write_text("2")
    run(2)  # other inputs
    assert len(calls) == 3
    shutil.rmtree(steps.status("one")["path"])
    run(2)  # its output is gone
    assert len(calls) == 4
    with pytest.raises(ZeroDivisionError):
        steps.step("two", 1, lambda: 1 / 0)
    assert steps.status("two")["status"] == "FAILED"


def fake_inputs(spark):
    r = np.random.default_rng(0)
    rows, globals_ = [], []
    for c, shift in (("a", 0), ("b", 3)):
        for i in range(10):
            ds = [(r.normal(shift if p % 2 else -shift, 0.3, 4) + (p == 0)) for p in range(4)]
            rows += [(f"{c}__{i}", p, [float(v) for v in d]) for p, d in enumerate(ds)]
            globals_.append((f"{c}__{i}", [float(v) for v in np.mean(ds, axis=0)]))
    d = spark.createDataFrame(rows, "image_id string, local_idx int, vec array<float>").cache()
    g = spark.createDataFrame(globals_, "image_id string, vec array<float>").cache()
    labels = spark.createDataFrame([(i, i[0]) for i, _ in globals_], "image_id string, class string").cache()
    return {"labels": labels, "sift": d, "cnn": d, "vit": d, "cnn_global": g, "vit_global": g}


@pytest.mark.parametrize("name", ["bovw_baseline", "bovw_cvws", "cnn_bovw_cvws", "vit_end_to_end"])
def test_approaches(spark, name):
    c = config.Config()
    c.vocabulary.k, c.density.min_cluster_size, c.classifiers.enabled, c.selection.strategies, c.runtime.metrics = 4, 3, ["knn"], ["GCF"], ["accuracy"]
    got = approaches.run(name, fake_inputs(spark), c).collect()
    assert len(got) == 1
    assert 0 <= got[0]["accuracy"] <= 1
    assert len(approaches.APPROACHES) == 8
    with pytest.raises(ValueError):
        approaches.run("none", {}, c)


def bmp(path, grey):
    """An uncompressed 24-bit bitmap of one grey."""
    import struct

    w = h = 24
    body = bytes([grey, grey, grey]) * w * h
    path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body)


def test_image_folders(spark, tmp_path):
    for c in ("x", "y", ".hidden"):
        (tmp_path / "set" / c).mkdir(parents=True)
        bmp(tmp_path / "set" / c / "1.BMP", 100)
        (tmp_path / "set" / c / "notes.txt").write_text("no")
    root = str(tmp_path / "set")
    got = images.require_images(images.scan(spark, root), root).collect()
    assert {(r["dataset"], r["image_id"], r["class"]) for r in got} == {("set", "x__1", "x"), ("set", "y__1", "y")}
    many = images.scan(spark, str(tmp_path), many=True)
    assert {r["n_classes"] for r in images.datasets(many).collect()} == {2}
    (tmp_path / "empty").mkdir()
    pixels = images.decode(spark, root).select(F.col("path").alias("image_id"), "pixels")
    small = images.preprocess(pixels, 16)
    assert {r["pixels"]["height"] for r in small.collect()} == {16}
    noise = spark.createDataFrame([("n", (32, 32, 3, bytearray(np.random.default_rng(0).integers(0, 255, 32 * 32 * 3, dtype=np.uint8).tobytes())))], "image_id string, pixels struct<height:int,width:int,channels:int,data:binary>")
    d = images.describe(noise, "gradient").collect()
    assert len(d) == 9
    assert len(d[0]["vec"]) == 128
    assert [r["image_id"] for r in images.pending(noise, noise.limit(0)).collect()] == ["n"]


def test_incremental(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "image_id long, word_id int").write.parquet(src)
    assert drain_occurrence(spark, src, sink, ck) == 3
    spark.createDataFrame([(1, 5)], "image_id long, word_id int").write.mode("append").parquet(src)
    assert drain_occurrence(spark, src, sink, ck) == 1
    got = spark.read.parquet(sink).groupBy("image_id", "word_id").agg(F.sum("f").alias("f")).collect()
    assert {(r["image_id"], r["f"]) for r in got} == {(1, 3), (2, 1)}
    drain(spark, src, "image_id long, word_id int", lambda d: d.where("word_id = 5"), str(tmp_path / "s2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "s2")).count() == 3


def test_command_line(spark, tmp_path, capsys):
    from wordloom.plans import cli

    assert cli.main(["--list-approaches"]) == 0
    assert "vit_bovw" in capsys.readouterr().out
    assert cli.main(["--dataset-dir", str(tmp_path / "nothing")]) == 1
    assert "FATAL" in capsys.readouterr().err
    r = np.random.default_rng(0)
    for c in ("x", "y"):
        (tmp_path / "set" / c).mkdir(parents=True)
        for i in range(6):
            noisy_bmp(tmp_path / "set" / c / f"{i}.bmp", r, c == "x")
    args = ["--dataset-dir", str(tmp_path / "set"), "--output-dir", str(tmp_path / "out"), "--set", "vocabulary.k=4", "--set", "data.image_size=32", "--set", 'classifiers.enabled=["knn"]', "--set", 'runtime.metrics=["accuracy"]']
    assert cli.main(args) == 0
    assert "bovw_baseline" in capsys.readouterr().out
    assert list((tmp_path / "out").glob("comparison_*/part-*.csv"))


def noisy_bmp(path, r, fine):
    import struct

    w = h = 32
    a = r.integers(0, 255, (h, w) if fine else (h // 8, w // 8), dtype=np.uint8)
    a = a if fine else np.kron(a, np.ones((8, 8), np.uint8))
    body = np.repeat(a[:, :, None], 3, axis=2).tobytes()
    path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body)


def test_artifacts(spark, tmp_path):
    from wordloom.sources import artifacts

    words = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "word_id int, center array<double>")
    path = str(tmp_path / "v")
    assert not artifacts.is_valid(spark, path)
    artifacts.save_vocabulary(words, path, 42, "cosine")
    got, settings = artifacts.load_vocabulary(spark, path)
    assert artifacts.is_valid(spark, path)
    assert sorted(got.collect()) == sorted(words.collect())
    assert settings == {"k": 2, "seed": 42, "metric": "cosine"}
    p = spark.createDataFrame([("a", "x", "x", {"x": 0.9, "y": 0.1})], "image_id string, true_label string, predicted_label string, proba map<string,double>")
    artifacts.save_predictions(p, str(tmp_path / "p"), ["x", "y"])
    assert artifacts.load_predictions(spark, str(tmp_path / "p")).collect() == p.collect()
    c = config.Config()
    before = config.training_hash(c)
    c.classifiers.enabled = ["knn"]
    assert config.training_hash(c) == before
    c.runtime.seed = 7
    assert config.training_hash(c) != before
