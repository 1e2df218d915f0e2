import numpy as np
import pytest

from wordloom.plans import approaches, cli, config
from wordloom.sources import images, keypoints, networks

SMALL = {"cnn": {"narrow": 16, "size": 64}, "vit": {"size": 32, "patch": 8, "dim": 32, "layers": 2, "heads": 4, "hidden": 64}}


def blobs(n=96, spots=((30, 34, 4, 180), (60, 64, 7, 150), (25, 70, 3, 200))):
    y, x = np.mgrid[:n, :n]
    return sum(v * np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * s * s)) for a, b, s, v in spots).clip(0, 255).astype(np.uint8)


def test_keypoints_lie_on_blobs_at_their_scale():
    found = keypoints.keypoints(blobs())
    for a, b, s, _ in ((30, 34, 4, 0), (60, 64, 7, 0), (25, 70, 3, 0)):
        assert any(abs(k[0] - a) < 0.6 and abs(k[1] - b) < 0.6 and 0.7 < k[2] / s < 1.3 for k in found)
    assert keypoints.keypoints(np.full((64, 64), 90, np.uint8)) == []
    assert keypoints.sift_descriptors(np.full((64, 64, 3), 90, np.uint8)).shape == (0, 128)


def test_descriptors_stand_turns():
    """A turned image has the same descriptors at the turned places, its angles turned along."""
    r = np.random.default_rng(0)
    img = np.kron(r.integers(0, 255, (16, 16)), np.ones((8, 8))).astype(np.uint8)
    img = images.resize_area(img[:, :, None], 96)[:, :, 0]
    one, two = keypoints.keypoints(img), keypoints.keypoints(np.rot90(img).copy())
    assert len(one) > 20
    near = 0
    for y, x, s, _, d in one:
        same = [k for k in two if abs(k[0] - (95 - x)) < 1.5 and abs(k[1] - y) < 1.5 and 0.8 < k[2] / s < 1.25]
        near += any(np.linalg.norm(k[4] - d) < 0.25 * np.linalg.norm(d) for k in same)
    assert near > 0.85 * len(one)
    d = np.array([k[4] for k in one])
    assert d.min() >= 0 and d.max() <= 255 and (np.linalg.norm(d, axis=1) > 400).all()


def plain_conv(x, kernel, stride, pad):
    x = np.pad(x, ((0, 0), (pad, pad), (pad, pad)))
    out, _, k, _ = kernel.shape
    rows = (x.shape[1] - k) // stride + 1
    got = np.zeros((out, rows, rows))
    for o in range(out):
        for i in range(rows):
            for j in range(rows):
                got[o, i, j] = (x[:, i * stride : i * stride + k, j * stride : j * stride + k] * kernel[o]).sum()
    return got


def test_convolution_against_loops():
    class W:
        def __call__(self, name, shape, fill=None):
            return {"weight": np.array([2.0, 1.0]), "bias": np.array([0.5, -0.5]), "running_mean": np.array([0.1, 0.2]), "running_var": np.array([4.0, 1.0])}[name.split(".")[-1]] if "bn" in name else r.normal(size=shape)

    for k, stride, pad in ((3, 1, 1), (5, 2, 2), (1, 1, 0)):
        r = np.random.default_rng(k)
        x = r.normal(size=(1, 3, 11, 11))
        got = networks.GoogLeNet._conv(W(), "c", 3, 2, k, stride, pad)(x)[0]
        kernel = np.random.default_rng(k)
        kernel.normal(size=(1, 3, 11, 11))
        want = plain_conv(x[0], kernel.normal(size=(2, 3, k, k)), stride, pad)
        for o, (g, b, m, v) in enumerate(((2.0, 0.5, 0.1, 4.0), (1.0, -0.5, 0.2, 1.0))):
            assert got[o] == pytest.approx(np.maximum((want[o] - m) / np.sqrt(v + 1e-3) * g + b, 0))


def test_pools_reach_the_border():
    x = np.arange(49.0).reshape(1, 1, 7, 7)
    assert networks.max_pool(x, 3, 2).shape == (1, 1, 3, 3)
    x = np.arange(64.0).reshape(1, 1, 8, 8)
    assert networks.max_pool(x, 3, 2)[0, 0].tolist() == [[18, 20, 22, 23], [34, 36, 38, 39], [50, 52, 54, 55], [58, 60, 62, 63]]


def test_attention_against_loops():
    net = networks.network("vit", **SMALL["vit"])
    r = np.random.default_rng(1)
    x, p = r.normal(size=(1, 5, 32)).astype(np.float32), net.layers[0]
    qkv = x[0] @ p["self_attention.in_proj_weight"].T
    want = np.zeros((5, 32))
    for h in range(4):
        q, k, v = (qkv[:, 32 * i + 8 * h : 32 * i + 8 * h + 8] for i in range(3))
        for t in range(5):
            e = np.exp([q[t] @ k[u] / 8**0.5 for u in range(5)])
            want[t, 8 * h : 8 * h + 8] = sum(w * v[u] for u, w in enumerate(e / e.sum()))
    assert net._attend(x, p)[0] == pytest.approx(want @ p["self_attention.out_proj.weight"].T, abs=1e-3)


def test_features_tails_and_weights(tmp_path):
    r = np.random.default_rng(2)
    imgs = [r.integers(0, 255, (50, 40, 3), dtype=np.uint8) for _ in range(3)] + [r.integers(0, 255, (50, 40, 1), dtype=np.uint8)]
    cnn = networks.network("cnn", **SMALL["cnn"])
    local, whole = cnn.features(imgs)
    assert local.shape[:2] == (4, 16) and whole.shape == (4, 64)
    assert cnn.tail(local) == pytest.approx(whole, abs=1e-5)  # real activations through the tail are the global vectors
    with pytest.raises(ValueError, match="square"):
        cnn.tail(local[:, :15])
    with pytest.raises(ValueError, match="tail"):
        networks.network("cnn", local="inception4d", **SMALL["cnn"]).tail(local)
    with pytest.raises(ValueError, match="no layer"):
        networks.GoogLeNet(local="conv9")
    vit = networks.network("vit", **SMALL["vit"])
    tokens, cls = vit.features(imgs)
    assert tokens.shape == (4, 16, 32) and cls.shape == (4, 32) == vit.tail(tokens).shape
    with pytest.raises(ValueError, match="places"):
        vit.tail(tokens[:, :9])
    assert networks.network("vit", **SMALL["vit"]) is vit  # made once

    drawn = {}
    real = networks._Weights.__call__
    networks._Weights.__call__ = lambda self, name, shape, fill=None: drawn.setdefault(name, real(self, name, shape, fill))
    try:
        networks.GoogLeNet(seed=5, **SMALL["cnn"])
    finally:
        networks._Weights.__call__ = real
    np.savez(tmp_path / "w.npz", **drawn)
    again = networks.GoogLeNet(weights=str(tmp_path / "w.npz"), **SMALL["cnn"])
    assert (again.features(imgs)[1] == networks.GoogLeNet(seed=5, **SMALL["cnn"]).features(imgs)[1]).all()
    with pytest.raises(ValueError, match="hold no"):
        networks.GoogLeNet(weights=str(tmp_path / "w.npz"), narrow=8, size=64)


def test_lightness_is_equalised_and_colours_stay():
    r = np.random.default_rng(3)
    img = r.integers(0, 255, (40, 40, 3), dtype=np.uint8)
    assert np.abs(images.from_lab(images.to_lab(img)).astype(int) - img).mean() < 2
    assert images.to_lab(np.array([[[255, 255, 255], [0, 0, 0], [0, 0, 255]]], np.uint8)).tolist() == [[[255, 128, 128], [0, 128, 128], [136, 208, 195]]]
    dull = np.clip(images.resize_area(img, 128) // 4 + 60, 0, 255).astype(np.uint8)
    got = images.preprocess_image(dull, 128)
    assert images.to_lab(got)[..., 0].std() > 1.5 * images.to_lab(dull)[..., 0].std()
    assert np.abs(images.to_lab(got)[..., 1:].astype(int) - images.to_lab(dull)[..., 1:]).mean() < 4


def test_features_by_tables_and_network_tails(spark):
    r = np.random.default_rng(4)
    rows = [(f"{c}__{i}", (48, 48, 3, bytearray((np.kron(r.integers(0, 255, (6, 6, 3)), np.ones((8, 8, 1))) // (1 + (c == "b") * 2)).astype(np.uint8).tobytes()))) for c in "ab" for i in range(10)]
    pixels = spark.createDataFrame(rows, "image_id string, pixels struct<height:int,width:int,channels:int,data:binary>").cache()
    c = config.override(config.Config(), ["features.seeded=true", "features.cnn_settings=" + str(SMALL["cnn"]).replace("'", '"'), "features.vit_settings=" + str(SMALL["vit"]).replace("'", '"')])
    with pytest.raises(ValueError, match="weights"):
        cli.extractor_of("cnn", config.Features())
    made = {t: images.describe(pixels, cli.extractor_of(t, c.features)).cache() for t in ("sift", "cnn", "cnn_global", "vit", "vit_global")}
    assert {t: made[t].count() for t in ("cnn", "cnn_global", "vit", "vit_global")} == {"cnn": 320, "cnn_global": 20, "vit": 320, "vit_global": 20}
    assert made["sift"].count() > 20
    c.vocabulary.k, c.density.min_cluster_size, c.classifiers.enabled, c.selection.strategies, c.runtime.metrics = 4, 3, ["knn"], ["GCF"], ["accuracy"]
    c.selection.images_per_class = 3
    inputs = {"labels": pixels.selectExpr("image_id", "substring(image_id, 1, 1) AS class")} | {t: d.select("image_id", "vec") if t.endswith("global") else d for t, d in made.items()}
    for name in ("cnn_bovw_cvws", "vit_cvws"):
        (got,) = approaches.run(name, inputs, c).collect()
        assert 0 <= got["accuracy"] <= 1


def test_more_descriptors_than_one_task_clusters(spark):
    from wordloom.operators import cluster

    n = 30_000
    r = spark.range(n).selectExpr("concat(if(id % 2 = 0, 'a', 'b'), '__', cast(id % 400 as string)) AS image_id", "cast(id div 400 as int) AS local_idx", "id % 12 AS blob", "id")
    vec = "transform(sequence(0, 5), k -> cast(if(k = blob % 6, if(blob < 6, 1.0, -1.0), 0.0) + (pmod(xxhash64(id, k), 1000) / 1000.0 - 0.5) * 0.02 as float)) AS vec"
    d = r.selectExpr("image_id", "local_idx", vec).cache()
    assert n > cluster.MOST_POINTS
    c = config.Config()
    c.vocabulary.k, c.classifiers.enabled, c.selection.strategies, c.runtime.metrics, c.density.min_cluster_size = 8, ["knn"], ["GCF"], ["accuracy"], 200
    labels = d.selectExpr("image_id", "substring(image_id, 1, 1) AS class").distinct()
    (got,) = approaches.run("bovw_cvws", {"labels": labels, "sift": d}, c).collect()
    assert 0 <= got["accuracy"] <= 1
