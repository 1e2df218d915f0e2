"""Run configuration: dataclasses, checked when made; overrides by dotted names; content hashes."""

from __future__ import annotations

import dataclasses as D
import hashlib
import json
from typing import Any

STRATEGY_NAMES, MODES = ("GCF", "ICC", "CED"), ("weighted", "legacy")


@D.dataclass
class Data:
    dataset_dir: str = ""
    dataset_name: str = "dataset"
    output_dir: str = "output"
    image_size: int = 128


@D.dataclass
class Features:
    """Weights are .npz files; `seeded` allows networks without any, for dry runs. *_settings go to the networks."""

    sift_most: int = 0
    sift_contrast: float = 0.04
    sift_edge: float = 10.0
    cnn_weights: str | None = None
    cnn_settings: dict = D.field(default_factory=dict)
    vit_weights: str | None = None
    vit_settings: dict = D.field(default_factory=dict)
    batch: int = 32
    seeded: bool = False

    def network(self, tag: str) -> dict | None:
        """The settings of a network, or None if it can't be made."""
        path, settings = (self.cnn_weights, self.cnn_settings) if tag == "cnn" else (self.vit_weights, self.vit_settings)
        return {**settings, **({"weights": path} if path else {})} if path or self.seeded else None


@D.dataclass
class Vocabulary:
    k: int = 256
    seed: int = 42
    max_iter: int = 100
    batch: int | None = 1000


@D.dataclass
class Reduction:
    method: str = "none"
    dim: int = 10
    neighbours: int = 15
    min_dist: float = 0.0


@D.dataclass
class Density:
    min_cluster_size: int = 5
    min_samples: int = 1


@D.dataclass
class Selection:
    strategies: list = D.field(default_factory=lambda: list(STRATEGY_NAMES))
    n_candidates_per_class: int = 50
    mode: str = "weighted"
    candidate_pool_size: int | None = None
    position_top_n: int = 5
    images_per_class: int | None = None


@D.dataclass
class Classifiers:
    enabled: list = D.field(default_factory=lambda: ["mlp", "svc", "decision_tree", "logistic_regression", "xgboost", "naive_bayes"])
    naive_bayes_variant: str = "multinomial"
    knn_k: int = 5


@D.dataclass
class Runtime:
    test_size: float = 0.2
    seed: int = 42
    metrics: list = D.field(default_factory=list)


@D.dataclass
class Config:
    data: Data = D.field(default_factory=Data)
    features: Features = D.field(default_factory=Features)
    vocabulary: Vocabulary = D.field(default_factory=Vocabulary)
    reduction: Reduction = D.field(default_factory=Reduction)
    density: Density = D.field(default_factory=Density)
    selection: Selection = D.field(default_factory=Selection)
    classifiers: Classifiers = D.field(default_factory=Classifiers)
    runtime: Runtime = D.field(default_factory=Runtime)
    run_id: str | None = None

    def __post_init__(self) -> None:
        check(self)


def check(c: Config) -> None:
    from wordloom.operators.classify import CLASSIFIERS

    wrong = [
        (" " in c.data.dataset_name, "dataset_name must not hold spaces"),
        (c.selection.mode not in MODES, f"mode must be one of {MODES}"),
        (c.reduction.method not in ("none", "pca", "umap"), "reduction.method must be none, pca or umap"),
        (not 0 < c.runtime.test_size < 1, "test_size must lie between 0 and 1"),
        (c.vocabulary.k < 1 or c.density.min_cluster_size < 2 or c.density.min_samples < 1, "k, min_cluster_size and min_samples must be 1, 2 and 1 at least"),
        (c.classifiers.naive_bayes_variant not in ("multinomial", "gaussian"), "naive_bayes_variant must be multinomial or gaussian"),
        (c.selection.images_per_class is not None and c.selection.images_per_class < 1, "images_per_class must be 1 at least"),
        (bool(set(c.selection.strategies) - set(STRATEGY_NAMES)), f"strategies are {STRATEGY_NAMES}"),
        (bool(set(c.classifiers.enabled) - set(CLASSIFIERS)), f"classifiers are {CLASSIFIERS}"),
    ]
    for bad, why in wrong:
        if bad:
            raise ValueError(why)


def from_dict(raw: dict) -> Config:
    """Unknown names are errors."""
    made: dict[str, Any] = {}
    fields = {f.name: f for f in D.fields(Config)}
    for name, value in raw.items():
        if name not in fields:
            raise ValueError(f"unknown section {name!r}")
        kind = globals().get(name.capitalize())
        if kind and D.is_dataclass(kind):
            unknown = set(value) - {f.name for f in D.fields(kind)}
            if unknown:
                raise ValueError(f"unknown {name} fields {sorted(unknown)}")
            value = kind(**value)
        made[name] = value
    return Config(**made)


def load(path: str) -> Config:
    import yaml

    with open(path) as f:
        return from_dict(yaml.safe_load(f) or {})


def override(c: Config, settings: list[str]) -> Config:
    """settings: a.b=value, value as YAML or JSON."""
    raw = D.asdict(c)
    for s in settings:
        name, _, value = s.partition("=")
        at, *path = name.split(".")
        if at not in raw or (path and path[0] not in (raw[at] or {})):
            raise ValueError(f"unknown setting {name!r}")
        try:
            parsed = json.loads(value)
        except json.JSONDecodeError:
            parsed = value
        if path:
            raw[at][path[0]] = parsed
        else:
            raw[at] = parsed
    return from_dict(raw)


def content_hash(value: Any) -> str:
    """First 10 hex digits of the sha256 of sorted JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:10]


def training_hash(c: Config, strategy: str | None = None) -> str:
    """What a stored prediction depends on; which other classifiers are enabled isn't part of it."""
    raw = D.asdict(c)
    raw["classifiers"].pop("enabled")
    return content_hash([{k: raw[k] for k in ("features", "vocabulary", "reduction", "density", "selection", "classifiers")}, c.runtime.test_size, c.runtime.seed, strategy])


def ensure_run_id(c: Config) -> str:
    if not c.run_id:
        c.run_id = f"{c.data.dataset_name}_{content_hash(D.asdict(c) | {'run_id': None})}"
    return c.run_id
