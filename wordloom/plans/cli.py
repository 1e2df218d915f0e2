"""python -m wordloom.plans.cli --dataset-dir DIR --approach NAME [--config FILE] [--set a.b=value ...]"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.classify import CLASSIFIERS
from wordloom.plans import approaches, config, report
from wordloom.plans.checkpoint import Steps
from wordloom.sources import images, keypoints, networks

def extractor_of(table: str, f: config.Features):
    """The extractor that makes a descriptor table."""
    if table == "sift":
        return lambda imgs: [keypoints.sift_descriptors(i, f.sift_contrast, f.sift_edge, f.sift_most) for i in imgs]
    tag, _, whole = table.partition("_")
    settings = f.network(tag)
    if settings is None:
        raise ValueError(f"{table} needs features.{tag}_weights (an .npz file), or features.seeded=true for a dry run")
    return networks.extractor(tag, whole or "local", f.batch, **settings)


def needed(approach: str) -> list[str]:
    tag = approaches.APPROACHES[approach].keywords["tag"]
    return {"bag_of_words": [tag], "selected_words": [tag], "reconstructed": [tag, f"{tag}_global"], "end_to_end": [f"{tag}_global"]}[approaches.APPROACHES[approach].func.__name__]


def inputs_of(spark: SparkSession, scanned: DataFrame, root: str, c: config.Config, tables: list[str], steps: Steps) -> approaches.Inputs:
    """Labels and the descriptor tables of one dataset, each a resumable step."""
    scanned = images.require_images(scanned, root)
    pixels = images.decode(spark, root).join(scanned.select("path", "image_id"), "path").select("image_id", "pixels")
    name = c.data.dataset_name
    small = steps.step(f"{name}_preprocess", c.data.image_size, lambda: images.preprocess(pixels, c.data.image_size), [root])
    out = {"labels": scanned.select("image_id", "class")}
    for t in tables:
        made = steps.step(f"{name}_{t}", [c.data.image_size, dataclasses.asdict(c.features)], lambda t=t: images.describe(small, extractor_of(t, c.features)), [root])
        out[t] = made.select("image_id", "vec") if t.endswith("_global") else made
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wordloom", description="Compare image-classification approaches over labelled folders.")
    where = p.add_mutually_exclusive_group()
    where.add_argument("--dataset-dir")
    where.add_argument("--datasets-root")
    p.add_argument("--approach", action="append", choices=sorted(approaches.APPROACHES))
    p.add_argument("--config")
    p.add_argument("--set", action="append", default=[], metavar="a.b=value")
    p.add_argument("--output-dir")
    p.add_argument("--list-approaches", action="store_true")
    p.add_argument("--list-classifiers", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.list_approaches or a.list_classifiers:
        print("\n".join([*(approaches.APPROACHES if a.list_approaches else ()), *(CLASSIFIERS if a.list_classifiers else ())]))
        return 0
    try:
        c = config.override(config.load(a.config) if a.config else config.Config(), a.set)
        if a.output_dir:
            c.data.output_dir = a.output_dir
        root = a.datasets_root or a.dataset_dir or c.data.dataset_dir
        if not root:
            raise ValueError("give --dataset-dir or --datasets-root")
        spark = SparkSession.builder.appName("wordloom").getOrCreate()
        names = a.approach or ["bovw_baseline"]
        run_id = config.ensure_run_id(c)
        steps = Steps(spark, f"{c.data.output_dir}/steps")
        tables = sorted({t for n in names for t in needed(n)})
        scanned = images.scan(spark, root, many=bool(a.datasets_root))
        if a.datasets_root:
            found = [r["dataset"] for r in images.datasets(scanned).orderBy("dataset").collect()]  # a row per dataset folder
            if not found:
                raise ValueError(f"no datasets under {root}")
        else:
            found = [c.data.dataset_name]
        out = None
        for name in found:
            c.data.dataset_name = name
            own_root = f"{root.rstrip('/')}/{name}" if a.datasets_root else root
            own = scanned.where(F.col("dataset") == name) if a.datasets_root else scanned
            one = approaches.run_all(inputs_of(spark, own, own_root, c, tables, steps), c, names)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        out = steps.step("comparison", [run_id, found, names], lambda: out, [root])
        report.save(out, c.data.output_dir, run_id if not a.datasets_root else None)
        report.show(out)
    except Exception as e:  # noqa: BLE001  one line for whoever called, the trace is in the log
        print(f"FATAL: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
