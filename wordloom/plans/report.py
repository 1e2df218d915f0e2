"""Comparison tables to CSV and to the console, and a log file per run."""

from __future__ import annotations

import contextlib
import logging
import time
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.evaluation import comparison_table


def shown(runs: DataFrame) -> DataFrame:
    """The ordered table with RAS where a vocabulary has no size."""
    table = comparison_table(runs)
    return table.withColumn("nb_vw", F.coalesce(F.col("nb_vw").cast("string"), F.lit("RAS"))) if "nb_vw" in table.columns else table


def save(runs: DataFrame, folder: str, name: str | None = None) -> str:
    """One CSV with a header; the name is the run's, or the time."""
    path = f"{folder.rstrip('/')}/comparison_{name or datetime.now().strftime('%Y%m%d-%H%M%S')}"
    shown(runs).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def show(runs: DataFrame, most: int = 1000) -> str:
    rows = shown(runs).limit(most).collect()
    if not rows:
        print(text := "No results to display.")
        return text
    cells = [list(rows[0].asDict())] + [[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    widths = [max(len(r[k]) for r in cells) for k in range(len(cells[0]))]
    print(text := "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells))
    return text


@contextlib.contextmanager
def run_log(path: str) -> Iterator[logging.Logger]:
    """A file of its own for one run: everything to the file, progress to the console."""
    log = logging.getLogger("wordloom")
    log.setLevel(logging.DEBUG)
    to_file, to_console = logging.FileHandler(path), logging.StreamHandler()
    to_console.setLevel(logging.INFO)
    for handler in (to_file, to_console):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    try:
        yield log
    finally:
        for handler in (to_file, to_console):
            log.removeHandler(handler)
            handler.close()


@contextlib.contextmanager
def logged_step(name: str) -> Iterator[None]:
    log, began = logging.getLogger("wordloom"), time.time()
    log.info("%s: begins", name)
    try:
        yield
    except Exception:
        log.exception("%s: failed after %.1f s", name, time.time() - began)
        raise
    log.info("%s: done in %.1f s", name, time.time() - began)
