"""Resumable steps: results are Parquet under <dir>/<step>/<hash of settings and inputs>, with a manifest beside.

A step is done if its folder holds _SUCCESS; changed settings or inputs have another hash and so another folder, and
a deleted folder is made again. RUNNING left by a crash runs again."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from wordloom.plans.config import content_hash

log = logging.getLogger("wordloom")


class Steps:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        _, p, fs = self._fs(path)
        return fs.exists(p)

    def _write(self, path: str, text: str) -> None:
        """By a temporary file and a rename over the old one, which stays until then."""
        jvm, p, _ = self._fs(path)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if p.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())
        temp = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
        _, _, fs = self._fs(path)
        out = fs.create(temp, True)
        out.write(text.encode())
        out.close()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(temp, p, over)

    def status(self, name: str) -> dict | None:
        path = f"{self.folder}/{name}.json"
        if not self.exists(path):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(path).collect()))

    def _mark(self, name: str, status: str, key: str, **more: Any) -> None:
        self._write(f"{self.folder}/{name}.json", json.dumps({"name": name, "status": status, "config_hash": key, "timestamp": datetime.now(UTC).isoformat(), **more}))

    def fingerprint(self, paths: list[str]) -> str:
        """Names, sizes and times of the files under paths."""
        found = []
        for path in paths:
            jvm, p, fs = self._fs(path)
            files = fs.listFiles(p, True)
            while files.hasNext():
                f = files.next()
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return content_hash(sorted(found))

    def step(self, name: str, settings: Any, make: Callable[[], DataFrame], inputs: list[str] = ()) -> DataFrame:
        key = content_hash([settings, self.fingerprint(list(inputs)) if inputs else None])
        path = f"{self.folder}/{name}/{key}"
        if self.exists(f"{path}/_SUCCESS"):
            log.info("step %s: taken from %s", name, path)
            return self.spark.read.parquet(path)
        self._mark(name, "RUNNING", key)
        began = time.time()
        try:
            make().write.mode("overwrite").parquet(path)
        except Exception as e:
            self._mark(name, "FAILED", key, error=str(e)[:2000])
            raise
        self._mark(name, "DONE", key, duration_seconds=round(time.time() - began, 3), path=path)
        return self.spark.read.parquet(path)
