"""A stored key-value table: sorted runs in levels, each a Parquet folder, and a manifest that says which are live.

``put`` writes a batch of changes (key, seq, op, value) as one run of level 0. When a level has ``growth`` runs, they and
nothing else are merged into one run of the next level, so a change is rewritten once a level. A run is range-sorted by key with a
Bloom filter on it, so a lookup skips what can't hold its keys. A manifest is written after its runs and never changed:
a reader has the newest whole one, and a writer that fails leaves the table as it was. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import kv


@dataclass
class Store:
    """``rule`` merges (older, newer) values under one key; without it the newest change counts."""

    spark: SparkSession
    path: str
    growth: int = 4
    rule: Callable[[Column, Column], Column] | None = None

    def __post_init__(self) -> None:
        if self.growth < 2:
            raise ValueError("a level must hold two runs or more")

    # --- the manifest: runs by level, the newest last in each ---

    def _files(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return jvm, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        _, folder, files = self._files()
        return sorted(int(x.getPath().getName()) for x in files.listStatus(folder) if x.getPath().getName().isdigit()) if files.exists(folder) else []

    @property
    def levels(self) -> list[list[str]]:
        versions = self._versions()
        if not versions:
            return []
        rows = self.spark.read.text(f"{self.path}/manifests/{versions[-1]}", wholetext=True).collect()  # one row
        return json.loads(rows[0].value)

    def _commit(self, levels: list[list[str]]) -> None:
        """Written aside and renamed, so a manifest is whole or absent."""
        jvm, folder, files = self._files()
        versions = self._versions()
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = files.create(aside)
        out.write(bytearray(json.dumps(levels).encode()))
        out.close()
        if not files.rename(aside, jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{(versions or [0])[-1] + 1}")):
            raise RuntimeError("another writer has committed")

    # --- runs ---

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        dealt = rows.select("key", "seq", "op", "value").repartitionByRange("key").sortWithinPartitions("key", "seq")
        dealt.write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/runs/{name}")
        return name

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/runs/{n}" for n in names))

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One change for each key; deletions stay, as an older run may hold the key."""
        if self.rule is None:
            return kv.compact(rows)
        return kv.folded_log(rows, self.rule)

    def put(self, changes: DataFrame) -> None:
        """Flush a batch as a run, then merge the levels that are full. Its seqs must be above those before."""
        levels = self.levels or [[]]
        levels[0].append(self._write(self._merged(changes)))
        at = 0
        while len(levels[at]) >= self.growth:
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append(self._write(self._merged(self._read(levels[at]))))
            levels[at] = []
            at += 1
        self._commit(levels)

    def compact(self) -> None:
        """All runs as one, on the last level."""
        names = [n for level in self.levels for n in level]
        if len(names) > 1:
            self._commit([[] for _ in self.levels[1:]] + [[self._write(self._merged(self._read(names)))]])

    def vacuum(self) -> None:
        """Delete the runs that the newest manifest doesn't name, and older manifests; no reader may be using them."""
        jvm, _, files = self._files()
        live = {n for level in self.levels for n in level}
        runs = jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        for x in files.listStatus(runs) if files.exists(runs) else []:
            if x.getPath().getName() not in live:
                files.delete(x.getPath(), True)
        for version in self._versions()[:-1]:
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{version}"), False)

    # --- reading ---

    def log(self) -> DataFrame | None:
        names = [n for level in self.levels for n in level]
        return self._read(names) if names else None

    def _live(self, rows: DataFrame) -> DataFrame:
        return self._merged(rows).where("op = 'put'").select("key", "value")

    def all(self) -> DataFrame:
        return self._live(self._held())

    def get(self, *keys) -> DataFrame:
        """key and value of some keys, null for those without one."""
        state = self._live(self._held().where(F.col("key").isin(*keys)))
        asked = self.spark.createDataFrame([(k,) for k in keys], f"key {self._held().schema['key'].dataType.simpleString()}")
        return asked.join(state, "key", "left")

    def scan(self, low, high) -> DataFrame:
        return self._live(self._held().where(F.col("key").between(low, high)))

    def _held(self) -> DataFrame:
        rows = self.log()
        if rows is None:
            raise ValueError("nothing has been put")
        return rows
