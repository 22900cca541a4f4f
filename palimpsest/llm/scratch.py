"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def let_workers_import(spark: SparkSession) -> None:
    """Python workers started from here on find this package where the driver found it, unless it was shipped."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where that is unset in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def least_hashed(df: DataFrame, n: int, *columns: str, seed: int = 0) -> DataFrame:
    """At most n rows that differ in columns, those of the least seeded hashes of columns; all, if there are no more.

    Among many different ones a bound on the hash leaves about 2 n first, so that the last sort meets no more than that,
    however many partitions there are. Copies share a hash, so the bound is set by the number of different hashes.
    """
    h = F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40))
    total = df.agg(F.approx_count_distinct(h)).first()[0]
    if total > 4 * n:
        df = df.where(h < int((1 << 40) * (2 * n + 30) / total))  # 30: fewer than n are left by no chance, small n or not
    return df.dropDuplicates(list(columns)).orderBy(h, *columns).limit(n)


class Scratch:
    """Parquet tables under the shared folder, one directory per job.

    save() writes a table and returns a reader of it; saving again under the same name drops the version
    before the previous one, so that a loop that reads version n while it writes n + 1 keeps two at most.
    """

    def __init__(self, spark: SparkSession, job: str) -> None:
        let_workers_import(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        self.versions: dict[str, list[str]] = {}
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{name}-{self.count}"
        df.write.parquet(path)
        kept = self.versions.setdefault(name, [])
        kept.append(path)
        while len(kept) > 2:
            self._delete(kept.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        for path in self.versions.pop(name, []):
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
