"""Two-pass external shuffle into shards.

Pass one scatters records into buckets by a seeded hash; the number of buckets follows the bytes of the input, so
each bucket fits in a task's memory. Pass two puts each bucket in a fixed order, permutes it by Fisher-Yates with a
generator seeded by (seed, bucket), and numbers the records: a record's global place is its bucket's offset plus its
place in the bucket, its shard is place mod shards, its slot place div shards. Shard counts differ by one at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F, types as T

from palimpsest.llm.scratch import Scratch

BUCKET, PLACE, SHARD, SLOT = "_shuffle_bucket", "_shuffle_place", "shard", "slot"


def _fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n places: numpy's Generator.shuffle is Fisher-Yates."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def two_pass_shuffle(df: DataFrame, key: str, text: str, shards: int = 16, seed: int = 7, bucket_bytes: int = 16 << 20, min_buckets: int = 64) -> DataFrame:
    """df's columns with shard int and slot long, every row once.

    Rows are scattered by a hash of key and text together, so neither a frequent key nor a group of equal texts can
    fill a bucket; whole rows that repeat are told apart by their row number in the file they are read from, which a
    retried task reads alike. Null keys and texts hash like any value. Columns named shard or slot are replaced. An
    empty table gives an empty result.
    """
    spark = df.sparkSession
    base = df.drop(SHARD, SLOT, BUCKET, PLACE)
    total = base.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64)).alias("b")).first()["b"] or 0
    buckets = max(min_buckets, math.ceil(total / bucket_bytes))
    salt = F.col("_metadata.row_index") if _has_files(base) else F.lit(0)
    scattered = base.withColumn(BUCKET, F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text), salt), F.lit(buckets)).cast("int"))
    schema = T.StructType([*scattered.schema.fields, T.StructField(PLACE, T.LongType())])
    names = [f.name for f in base.schema.fields]
    by = [key, *[c for c in names if c != key and isinstance(base.schema[c].dataType, (T.StringType, T.LongType, T.IntegerType))]]

    def shuffled(t: pa.Table) -> pa.Table:
        b = t.column(BUCKET)[0].as_py()
        t = t.take(pc.sort_indices(t.select(by), sort_keys=[(c, "ascending") for c in by]))
        return t.take(_fisher_yates(t.num_rows, seed, b)).append_column(PLACE, pa.array(np.arange(t.num_rows)))

    scratch = Scratch(spark, "shuffle")
    placed = scratch.save(scattered.repartition(buckets, BUCKET).groupBy(BUCKET).applyInArrow(shuffled, schema), "placed")
    offsets = _offsets(placed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_n")))
    # one row of 16 bytes for each bucket_bytes of input
    at = F.col("_before") + F.col(PLACE)
    joined = placed.join(F.broadcast(offsets) if buckets <= 1_000_000 else offsets, BUCKET)
    return joined.select(*names, F.pmod(at, F.lit(shards)).cast("int").alias(SHARD), F.floor(at / F.lit(shards)).cast("long").alias(SLOT))


def _offsets(counts: DataFrame, group: int = 4096) -> DataFrame:
    """(bucket, _before): rows in the buckets before, summed within groups of buckets and over groups."""
    part = F.floor(F.col(BUCKET) / group)
    within = Window.partitionBy("_group").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # one row for `group` buckets
    counts = counts.withColumn("_group", part)
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_g")).withColumn("_first", F.coalesce(F.sum("_g").over(over), F.lit(0))).select("_group", "_first")
    counts = counts.withColumn("_inner", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return counts.join(groups, "_group").select(BUCKET, (F.col("_first") + F.col("_inner")).alias("_before"))


def _has_files(df: DataFrame) -> bool:
    """Whether df is read straight from files, whose rows have numbers."""
    try:
        df.select("_metadata.row_index")
        return True
    except AnalysisException:
        return False


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder a shard, each sorted by slot."""
    shuffled.repartition(SHARD).sortWithinPartitions(SHARD, SLOT).write.partitionBy(SHARD).parquet(path)
