"""Bound-certified best-fit packing.

Each partition packs its pieces by best-fit decreasing and compares the number of bins with a lower bound from dual
feasible functions. A partition that meets its bound is certified: no packing of those pieces does better. The others
have a gap; their bins that are not full, and the emptiest bin of every partition, go to a pool that is dealt out anew
(whole bins together, so that the packing so far stays valid) and packed again. A rerun is taken only if it needs fewer
bins. Rounds end when the pool fits one partition, or after `rounds`. A table of at most `part_rows` pieces is one
best-fit decreasing pass. The bound of the whole table, from its lengths' counts, goes with every row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from palimpsest.llm.scratch import Scratch

PART, BIN, OPEN = "_pack_part", "_pack_bin", "_pack_open"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing of lengths needs."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs of count[n] pieces of length n: the best of three families of dual feasible functions.

    Those are u_k (rounding with k), the threshold family that lifts lengths above capacity - t to a whole bin and drops
    those below t, and the identity. It costs 200 * capacity at most, however many pieces there are.
    """
    if not count.sum():
        return 0
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # threshold family: sizes over capacity - t fill a bin, sizes in [t, capacity - t] count as they are
    whole = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])
    area = np.concatenate([[0], np.cumsum(count * size)])
    for t in range(1, capacity // 2 + 1):
        mid = area[capacity - t + 1] - area[t]
        best = max(best, int(whole[capacity - t + 1]) - (-int(mid) // capacity))
    for k in range(1, 101):
        x = (k + 1) * size
        scaled = np.where(x % capacity == 0, size * k, (x // capacity) * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece; pieces go longest first, each to the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    live, made = 0, 0  # live: bit r set if a bin has r free
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fit = live >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                live &= ~(1 << r)
        else:
            r, b, made = capacity, made, made + 1
        bins[i] = b
        if left := r - n:
            room[left].append(b)
            live |= 1 << left
    return bins


def _packer(capacity: int, round_no: int, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    return lambda t: _pack_group(t, capacity, round_no, names)


def _pack_group(t: pa.Table, capacity: int, round_no: int, names: list[str]) -> pa.Table:
    part = t.column(PART)[0].as_py()
    by = [c for c in names if not pa.types.is_nested(t.schema.field(c).type)]
    t = t.take(pc.sort_indices(t.select(by), sort_keys=[(c, "ascending") for c in by]))
    lengths = t.column("length").to_numpy()
    old = t.column(BIN).to_numpy()
    bins = best_fit_decreasing(lengths, capacity)
    ids = (np.int64(round_no) << 56) | (np.int64(part) << 24) | bins
    if round_no and len(np.unique(old)) <= len(np.unique(bins)):
        ids = old
    _, at = np.unique(ids, return_inverse=True)
    fill = np.bincount(at, weights=lengths).astype(np.int64)
    bound = lower_bound(lengths, capacity)
    again = (fill < capacity) if len(fill) > bound else np.arange(len(fill)) == int(fill.argmin())
    again &= fill < capacity
    t = t.set_column(t.schema.get_field_index(BIN), BIN, pa.array(ids))
    return t.append_column(OPEN, pa.array(again[at]))


def pack(pieces: DataFrame, capacity: int = 1024, part_rows: int = 65_536, rounds: int = 4) -> DataFrame:
    """pieces' columns with sequence_id long, offset long and lower_bound long; needs a length column of 1 to capacity.

    lower_bound is the number of sequences that any packing of the whole table needs, the same in every row. All other
    columns travel along; those that are not nested order pieces of equal length, so that a retried task packs alike.
    Rows that repeat are packed each. Columns named sequence_id, offset or lower_bound are replaced. Pieces whose
    length is null or out of range raise an error. An empty table gives an empty result.
    """
    scratch = Scratch(pieces.sparkSession, "pack")
    base = pieces.drop("sequence_id", "offset", "lower_bound", PART, BIN, OPEN)
    names = base.columns
    seen = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.lit(f"length must be 1 to {capacity}")))
    base = scratch.save(base.withColumn("length", seen.cast("long")), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in base.groupBy("length").count().collect():  # capacity rows at most
        counts[r["length"]] = r["count"]
    bound, n = bound_of(counts, capacity), int(counts.sum())
    todo = base.withColumn(BIN, F.xxhash64(*names))
    done: list[DataFrame] = []
    for r in range(rounds):
        parts = max(1, math.ceil(n / part_rows))
        dealt = todo.withColumn(PART, F.pmod(F.xxhash64(F.lit(r), BIN), F.lit(parts)).cast("int"))
        schema = T.StructType([*dealt.schema.fields, T.StructField(OPEN, T.BooleanType())])
        packed = scratch.save(dealt.groupBy(PART).applyInArrow(_packer(capacity, r, names), schema), f"round{r}")
        n = 0 if parts == 1 or r == rounds - 1 else packed.where(OPEN).count()
        if not n:
            done.append(packed.select(*names, BIN))
            break
        done.append(packed.where(~F.col(OPEN)).select(*names, BIN))
        todo = packed.where(OPEN).select(*names, BIN)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return _offsets(out, names).withColumn("lower_bound", F.lit(bound).cast("long"))


def _offsets(packed: DataFrame, names: list[str]) -> DataFrame:
    """Places in each sequence; a sequence has capacity pieces at most."""
    from pyspark.sql import Window

    rest = [c for c in names if c != "length" and not isinstance(packed.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType))]
    w = Window.partitionBy(BIN).orderBy(F.desc("length"), *rest).rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long")).select(*names, F.col(BIN).alias("sequence_id"), "offset")
