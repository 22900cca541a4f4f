"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Documents with equal shingle sets form a class; classes are banded by their signatures, and bands' buckets of two or
more are the candidates. Buckets with the same members as another are left out. No stage emits all pairs of a bucket,
or more than a few rows a class:

1. every class is tested with one leader, the least class id that heads any of its buckets, so a group of near copies
   gets one leader for all of its bands and blocks; then, twice over, classes outside the largest component of a bucket
   are tested with one member of that component: one pair a class and turn;
2. in buckets that still hold several components, each class outside the largest component visits all of that
   component; a visit tests its pairs within the task and returns one link at most;
3. classes outside the largest component of a bucket are compared with each other in blocks; a task tests its pairs
   and returns only links that join two components that it has not joined yet.

Comparisons walk the signatures in batches and drop a pair as soon as the posterior probability that its similarity
reaches the threshold falls below `miss`. Tests are exact, on the full shingle sets, and only tested pairs link.
After 1 the components are fixed for 2 and 3: two classes of a bucket are of one component, or one is outside the
largest and meets the other in 2 or 3, so no candidate pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.components import connected_components
from palimpsest.llm.scratch import Scratch

HASHES, BANDS, ROWS, BATCH = 128, 25, 5, 32
TURNS = 3
#: up to this many ids, of 16 bytes each, are sent to the texts; beyond it the texts are shuffled to the ids
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(20_240_607)
_MULT = (_rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1))[None, :]
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)[None, :]
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than size give one for the whole sequence."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\0short\0" + b" ".join(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    x = sum((h[k : len(h) - size + 1 + k] * _PLACE[k] for k in range(1, size)), h[: len(h) - size + 1] * _PLACE[0])
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return np.unique(x)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of 32 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, (x[at : at + 512, None] * _MULT + _ADD).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(sig[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k + 1) - 2**63 for k in range(BANDS)]


def class_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=99) - 2**63


def least_matches(similarity: float, miss: float) -> list[int]:
    """After each batch, the fewest matches at which similarity may still be reached with a posterior of miss or more.

    Uniform prior: after m of n matches the similarity is Beta(m + 1, n - m + 1).
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            w = np.exp(log - log.max())
            if w[grid >= similarity].sum() >= miss * w.sum():
                out.append(m)
                break
    return out


def _matches(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Matches of every row of a with every row of b; -1 where a batch has ruled the pair out."""
    out = np.zeros((len(a), len(b)), dtype=np.int16)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        if k == 0:
            out += (a[:, None, part] == b[None, :, part]).sum(axis=2, dtype=np.int16)
            out[out < need] = -1
            continue
        i, j = np.nonzero(out >= 0)
        if not len(i):
            break
        now = out[i, j] + (a[i, part] == b[j, part]).sum(axis=1, dtype=np.int16)
        out[i, j] = np.where(now < need, -1, now)
    return out


def near_documents(docs: DataFrame, key: str, text: str, words: int = 5, percent: int = 80, miss: float = 1e-4, block: int = 256) -> DataFrame:
    """(key, n_shingles, component_id, kept): one row per row of docs.

    Linked are documents with 100 * |intersection| >= percent * |union| of their sets of word shingles. A null or
    wordless text has an empty set and links with nothing. Rows of equal sets are one class and always linked. A null
    key gives component null and kept true. A key may repeat: each row belongs to its own text's class. Texts are read
    whole, however long; a set takes 8 bytes a word. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cid, sig, bands = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(words_of(t), words)
                n.append(len(s))
                full = signature(s) if len(s) else None
                cid.append(class_id(s) if len(s) else None)
                sig.append(None if full is None else full.astype(np.uint16).tobytes())
                bands.append(None if full is None else band_keys(full))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "cid", "sig", "bands"])

    signed = scratch.save(rows.mapInArrow(sign, "id long, n long, cid long, sig binary, bands array<long>"), "signed")
    classes = signed.where("cid is not null and id is not null").groupBy("cid").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = scratch.save(classes, "classes")
    members = _members(scratch, classes)
    full = _sets(scratch, rows, members, classes, words)
    least = least_matches(percent / 100, miss)

    pairs = members.where("cid <> leader").groupBy("cid").agg(F.min(F.struct("leader", "size")).alias("l")).select("cid", "l.leader", "l.size")
    heads = members.groupBy("leader").agg(F.max("size").alias("size"))
    pairs, heads = scratch.save(pairs, "pairs"), scratch.save(heads, "heads")  # so that Spark knows their sizes
    parts = _joined(scratch, None, _led(scratch, pairs, heads, full, least, percent, block))
    for turn in range(1, TURNS + 1):
        placed, mixed = _mixed(scratch, members, parts, turn)
        if mixed is None or turn == TURNS:
            break
        outside = placed.join(mixed.select("bucket", "major", "rep"), "bucket").where("comp <> major")
        pairs = outside.groupBy("cid").agg(F.min(F.struct("rep", "size")).alias("l")).select("cid", F.col("l.rep").alias("leader"), "l.size")
        heads = mixed.groupBy(F.col("rep").alias("leader")).agg(F.max("size").alias("size"))
        pairs, heads = scratch.save(pairs, "pairs"), scratch.save(heads, "heads")
        parts = _joined(scratch, parts, _led(scratch, pairs, heads, full, least, percent, block))
    if mixed is not None:
        parts = _joined(scratch, parts, _visits(scratch, placed, mixed, full, least, percent, block))
        parts = _joined(scratch, parts, _minor_links(scratch, placed, mixed, parts, full, least, percent, block))
    scratch.drop("sets")

    smallest = classes.join(parts.withColumnRenamed("id", "cid"), "cid", "left").select("cid", "rep", F.coalesce("component", "cid").alias("root"))
    least_id = smallest.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = smallest.join(least_id, "root").select(F.col("cid").alias("c"), "component_id")
    own = signed.select("id", "n", "cid")
    out = own.join(of_class, own.cid == of_class.c, "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def _members(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """(bucket, size, leader, cid): the classes in buckets of two or more, one bucket for each set of members."""
    banded = classes.select("cid", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("leader"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y")).where("size > 1")
    buckets = scratch.save(buckets.groupBy("size", "leader", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size", "leader"), "buckets")
    return scratch.save(banded.join(buckets, "bucket").select("bucket", "size", "leader", "cid"), "members")


FULL = "cid long, sig binary, shingles binary"


def _sets(scratch: Scratch, rows: DataFrame, members: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(cid, sig, shingles): signatures and full sets of the classes in buckets, read again from the texts."""
    wanted = scratch.save(members.groupBy("cid").agg(F.lit(1).alias("one")).join(classes.select("cid", "rep"), "cid").select("cid", "rep"), "wanted")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingle_set(words_of(t), words) for t in b.column(0).to_pylist()]
            sig = [signature(x).astype(np.uint16).tobytes() if len(x) else None for x in s]
            yield pa.RecordBatch.from_arrays([pa.array([class_id(x) for x in s], pa.int64()), pa.array(sig, pa.binary()), pa.array([x.tobytes() for x in s], pa.binary())], names=["cid", "sig", "shingles"])

    ids = wanted.select(F.col("rep").alias("id"))
    few = ids.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("text").where("text is not null")
    made = texts.mapInArrow(make, FULL)
    return scratch.save(made.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]), "sets")


def _joined(scratch: Scratch, parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) of parts grown by links; only links between different components are walked."""
    if parts is None:
        return scratch.save(connected_components(links, scratch, "a", "b").select("id", "component"), "parts")
    at = links
    for end in ("a", "b"):
        at = at.join(parts.withColumnsRenamed({"id": end, "component": f"c{end}"}), end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    up = connected_components(scratch.save(at.where("a <> b"), "joins"), scratch, "a", "b").withColumnsRenamed({"id": "from", "component": "to"})
    old = parts.join(up, parts.component == up["from"], "left").select("id", F.coalesce("to", "component").alias("component"))
    new = up.join(parts, up["from"] == parts.id, "left_anti").select(F.col("from").alias("id"), F.col("to").alias("component"))
    return scratch.save(old.union(new), "parts")


def _led(scratch: Scratch, pairs: DataFrame, heads: DataFrame, full: DataFrame, least: list[int], percent: int, block: int) -> DataFrame:
    """(a, b): the pairs (cid, leader) that are similar. A leader is sent once for every block of its largest bucket."""
    blocks = F.ceil(F.col("size") / block)
    hosts = heads.select(F.col("leader"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("salt")).join(full.withColumnsRenamed({"cid": "leader", "sig": "lsig", "shingles": "lset"}), "leader")
    guests = pairs.select("cid", "leader", F.pmod(F.xxhash64("cid"), blocks).alias("salt")).join(full, "cid")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            alive = np.flatnonzero(_pairwise(_signatures(b.column("sig")), _signatures(b.column("lsig")), least))
            sets = [[np.frombuffer(x, dtype=np.uint64) for x in b.column(c).take(pa.array(alive)).to_pylist()] for c in ("shingles", "lset")]
            alive = alive[[similar(x, y, percent) for x, y in zip(*sets)]] if len(alive) else alive
            if len(alive):
                yield _pair_batch([b.column("cid").to_numpy()[alive]], [b.column("leader").to_numpy()[alive]])

    met = guests.join(hosts, ["leader", "salt"]).select("cid", "leader", "sig", "lsig", "shingles", "lset")
    return scratch.save(met.mapInArrow(check, "a long, b long"), "led")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), HASHES)


def _pairwise(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Whether each row of a and its row of b survive every batch."""
    alive, seen = np.ones(len(a), dtype=bool), np.zeros(len(a), dtype=np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        seen[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive &= seen >= need
    return alive


def _units(df: DataFrame, unit: str) -> DataFrame:
    """df dealt by unit. Tasks follow the rows, so that one holds no more of them as the input grows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-df.count() // 100_000)), unit).sortWithinPartitions(unit, "cid")


def _runs(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each unit, which come together; batches end anywhere."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        u = b.column(unit).to_numpy()
        cuts = [0, *(np.flatnonzero(u[1:] != u[:-1]) + 1).tolist(), len(u)]
        for at, to in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column(unit)[0].as_py() != int(u[at]):
                yield _columns(held)
                held = []
            held.append(b.slice(at, to - at))
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(held)
    out = {c: t.column(c).to_numpy() for c in t.column_names if c not in ("sig", "shingles")}
    if "shingles" in t.column_names:
        out["shingles"] = t.column("shingles").to_pylist()
    out["sig"] = _signatures(t.column("sig"))
    return out


def _pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _mixed(scratch: Scratch, members: DataFrame, parts: DataFrame, turn: int) -> tuple[DataFrame, DataFrame | None]:
    """(bucket, size, cid, comp) of all members, and (bucket, size, major, rep, minors) of buckets of several components.

    major is the largest component in the bucket, rep one of its members there, another one every turn.
    """
    placed = members.select("bucket", "size", "cid").join(parts.withColumnRenamed("id", "cid"), "cid", "left").select("bucket", "size", "cid", F.coalesce("component", "cid").alias("comp"))
    placed = scratch.save(placed, "placed")
    per = placed.groupBy("bucket", "size", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64(F.lit(turn), "cid").alias("h"), "cid")).alias("rep"))
    mixed = per.groupBy("bucket", "size").agg(F.max(F.struct("n", "comp", F.col("rep.cid").alias("rep"))).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
    mixed = scratch.save(mixed.select("bucket", "size", F.col("top.comp").alias("major"), F.col("top.rep").alias("rep"), (F.col("size") - F.col("top.n")).alias("minors")), "mixed")
    return placed, mixed if mixed.limit(1).count() else None


def _visits(scratch: Scratch, placed: DataFrame, mixed: DataFrame, full: DataFrame, least: list[int], percent: int, block: int) -> DataFrame:
    """(a, b): links between members outside their bucket's largest component and that component.

    Each such member visits all of the component, by signatures first and then, where a pair is left, with the full
    sets; a unit returns one link a visitor, which is what components need. Pairs stay inside the task.
    """
    visitors = placed.join(mixed.select("bucket", "major"), "bucket").where("comp <> major").groupBy("cid", F.col("major").alias("to")).agg(F.lit(1).alias("one")).select("cid", "to")
    visitors = scratch.save(visitors, "visitors")
    nodes = placed.groupBy("cid", "comp").agg(F.lit(1).alias("one")).select("cid", F.col("comp").alias("to"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _runs(batches, "unit"):
            guests, hosts = np.flatnonzero(u["side"] == 0), np.flatnonzero(u["side"] == 1)
            for at in range(0, len(guests), 64):
                i = guests[at : at + 64]
                open_ = (_matches(u["sig"][i], u["sig"][hosts], least) >= 0).any(axis=1) if len(hosts) else np.zeros(len(i), dtype=bool)
                if open_.any():
                    yield pa.RecordBatch.from_arrays([pa.array(u["cid"][i[open_]]), pa.array(u["to"][i[open_]])], names=["cid", "to"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _runs(batches, "unit"):
            guests, hosts = np.flatnonzero(u["side"] == 0), np.flatnonzero(u["side"] == 1)
            if not len(hosts):
                continue
            sets = [np.frombuffer(x, dtype=np.uint64) for x in u["shingles"]]
            a, b = [], []
            for i in guests:
                m = _matches(u["sig"][[i]], u["sig"][hosts], least)[0]
                order = np.argsort(-m, kind="stable")
                for j in hosts[order[m[order] >= 0]]:
                    if similar(sets[i], sets[j], percent):
                        a.append(u["cid"][[i]]), b.append(u["cid"][[j]])
                        break
            if a:
                yield _pair_batch(a, b)

    met = _visit_units(visitors, nodes, block).join(full.select("cid", "sig"), "cid").select("unit", "side", "to", "cid", "sig")
    met = _units(scratch.save(met, "guests"), "unit").mapInArrow(meet, "cid long, to long").groupBy("cid", "to").agg(F.lit(1).alias("one")).select("cid", "to")
    close = _visit_units(scratch.save(met, "met"), nodes, block).join(full, "cid").select("unit", "side", "to", "cid", "sig", "shingles")
    return scratch.save(_units(scratch.save(close, "close"), "unit").mapInArrow(link, "a long, b long"), "visited")


def _visit_units(visitors: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """(unit, side, to, cid): every block of a component's visitors with every block of its members."""
    counts = visitors.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("vb"))
    sizes = nodes.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("hb"))
    shape = counts.join(sizes, "to")
    h = F.xxhash64("cid", "to")
    guests = visitors.join(shape, "to").select("to", "cid", F.lit(0).alias("side"), F.pmod(h, F.col("vb")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("j"))
    hosts = nodes.join(shape, "to").select("to", "cid", F.lit(1).alias("side"), F.pmod(h, F.col("hb")).alias("j"), F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("i"))
    every = guests.unionByName(hosts)
    return every.select(F.xxhash64("to", F.col("i").cast("long"), F.col("j").cast("long")).alias("unit"), "side", "to", "cid")


def _minor_links(scratch: Scratch, placed: DataFrame, mixed: DataFrame, parts: DataFrame, full: DataFrame, least: list[int], percent: int, block: int) -> DataFrame:
    """(a, b): links among members outside their bucket's largest component that parts has not connected.

    Units pair the blocks of such members (sides 0 and 1, or both 2 for a block itself). Signatures tell which members
    have a pair left at all; only those meet again with their full sets, and a unit returns at most one link fewer than
    it has members.
    """
    minors = placed.join(mixed.where("minors > 1").select("bucket", "major", "minors"), "bucket").where("comp <> major").select("bucket", "cid", F.ceil(F.col("minors") / block).cast("int").alias("mb"))
    mine = F.pmod(F.xxhash64("cid", "bucket"), F.col("mb")).cast("int")

    def unit(j):
        return F.struct(F.xxhash64("bucket", F.least("mine", j), F.greatest("mine", j)).alias("unit"), F.when(j == F.col("mine"), 2).when(F.col("mine") < j, 0).otherwise(1).alias("side"))

    units = minors.withColumn("mine", mine).select("cid", F.explode(F.transform(F.sequence(F.lit(0), F.col("mb") - 1), unit)).alias("u")).select("cid", "u.unit", "u.side")
    units = units.join(parts.withColumnRenamed("id", "cid"), "cid", "left").select("unit", "side", "cid", F.coalesce("component", "cid").alias("comp"))

    def open_pairs(u: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = np.flatnonzero(u["side"] != 1), np.flatnonzero(u["side"] != 0)
        for at in range(0, len(left) if len(right) else 0, 64):
            i = left[at : at + 64]
            m = _matches(u["sig"][i], u["sig"][right], least)
            m[u["comp"][i][:, None] == u["comp"][right][None, :]] = -1
            x, y = np.nonzero(m >= 0)
            yield i[x], right[y]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _runs(batches, "unit"):
            open_ = np.zeros(len(u["cid"]), dtype=bool)
            for x, y in open_pairs(u):
                open_[x] = open_[y] = True
            if open_.any():
                yield pa.RecordBatch.from_arrays([pa.array(u["unit"][open_]), pa.array(u["side"][open_], pa.int32()), pa.array(u["cid"][open_]), pa.array(u["comp"][open_])], names=["unit", "side", "cid", "comp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _runs(batches, "unit"):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in u["shingles"]]
            comp = u["comp"].copy()
            a, b = [], []
            for x, y in open_pairs(u):
                for i, j in zip(x.tolist(), y.tolist()):
                    if comp[i] != comp[j] and similar(sets[i], sets[j], percent):
                        a.append(u["cid"][[i]]), b.append(u["cid"][[j]])
                        comp[comp == comp[j]] = comp[i]
            if a:
                yield _pair_batch(a, b)

    first = units.join(full.select("cid", "sig"), "cid").select("unit", "side", "comp", "cid", "sig")
    met = scratch.save(_units(scratch.save(first, "minors"), "unit").mapInArrow(meet, "unit long, side int, cid long, comp long"), "open")
    close = met.join(full, "cid").select("unit", "side", "comp", "cid", "sig", "shingles")
    return scratch.save(_units(scratch.save(close, "close"), "unit").mapInArrow(link, "a long, b long"), "linked")


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * |intersection| >= percent * |union|."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = np.concatenate([s, t])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(s) + len(t) - inter)
