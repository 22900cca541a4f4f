"""Repeated passages by sparse suffix arrays.

Of every `window` consecutive `gram`-word shingles the one of least hash, the last of equals, is kept, and the suffix
that starts there is retained. A passage of `words` = window + gram - 1 words is one such window and belongs to the
suffix that it picks. Equal passages pick the same shingle at the same offset, so suffixes whose gram occurs once are
dropped with all their passages. The rest are sorted by gram and the words that follow, and neighbours are compared:
their longest common prefixes cut the sorted order, for every number of words to the right, into runs of suffixes that
agree so far. Within a run a match is extended to the left: suffixes that agree in the words to the left that make up
`words` hold the same passage, and its words are marked as repeated. Every run is looked at, for every split of a
passage, so no neighbour, context or length is bounded and none is missed. A longer passage is a run of such passages,
so its marks join up.

A gram of more than `runs` suffixes would be one task's work. Its suffixes are first
reduced to those that differ in their words around, with their numbers; then the passages of each are counted by their
hashes, each passage by itself, which gives the same marks.

Words are compared by 32 bits of their hashes, and passages by 64 bits of theirs. Equal texts are one class with one set
of suffixes; a class of two or more rows is repeated as a whole if it has `words` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.llm.minhash import words_of
from palimpsest.llm.scratch import Scratch


def word_hashes(text: str | None) -> np.ndarray:
    w = words_of(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))


_PLACE = np.random.default_rng(91).integers(0, 2**63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams_of(h: np.ndarray, gram: int) -> np.ndarray:
    n = len(h) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = sum((h[k : k + n] * _PLACE[k] for k in range(1, gram)), h[:n] * _PLACE[0])
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least gram of every window, the last of equals; none if there is no full window."""
    return np.unique(picks(grams, window))


def picks(grams: np.ndarray, window: int) -> np.ndarray:
    """For every window, in order, the place of its least gram; the places never fall."""
    if len(grams) < window:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], window)
    return (len(grams) - 1 - (np.arange(len(view)) + _argmin(view)))[::-1]


def _argmin(view: np.ndarray) -> np.ndarray:
    out = np.empty(len(view), dtype=np.int64)
    for at in range(0, len(view), 8192):
        out[at : at + 8192] = view[at : at + 8192].argmin(axis=1)
    return out


#: passages that stand more often than this are sent to the rows that hold them
MANY = 10_000


def repeated_passages(docs: DataFrame, key: str, text: str, words: int = 50, gram: int = 16, runs: int = 4096) -> DataFrame:
    """(key, n_words, n_repeated, spans): one row per row of docs.

    spans is an array of (start, end) in words, end exclusive, merged and ascending: the words in passages of at least
    `words` words that stand elsewhere too, in another text or at another place of the same one. A null text has no
    words. Texts are read whole, however long. Which of equal shingles is kept does not change the marks. Keys may be
    null or repeat; rows of equal texts get equal spans. Extra columns are ignored; an empty table gives an empty result.
    """
    window = words - gram + 1
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    rows = rows.withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit(1), "t")})

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, places, keys = [], [], []
            for t in b.column("t").to_pylist():
                h = word_hashes(t)
                g = grams_of(h, gram)
                at = minimisers(g, window)
                n.append(len(h)), places.append(at.astype(np.int32)), keys.append(g[at].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h1"), b.column("h2"), pa.array(n, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))], names=["id", "h1", "h2", "n", "places", "grams"])

    key_type = rows.schema["id"].dataType.simpleString()
    sampled = scratch.save(rows.mapInArrow(sample, f"id {key_type}, h1 long, h2 long, n int, places array<int>, grams array<long>"), "sampled")
    classes = sampled.groupBy("h1", "h2", "n").agg(F.count(F.lit(1)).alias("copies"))
    classes = scratch.save(classes, "classes")
    single = sampled.where(F.size("places") > 0).groupBy("h1", "h2").agg(F.first("grams").alias("grams"))
    suffixes = single.select("h1", "h2", F.explode("grams").alias("gram"))
    often = suffixes.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    often = scratch.save(often, "often")
    # documents that hold a gram that occurs again, read once more with those grams
    holders = scratch.save(suffixes.join(often, "gram").groupBy("h1", "h2").agg(F.collect_set("gram").alias("kept")), "holders")
    held = rows.select("t", "h1", "h2").join(holders, ["h1", "h2"])

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, h1, h2, kept in zip(*(b.column(c).to_pylist() for c in ("t", "h1", "h2", "kept"))):
                h = word_hashes(t)
                g = grams_of(h, gram)
                pick = picks(g, window)
                starts = np.flatnonzero(np.isin(g[pick].view(np.int64), kept))
                at, first, n = np.unique(pick[starts], return_index=True, return_counts=True)
                code = (h >> np.uint64(32)).astype("<u4")
                ahead, back = code.tobytes(), code[::-1].tobytes()
                lo, hi = starts[first], starts[first] + n - 1  # the first and last passage that pick the suffix
                left = [back[4 * (len(h) - p) : 4 * (len(h) - x)] for p, x in zip(at.tolist(), lo.tolist())]
                right = [ahead[4 * (p + gram) : 4 * (y + words)] for p, y in zip(at.tolist(), hi.tolist())]
                same: dict[tuple, list[int]] = {}  # a text that repeats itself has one row for all places alike
                for c, p, x, y in zip(g[at].view(np.int64).tolist(), at.tolist(), left, right):
                    same.setdefault((c, x, y), []).append(p)
                k = len(same)
                cols = [pa.array([h1] * k, pa.int64()), pa.array([h2] * k, pa.int64()), pa.array([c for c, _, _ in same], pa.int64()), pa.array(list(same.values()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x for _, x, _ in same], pa.binary()), pa.array([y for _, _, y in same], pa.binary())], names=["h1", "h2", "gram", "places", "left", "right"])

    held = held.dropDuplicates(["h1", "h2"])
    kept = scratch.save(held.mapInArrow(context, "h1 long, h2 long, gram long, places array<int>, left binary, right binary"), "kept")
    n_parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // 500_000))
    hot = scratch.save(often.where(F.col("times") > runs).select("gram"), "hot")
    rare = kept.join(hot, "gram", "left_anti").repartition(n_parts, "gram").sortWithinPartitions("gram", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b]) if last is None else pa.concat_tables([last, pa.Table.from_batches([b])])
            gram_ = now.column("gram").to_numpy()
            cut = int(np.searchsorted(gram_, gram_[-1]))  # the last gram may go on in the next batch
            yield from _repeated(now.slice(0, cut), words, gram)
            last = now.slice(cut).combine_chunks()
        if last is not None:
            yield from _repeated(last, words, gram)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = words - gram
            (l_codes, l_n), (r_codes, r_n) = _codes(b.column("left"), n), _codes(b.column("right"), n)
            l_hash, r_hash = _growing(l_codes), _growing(r_codes)
            for d in range(n + 1):
                at = np.flatnonzero((l_n >= n - d) & (r_n >= d))
                own = b.take(pa.array(at))
                w = _mixed(_mixed(b.column("gram").to_numpy()[at].view(np.uint64), l_hash[n - d][at]), r_hash[d][at])
                yield pa.RecordBatch.from_arrays([own.column("content"), own.column("times"), pa.array(np.full(len(at), n - d, dtype=np.int32)), pa.array(w.view(np.int64))], names=["content", "times", "ahead", "w"])

    content = F.xxhash64("gram", "left", "right")
    often_kept = scratch.save(kept.join(hot, "gram", "left_semi").withColumn("content", content), "often_kept")
    contents = often_kept.groupBy("content", "gram", "left", "right").agg(F.sum(F.size("places").cast("long")).alias("times"))
    frequent = scratch.save(contents.mapInArrow(spell, "content long, times long, ahead int, w long"), "frequent")
    again = scratch.save(frequent.groupBy("w").agg(F.sum("times").alias("times")).where("times > 1"), "again")
    # at most a million passages stand more often than `many`, so what is broadcast is bounded
    many = max(MANY, (again.agg(F.sum("times")).first()[0] or 0) // 1_000_000)
    sent = F.broadcast(again.where(F.col("times") > many).select("w"))
    twice = frequent.select("content", "ahead", "w").join(sent, "w", "left_semi").unionByName(frequent.select("content", "ahead", "w").join(sent, "w", "left_anti").join(again.where(F.col("times") <= many), "w", "left_semi"))
    twice = twice.groupBy("content").agg(F.min("ahead").alias("least"), F.max("ahead").alias("most"))
    twice = often_kept.select("h1", "h2", "places", "content").join(twice, "content").select("h1", "h2", "places", "least", "most")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _marks(b, b.column("least").to_numpy(), b.column("most").to_numpy(), words)

    marked = "h1 long, h2 long, start int, end int"
    marks = rare.mapInArrow(compare, marked).unionByName(twice.mapInArrow(place, marked))
    marks = scratch.save(marks.groupBy("h1", "h2", "start").agg(F.max("end").alias("end")), "marks")
    in_text = Window.partitionBy("h1", "h2").orderBy("start")
    before = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    runs_ = marks.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(in_text))
    runs_ = runs_.groupBy("h1", "h2", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    merged = runs_.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    per = classes.join(merged, ["h1", "h2"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))
    per = per.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.when((F.col("copies") > 1) & (F.col("n") >= words), whole).otherwise(F.coalesce("spans", none)).alias("spans"))
    out = sampled.select("id", "h1", "h2", "n").join(per, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    size = F.aggregate("spans", F.lit(0), lambda a, s: a + s.end - s.start)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_words"), size.alias("n_repeated"), "spans")


def _codes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of at most width words, padded with zeros, and their numbers of words."""
    n = np.array(pa.compute.binary_length(column)) // 4
    out = np.zeros((len(n), width), dtype=np.uint32)
    out[np.arange(width)[None, :] < n[:, None]] = np.frombuffer(b"".join(column.to_pylist()), dtype="<u4")
    return out, n


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x ^ y) * _PLACE[0]
    return x ^ (x >> np.uint64(32))


def _growing(codes: np.ndarray) -> list[np.ndarray]:
    """A hash of the first 0, 1, 2, ... words of every row."""
    out = [np.full(len(codes), 7, dtype=np.uint64)]
    for k in range(codes.shape[1]):
        out.append(_mixed(out[-1], codes[:, k].astype(np.uint64) + np.uint64(k << 32)))
    return out


def _repeated(t: pa.Table, words: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, start, end) of every suffix with a passage that stands twice, from the first of those to the last.

    t is sorted by gram and right. A suffix's passages all hold its gram, so those between are covered.
    """
    if not t.num_rows:
        return
    n = words - gram
    t = t.combine_chunks()
    (l_codes, l_n), (r_codes, r_n) = (_codes(t.column(c).combine_chunks(), n) for c in ("left", "right"))
    same = (r_codes[1:] == r_codes[:-1]) & (np.arange(n)[None, :] < np.minimum(r_n[1:], r_n[:-1])[:, None])
    lcp = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    grams_ = t.column("gram").to_numpy()
    lcp = np.concatenate([[-1], np.where(grams_[1:] == grams_[:-1], lcp, -1)])
    l_hash = _growing(l_codes)
    least, most = np.full(len(lcp), n + 1), np.full(len(lcp), -1)  # words to the left in the passages that match
    for d in range(n + 1):
        at = np.flatnonzero((l_n >= n - d) & (r_n >= d))
        run = np.cumsum(lcp < d)[at].astype(np.uint64)
        _, which, times = np.unique(_mixed(run * _PLACE[1], l_hash[n - d][at]), return_inverse=True, return_counts=True)
        hit = at[times[which] > 1]
        least[hit] = np.minimum(least[hit], n - d)
        most[hit] = np.maximum(most[hit], n - d)
    own = np.array(pa.compute.list_value_length(t.column("places").combine_chunks())) > 1
    least[own], most[own] = (n - np.minimum(r_n, n))[own], np.minimum(l_n, n)[own]  # all of its passages stand again in its own text
    rows = np.flatnonzero(most >= 0)
    if len(rows):
        yield _marks(t.take(pa.array(rows)), least[rows], most[rows], words)


def _marks(t: pa.Table | pa.RecordBatch, least: np.ndarray, most: np.ndarray, words: int) -> pa.RecordBatch:
    """(h1, h2, start, end): the words of each row's passages at all of its places, those that overlap joined."""
    h1, h2, starts, ends = [], [], [], []
    for a, b, places, lo, hi in zip(t.column("h1").to_pylist(), t.column("h2").to_pylist(), t.column("places").to_pylist(), least.tolist(), most.tolist()):
        for k, p in enumerate(places):
            if k and p - hi <= ends[-1]:
                ends[-1] = p - lo + words
            else:
                h1.append(a), h2.append(b), starts.append(p - hi), ends.append(p - lo + words)
    return pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["h1", "h2", "start", "end"])
