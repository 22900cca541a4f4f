"""Benchmark decontamination: SimHash over item-sized windows, looked up through multi-index Hamming blocks.

Everything runs as DataFrame operations. A window that matches an item lacks at most 1 - similarity of the item's
weight, so it holds one at least of the item's heaviest shingles that weigh more than that together. Documents with one
of those, the rarest that the items have, are the item's candidates; a phrase that many items share makes none. In a
candidate, windows of the item's length are laid wherever it shares a shingle with the item, at the place that the
shingle has in the item. Equal windows are fingerprinted once. A 64-bit fingerprint is cut into blocks; if two
fingerprints differ in at most `radius` bits, some block differs in at most radius // blocks bits, so looking up every
block, together with the length, under all such changes finds every item of that length within the radius. The index is
kept by heavy shingle, of which a match holds one: a window meets only the items that share one with it, however many
others there are, and heavy shingles that no window holds are not indexed. What is found is verified by exact weighted-shingle similarity: sum of least over sum of greatest shingle weights, both counted
with repeats.
"""

from __future__ import annotations

import string
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.llm.scratch import Scratch

BITS = 64


def words_of(text: Column) -> Column:
    """Runs without ASCII white space, A-Z lower-cased; null for null."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, "[ \t-\r]+"), lambda w: w != "")


def shingles_of(words: Column, size: int) -> Column:
    """Hashes of the shingles in order, repeats included; empty for fewer words than size."""

    def hashes(w: Column) -> Column:
        n = F.size(w) - size
        return F.when(n >= 0, F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<bigint>"))

    # a lambda's variable is evaluated once; words itself would be for every shingle
    return F.element_at(F.transform(F.array(words), hashes), 1)


def simhash(weighted: Column) -> Column:
    """64 bits from an array of structs (s bigint, w bigint): bit b is set if the weights of hashes with bit b prevail."""
    zero = F.array_repeat(F.lit(0).cast("bigint"), BITS)
    votes = F.aggregate(weighted, zero, lambda a, x: F.transform(a, lambda v, b: v + F.when(F.getbit(x.s, b) == 1, x.w).otherwise(-x.w)))
    bits = F.transform(votes, lambda v, b: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def _blocks(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    edges = [BITS * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block_value(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def block_keys(fp: Column, count: int, changes: int) -> Column:
    """An array of (block, value): each block of fp, under all changes of up to `changes` of its bits."""
    out = []
    for k, (first, width) in enumerate(_blocks(count)):
        masks = [sum(1 << b for b in c) for n in range(changes + 1) for c in combinations(range(width), n)]
        out.append(_variants(_block_value(fp, first, width), masks, k))
    return F.concat(*out)


def _variants(value: Column, masks: list[int], block: int) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value")))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 20, blocks: int = 7) -> DataFrame:
    """(key, item_key, start_word, n_words, similarity): one row per document and item that it holds.

    The window given is the most similar, the first of equals. Documents with a null key, null texts, and items of
    fewer than `words` words, which ordinary phrases would match, give no rows. Texts are read whole, however long. A
    key may repeat; its rows count as one document. An item key may repeat; each of its texts is looked for. Extra columns are ignored; an empty table on either side gives
    an empty result.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    milli = int(round(similarity * 1000))
    it = items.select(F.col(item_key).cast("long").alias("item"), words_of(F.col(item_text)).alias("w")).where("item is not null")
    it = it.select("item", F.size("w").alias("len"), shingles_of(F.col("w"), words).alias("sh")).where(F.size("sh") > 0)
    it = scratch.save(it.withColumn("u", F.xxhash64("item", "sh")).dropDuplicates(["u"]), "items")
    n_items = it.count()
    spread = it.select("u", "len", F.posexplode("sh").alias("at", "s"))
    spread = scratch.save(spread, "spread")
    idf = spread.groupBy("s").agg(F.countDistinct("u").alias("df")).select("s", F.round(1000 * F.log1p(F.lit(n_items) / F.col("df"))).cast("bigint").alias("w"))
    idf = scratch.save(idf, "idf")
    unseen = F.round(1000 * F.log1p(F.lit(float(n_items)))).cast("bigint")

    # per item, the heaviest shingles that weigh more than a match may lack
    own = spread.groupBy("u", "s").agg(F.count(F.lit(1)).alias("c")).join(idf, "s").withColumn("w", F.col("c") * F.col("w"))
    of_item = Window.partitionBy("u")
    own = own.withColumn("total", F.sum("w").over(of_item)).withColumn("before", F.coalesce(F.sum("w").over(of_item.orderBy((-F.col("w") / F.col("c")), F.xxhash64("s"), "s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heavy = scratch.save(own.where(1000 * F.col("before") <= (1000 - milli) * F.col("total")).select("s", "u"), "heavy")

    doc = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t")).where("doc is not null and t is not null")
    places = doc.select("doc", F.explode(F.array_distinct(shingles_of(words_of(F.col("t")), words))).alias("s"))
    candidates = scratch.save(places.join(heavy, "s").groupBy("doc").agg(F.collect_set("u").alias("items")), "candidates")
    held = scratch.save(doc.join(candidates, "doc").select("doc", "items", shingles_of(words_of(F.col("t")), words).alias("sh")), "held")
    hits = held.select("doc", "items", F.posexplode("sh").alias("pos", "s")).join(spread.select("s", "u", "len", "at"), "s").where(F.array_contains("items", F.col("u")))
    laid = hits.groupBy("doc", F.greatest(F.col("pos") - F.col("at"), F.lit(0)).alias("start"), "len").agg(F.lit(1).alias("one"))
    laid = scratch.save(laid.groupBy("doc").agg(F.collect_list(F.struct("start", "len")).alias("windows")), "laid")
    windows = held.join(laid, "doc").select("doc", "sh", F.explode("windows").alias("x")).select("doc", "x.start", "x.len", F.slice("sh", F.col("x.start") + 1, F.greatest(F.col("x.len") - (words - 1), F.lit(1))).alias("sh"))
    windows = scratch.save(windows.where(F.size("sh") > 0).withColumn("win", F.xxhash64("len", "sh")), "windows")

    distinct = scratch.save(windows.groupBy("win").agg(F.first("sh").alias("sh"), F.first("len").alias("len")), "distinct")
    win_counts = _weighted(distinct.select("win", "sh"), "win", idf, unseen)
    item_counts = _weighted(it.select("u", "sh"), "u", idf, unseen)
    win_counts, item_counts = scratch.save(win_counts, "win_counts"), scratch.save(item_counts, "item_counts")
    win_fp = win_counts.groupBy("win").agg(F.collect_list(F.struct("s", "w")).alias("c"), F.sum("w").alias("total")).select("win", "total", simhash(F.col("c")).alias("fp")).join(distinct.select("win", "len"), "win")
    item_fp = item_counts.groupBy("u").agg(F.collect_list(F.struct("s", "w")).alias("c"), F.sum("w").alias("total")).select("u", F.col("total").alias("item_total"), simhash(F.col("c")).alias("item_fp"))
    item_fp = item_fp.join(it.select("u", "len"), "u")
    # by heavy shingle: those that a window holds, on either side
    shares = scratch.save(win_counts.select("win", "s").join(heavy.select("s").distinct(), "s"), "shares")
    met = heavy.join(shares.select("s").distinct(), "s").join(item_fp, "u")
    index = scratch.save(met.select("*", F.explode(block_keys(F.col("item_fp"), blocks, radius // blocks)).alias("k")).select("u", "item_total", "item_fp", "len", "s", "k.block", "k.value"), "index")
    probes = win_fp.join(shares, "win").select("*", F.explode(block_keys(F.col("fp"), blocks, 0)).alias("k")).select("win", "total", "fp", "len", "s", "k.block", "k.value")
    near = probes.join(index, ["len", "s", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = scratch.save(near.groupBy("win", "u", "total", "item_total").agg(F.lit(1).alias("one")).drop("one"), "near")

    shared = near.join(win_counts.select("win", "s", "c", "w"), "win").join(item_counts.select("u", "s", F.col("c").alias("ic"), F.col("w").alias("iw")), ["u", "s"])
    sims = shared.groupBy("win", "u", "total", "item_total").agg(F.sum(F.least("w", "iw")).alias("least"))
    sims = sims.where(1000 * F.col("least") >= milli * (F.col("total") + F.col("item_total") - F.col("least")))
    sims = scratch.save(sims.join(it.select("u", "item"), "u").select("win", "item", F.round(F.col("least") / (F.col("total") + F.col("item_total") - F.col("least")), 6).alias("sim")), "sims")
    best = windows.select("doc", "start", "len", "win").join(sims, "win").groupBy("doc", "item").agg(F.max(F.struct("sim", (-F.col("start")).alias("before"), "len")).alias("b"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item_key), (-F.col("b.before")).cast("int").alias("start_word"), F.col("b.len").alias("n_words"), F.col("b.sim").alias("similarity"))


def _weighted(df: DataFrame, key: str, idf: DataFrame, unseen: Column) -> DataFrame:
    """(key, s, c, w): each distinct shingle with its count and count * weight; rows of a key count once."""
    each = df.dropDuplicates([key]).select(key, F.explode("sh").alias("s")).groupBy(key, "s").agg(F.count(F.lit(1)).alias("c"))
    return each.join(idf, "s", "left").select(key, "s", "c", (F.col("c") * F.coalesce("w", unseen)).alias("w"))


def without_leaks(docs: DataFrame, leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs' rows whose key has no leak."""
    return docs.join(leaks.select(F.col(key).alias("_leaked")).distinct(), F.col(key) == F.col("_leaked"), "left_anti")
