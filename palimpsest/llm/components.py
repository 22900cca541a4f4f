"""Connected components of an undirected edge list, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(id, component) for every id on an edge between two different ids; component is the smallest id reachable.

    Each round takes the least label among neighbours, hooks a label's root to the least label that any of its
    members saw, and jumps one pointer, so a path of n ids needs about log n rounds. Labels live in the shared
    folder between rounds; the driver sees one count a round. Null ids and loops are left out; an empty edge
    list gives an empty result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = scratch.save(e.union(e.select("b", "a")).groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), "cc_edges")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("c")), "cc_labels")
    for _ in range(max_rounds):
        seen = both.join(labels.withColumnsRenamed({"id": "b", "c": "n"}), "b").groupBy("a").agg(F.min("n").alias("n"))
        new = labels.join(seen.withColumnRenamed("a", "id"), "id").select("id", "c", F.least("c", "n").alias("n"))
        new = scratch.save(new, "cc_new")
        hooks = new.where("n < c").groupBy(F.col("c").alias("root")).agg(F.min("n").alias("h"))
        hooked = new.join(hooks, new.c == hooks.root, "left").select("id", F.col("c").alias("old"), F.least("n", F.coalesce("h", "n")).alias("c"))
        hooked = scratch.save(hooked, "cc_hooked")
        up = hooked.select(F.col("id").alias("p"), F.col("c").alias("pc"))
        labels = scratch.save(hooked.join(up, hooked.c == up.p, "left").select("id", F.least("c", F.coalesce("pc", "c")).alias("c"), "old"), "cc_labels")
        changed = labels.where("c <> old").limit(1).count()
        labels = labels.select("id", "c")
        if not changed:
            scratch.drop("cc_new"), scratch.drop("cc_hooked"), scratch.drop("cc_edges")
            return labels.select("id", F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
