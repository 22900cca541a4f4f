"""URL filter: host and path rules first, gradient-boosted trees on lexical features for what no rule decides.

Everything runs as DataFrame operations. The trees are trained on urls that the rules label, at most `sample` of them
(those of the least hashes): each level of each tree is one aggregation of gradients by node, feature and bin, whose
result has at most nodes * features * bins rows and picks the splits. Suffix statistics count all rows; a url that
trains is given the rate of its suffix's labels out of fold, so it does not see its own.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.scratch import Scratch, least_hashed

FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "hyphens", "entropy", "params", "suffix_rate", "suffix_share")


@dataclass(frozen=True)
class Rule:
    """text is host + path, such as net/ or example.org/en/; it fits the host and its subdomains."""

    text: str
    verdict: str  # allow or block

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def lexical(df: DataFrame) -> DataFrame:
    """df with one double column per feature; needs url, host, path and suffix, none null."""
    u = F.col("url")
    n = F.greatest(F.length(u), F.lit(1))
    chars = F.array_sort(F.split(u, ""))
    # runs of equal characters in the sorted array give the counts: sum of c * log2(c)
    start = F.struct(F.lit("").alias("ch"), F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))
    step = lambda a, x: F.when(a.ch == x, F.struct(x.alias("ch"), (a.c + 1).alias("c"), a.s.alias("s"))).otherwise(F.struct(x.alias("ch"), F.lit(1.0).alias("c"), (a.s + _clog(a.c)).alias("s")))
    clog = F.aggregate(chars, start, step, lambda a: a.s + _clog(a.c))
    return df.withColumns(
        {
            "length": F.length(u).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "labels": _count(F.col("host"), ".").cast("double"),
            "depth": _count(F.rtrim(F.col("path"), F.lit("/")), "/").cast("double"),
            "digit_ratio": _count(u, "0-9") / n,
            "hyphens": _count(F.col("host"), "-").cast("double"),
            "entropy": F.log2(n.cast("double")) - clog / n,
            "params": F.when(F.instr(u, "?") > 0, _count(F.regexp_extract(u, "\\?([^#]*)", 1), "&") + 1).otherwise(0).cast("double"),
        }
    )


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


@dataclass
class Trees:
    """Additive trees of depth two at most; predict() is one Column."""

    prior: float
    trees: list[tuple]

    def margin(self) -> Column:
        out = F.lit(self.prior)
        for t in self.trees:
            out = out + _value(t)
        return out

    def predict(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def _value(t: tuple) -> Column:
    if t[0] == "leaf":
        return F.lit(float(t[1]))
    return F.when(F.col(t[1]) <= t[2], _value(t[3])).otherwise(_value(t[4]))


def train(labelled: DataFrame, features: tuple[str, ...] = FEATURES, rounds: int = 12, bins: int = 16, rate: float = 0.4, ridge: float = 1.0) -> Trees:
    """labelled: feature columns and y (0 or 1, none null), small enough to scan rounds * 2 times."""
    head = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), *[F.percentile_approx(f, [k / bins for k in range(1, bins)], 1000).alias(f) for f in features]).first()
    n, pos = head["n"], head["p"] or 0
    model = Trees(math.log((pos + 0.5) / (n - pos + 0.5)), [])
    if not n or pos in (0, n):
        return model
    cuts = {f: sorted(set(head[f])) for f in features}
    binned = F.array(*[F.struct(F.lit(f).alias("f"), sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias("b")) for f in features])
    for _ in range(rounds):
        p = model.predict()
        graded = labelled.select(*features, F.explode(binned).alias("x"), (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"))
        root = _best(graded, F.lit(0), cuts, ridge).get(0)
        if root is None or root[0] == "leaf":
            break
        _, f, cut, _ = root
        below = _best(graded, F.when(F.col(f) <= cut, 0).otherwise(1), cuts, ridge)
        sides = [below[k] if below[k][0] == "leaf" else ("split", below[k][1], below[k][2], *below[k][3]) for k in (0, 1)]
        model.trees.append(_shrunk(("split", f, cut, *sides), rate))
    return model


def _shrunk(t: tuple, rate: float) -> tuple:
    return ("leaf", t[1] * rate) if t[0] == "leaf" else (*t[:3], _shrunk(t[3], rate), _shrunk(t[4], rate))


def _best(graded: DataFrame, node: Column, cuts: dict[str, list[float]], ridge: float) -> dict[int, tuple]:
    """For each node its best split with the two leaves, or a leaf if no split gains."""
    sums = graded.groupBy(node.alias("node"), "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    out: dict[int, tuple] = {}
    for k in sorted({r["node"] for r in sums}):
        best, split = 1e-6, None
        for f in cuts:
            of = {r["b"]: (r["g"], r["h"]) for r in sums if r["node"] == k and r["f"] == f}
            total_g, total_h = (sum(x[i] for x in of.values()) for i in (0, 1))
            gl = hl = 0.0
            for b, cut in enumerate(cuts[f]):
                gl, hl = gl + of.get(b, (0, 0))[0], hl + of.get(b, (0, 0))[1]
                gr, hr = total_g - gl, total_h - hl
                gain = gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - total_g * total_g / (total_h + ridge)
                if gain > best + 1e-9:
                    best, split = gain, ("split", f, cut, (("leaf", -gl / (hl + ridge)), ("leaf", -gr / (hr + ridge))))
        out[k] = split or ("leaf", -total_g / (total_h + ridge))
    return out


def judge_urls(df: DataFrame, key: str, url: str, rules: list[Rule], sample: int = 20_000, seed: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key, host, path, rule, verdict, score): one row per row of df.

    rule is the longest rule that fits; its verdict holds. Elsewhere verdict is block where the trees give threshold
    or more (rules label few urls, so a block has to be a confident one); score is their probability for every row. A null url counts as empty for the features. Without labelled
    urls, or with one label only, the score is the label's smoothed share. Urls are read whole, however long. Keys may be
    null or repeat; equal rows get equal results; extra columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "urls")
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumns({"suffix": F.substring_index("host", ".", -1), "rule": rule_of(F.col("host"), F.col("path"), rules)})
    block = F.col("rule").isin([r.text for r in rules if r.verdict == "block"])
    rows = lexical(rows.withColumn("y", F.when(F.col("rule").isNotNull(), block.cast("int"))))
    rows = scratch.save(rows.drop("url").withColumn("at", F.xxhash64(F.lit(seed), "host", "path", "id")), "rows")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("p")).first()
    prior = total["p"] if total["p"] is not None else 0.0
    # a row that trains sees its suffix's rate without its own fold; the rest, and all predictions, see all labels
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), "at"), F.lit(5)))
    folds = scratch.save(rows.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("labels"), F.coalesce(F.sum("y"), F.lit(0)).alias("blocked")), "folds")
    whole = folds.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("labels").alias("all_labels"), F.sum("blocked").alias("all_blocked"))
    rate = lambda blocked, labels: (blocked + 20 * prior) / (labels + 20)
    stats = folds.join(whole, "suffix").select("suffix", "fold", rate(F.col("all_blocked"), F.col("all_labels")).alias("suffix_rate"), rate(F.col("all_blocked") - F.col("blocked"), F.col("all_labels") - F.col("labels")).alias("other_rate"), (F.col("all_n") / max(total["n"], 1)).alias("suffix_share"))
    rows = rows.join(scratch.save(stats, "stats"), ["suffix", "fold"], "left")
    labelled = rows.where("y is not null").withColumn("suffix_rate", F.col("other_rate"))
    fit = scratch.save(least_hashed(labelled, sample, "at", seed=seed).select("y", *FEATURES), "fit")
    model = train(fit)
    score = model.predict()
    return rows.select(
        F.col("id").alias(key),
        "host",
        "path",
        "rule",
        F.when(F.coalesce(F.col("y").cast("double"), score) >= threshold, "block").otherwise("allow").alias("verdict"),
        F.round(score, 9).alias("score"),
    )
