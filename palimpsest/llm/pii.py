"""Personal data: fixed patterns for four kinds, and identifiers that bootstrapped context patterns discover.

Everything runs as DataFrame operations. Seed entities are the base spans, each of its kind, and long keys (hexadecimal
or mixed strings of 32 characters or more) of the kind secret. An instance is the text of a seed, or a token with a
digit or an at sign that no base span covers. Where an instance stands it has up to three lexical patterns: the two
words before it, the word before with the word after, and the two words after. Patterns and instances make a bipartite
graph, scored in turns: a pattern's score for a kind is the mean score of its instances, shrunk towards 0, and counts
once their sum is near `support`; an instance that is no seed scores the noisy-or of its reliable patterns. So an
instance that one pattern finds lends its score to its other patterns, which then find more. What scores `accept` or
more is added where it stands in a pattern that scores `accept` or more, and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
_BYTE = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
LOCAL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    """pattern never gives back what it took, so it runs in one pass over texts of any length; hint is a cheap test."""

    name: str
    pattern: str
    hint: str


# A match starts at the start of a run of its first class, or where the match before it ended.
BASE = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", ""),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
)
#: a token with a digit or an at sign: runs without ASCII white space
TOKEN = r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"
#: punctuation around a token or a word that is no part of it
OPENING, CLOSING = r"[\"'(\[{<]*+", r"[\"')\]}>.,;:!?]+"
#: a key: letters and digits, 32 or more of them
KEY = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{32,}$"
SECRET = "secret"


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.rlike(x, F.lit(rf"^(?:0*{_BYTE}\.){{3}}0*{_BYTE}$"))
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[ \t-\r]+"), lambda w: w != "")


def _before(text: Column) -> Column:
    """The last two words before a place, from at most 48 characters: lower case, digits as 0, opening punctuation off."""
    tail = F.regexp_replace(F.right(text, F.lit(48)), r"[\"'(\[{<]+$", "")
    return F.slice(F.concat(F.array(F.lit(""), F.lit("")), _words(tail)), -2, 2)


def _after(text: Column) -> Column:
    """The first two words after a place, alike."""
    head = F.regexp_replace(F.left(text, F.lit(48)), "^" + CLOSING, "")
    return F.slice(F.concat(_words(head), F.array(F.lit(""), F.lit(""))), 1, 2)


SPAN = "array<struct<start:int,end:int,x:string,before:array<string>,after:array<string>>>"
CHUNK = 64


def _evaluated(x: Column, f) -> Column:
    """f of x, which is evaluated once: a lambda's variable, not an expression in it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _prefix_sums(lengths: Column) -> Column:
    """Sums of the elements before each. An append copies the array, so sums run within chunks and over chunks."""
    none = F.array().cast("array<int>")

    def sums(x: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(x, zero, lambda a, n: F.struct((a.at + n).alias("at"), F.array_append(a.out, a.at).alias("out")), lambda a: a.out)

    def chunked(x: Column) -> Column:
        return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.size(x), F.lit(CHUNK)), lambda i: F.slice(x, i, CHUNK))).otherwise(F.array().cast("array<array<int>>"))

    def joined(chunks: Column) -> Column:
        totals = sums(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, n: a + n)))
        return _evaluated(totals, lambda t: F.flatten(F.transform(chunks, lambda c, i: F.transform(sums(c), lambda v: v + F.get(t, i)))))

    return _evaluated(F.transform(lengths, lambda n: n), lambda x: _evaluated(chunked(x), joined))


def _found(text: Column, pattern: str, keep=None) -> Column:
    """Every match, or every one that keep() holds for: start and end in code points, its text, the words around it.

    Time grows with the text and its matches, whatever their number: offsets are sums over what lies between matches.
    """

    def spans(parts: Column, hits: Column) -> Column:
        # parts[i] starts after the match before, which is no part of the context
        both = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda p, x: F.length(p) + F.length(x))
        made = _evaluated(
            _prefix_sums(both),
            lambda at: F.transform(
                hits,
                lambda x, i: F.struct(
                    (F.get(at, i) + F.length(F.get(parts, i))).alias("start"),
                    (F.get(at, i) + F.length(F.get(parts, i)) + F.length(x)).alias("end"),
                    x.alias("x"),
                    _before(F.get(parts, i)).alias("before"),
                    _after(F.get(parts, i + 1)).alias("after"),
                ),
            ),
        )
        return made if keep is None else F.filter(made, lambda m: keep(m.x))

    some = _evaluated(F.split(text, pattern, -1), lambda parts: _evaluated(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: spans(parts, hits)))
    return some.cast(SPAN)


def base_spans(text: Column) -> dict[str, Column]:
    """One array column a kind. Matches are leftmost and do not overlap; those that fail their kind's test are dropped."""
    none = F.array().cast(SPAN)
    out = {}
    for k in BASE:
        hint = F.contains(text, F.lit(k.hint)) if k.hint else F.lit(True)
        if k.name != "email":
            hint = hint & F.rlike(text, F.lit("[0-9]"))
        out[k.name] = F.when(hint, _found(text, k.pattern, lambda x, k=k: _valid(k.name, x))).otherwise(none)
    return out


def _labelled(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end")))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s.kind == kind)


def _patterns(s: Column) -> Column:
    """Up to three lexical patterns of a span."""
    l2, l1, r1, r2 = s.before[0], s.before[1], s.after[0], s.after[1]
    every = F.array(
        F.when((l2 != "") & (l1 != ""), F.concat_ws(" ", l2, l1, F.lit("_"))),
        F.when((l1 != "") & (r1 != ""), F.concat_ws(" ", l1, F.lit("_"), r1)),
        F.when((r1 != "") & (r2 != ""), F.concat_ws(" ", F.lit("_"), r1, r2)),
    )
    return F.filter(every, lambda p: p.isNotNull())


def _seeds(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), F.lower(s.x).alias("x"), _patterns(s).alias("patterns")))


def _trimmed(t: Column) -> Column:
    """A token's span without its outer punctuation."""
    opening = F.length(F.regexp_extract(t.x, "^" + OPENING, 0))
    core = F.regexp_replace(F.substring(t.x, opening + 1, F.length(t.x)), CLOSING + "$", "")
    return F.struct((t.start + opening).alias("start"), (t.start + opening + F.length(core)).alias("end"), core.alias("x"), t.before.alias("before"), t.after.alias("after"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def find_pii(docs: DataFrame, key: str, text: str, rounds: int = 3, accept: float = 0.8, support: int = 3) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, row_hash): one row per row of docs.

    The counts and base_sha256 cover the base spans; spans holds kind:start:end of base and added spans by kind, the
    kind secret last, then start; row_hash is a hash of key and text, for joins. An added span has the kind of its best
    pattern, the alphabetically last of equals. A null text counts as empty. Texts are read whole; time grows with their
    length and matches. Keys may be null or repeat; equal rows get equal results. Extra columns are ignored; an empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("rid", F.xxhash64("id", "t"))
    found = base_spans(F.col("t"))
    tokens = F.when(F.rlike(F.col("t"), F.lit("[0-9@]")), _found(F.col("t"), TOKEN)).otherwise(F.array().cast(SPAN))
    base = scratch.save(rows.select("id", "rid", *[c.alias(k) for k, c in found.items()], tokens.alias("tokens")), "base")

    added = _discover(scratch, base, rounds, accept, support)
    spans = F.concat(*[_labelled(k) for k in KINDS])
    out = base.join(added, base.rid == added.arid, "left") if added is not None else base.withColumn("more", F.lit(None).cast("array<struct<kind:string,start:int,end:int>>"))
    more = F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    every = F.concat(*[F.array_sort(F.concat(_of_kind(spans, k), _of_kind(more, k))) for k in (*KINDS, SECRET)])
    return out.select(
        F.col("id").alias(key),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(spans).cast("binary"), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size(more).cast("long").alias("n_added"),
        F.col("rid").alias("row_hash"),
    )


def _uncovered(base: DataFrame) -> DataFrame:
    """(rid, s): the tokens that overlap no base span, by one sweep over a row's spans in either direction."""
    tokens = base.select("rid", F.explode("tokens").alias("s"))
    spans = F.concat(*[F.transform(k, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))) for k in KINDS])
    covered = base.select("rid", F.explode(spans).alias("c"))
    both = tokens.select("rid", "s.start", "s.end", F.lit(1).alias("token"), "s").unionByName(covered.select("rid", "c.start", "c.end", F.lit(0).alias("token")), allowMissingColumns=True)
    row = Window.partitionBy("rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("last", F.max(F.when(F.col("token") == 0, F.col("end"))).over(row.orderBy("start", "token")))
    both = both.withColumn("next", F.min(F.when(F.col("token") == 0, F.col("start"))).over(row.orderBy(F.desc("start"), F.desc("token"))))
    # a span that starts where the token does is counted in last
    clear = F.coalesce(F.col("last") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    return both.where((F.col("token") == 1) & clear).select("rid", "s")


def _discover(scratch: Scratch, base: DataFrame, rounds: int, accept: float, support: int) -> DataFrame | None:
    """(arid, more): the added spans of the rows that have any; None if nothing is accepted."""
    named = F.concat(*[_seeds(k) for k in KINDS])
    seeds = scratch.save(base.select(F.explode(named).alias("s")).select("s.*"), "seeds")
    loose = _uncovered(base).select("rid", _trimmed(F.col("s")).alias("s")).where("s.x <> ''")
    loose = scratch.save(loose.select("rid", "s.start", "s.end", F.lower("s.x").alias("x"), _patterns(F.col("s")).alias("patterns")), "loose")
    keys = loose.where(F.rlike("x", F.lit(KEY))).select("x", F.lit(SECRET).alias("kind"))
    known = scratch.save(seeds.select("x", "kind").union(keys).groupBy("x", "kind").agg(F.lit(1.0).alias("score")), "known")

    edges = seeds.select("x", "patterns").union(loose.select("x", "patterns")).select("x", F.explode("patterns").alias("pattern"))
    edges = scratch.save(edges.groupBy("pattern", "x").agg(F.lit(1).alias("one")).select("pattern", "x"), "all_edges")
    # a pattern with fewer instances can never have the support
    sizes = scratch.save(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support), "sizes")
    edges = scratch.save(edges.join(sizes, "pattern"), "edges")
    scratch.drop("all_edges")
    scores = known
    for k in range(rounds):
        mass = edges.join(scores, "x").groupBy("pattern", "n", "kind").agg(F.sum("score").alias("mass")).where(F.col("mass") >= support - 0.5)
        patterns = scratch.save(mass.select("pattern", "kind", (F.col("mass") / (F.col("n") + 0.5)).alias("p")).where("p >= 0.5"), "patterns")
        more = edges.select("pattern", "x").join(patterns, "pattern").groupBy("x", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("p"))))).alias("score"))
        scores = scratch.save(known.union(more).groupBy("x", "kind").agg(F.max("score").alias("score")), "scores")
    good = scratch.save(patterns.where(F.col("p") >= accept), "good")
    if not good.limit(1).count():
        return None
    placed = loose.select("rid", "start", "end", "x", F.explode("patterns").alias("pattern")).join(good, "pattern")
    best = placed.join(scores.where(F.col("score") >= accept), ["x", "kind"]).groupBy("rid", "start", "end").agg(F.max(F.struct("p", "kind")).alias("b"))
    more = best.select("rid", F.struct("b.kind", "start", "end").alias("s"))
    return more.groupBy("rid").agg(F.collect_list("s").alias("more")).withColumnRenamed("rid", "arid")


def _masked(body: Column, spans: Column, mask: str, chunk: int = 256) -> Column:
    """body with spans, in order, masked. Each chunk of spans cuts its own part out of body, so no step reads all of it."""
    none = F.array().cast("array<string>")

    def part(c: Column, lo: Column, piece: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            keep = F.when(s.start > a.at, F.substring(piece, a.at - lo + 1, s.start - a.at)).otherwise(F.lit(""))
            label = F.when(s.start >= a.at, F.format_string(mask.replace("{}", "%s"), s.kind)).otherwise(F.lit(""))
            return F.struct(F.greatest(a.at, s.end).alias("at"), F.array_append(a.out, F.concat(keep, label)).alias("out"))

        return F.aggregate(c, F.struct(lo.alias("at"), none.alias("out")), step, lambda a: F.array_join(a.out, ""))

    def joined(chunks: Column, ends: Column) -> Column:
        parts = F.transform(chunks, lambda c, i: _evaluated(F.substring(body, F.get(ends, i) + 1, F.get(ends, i + 1) - F.get(ends, i)), lambda piece: part(c, F.get(ends, i), piece)))
        return F.concat(F.array_join(parts, ""), F.substring(body, F.element_at(ends, -1) + 1, F.length(body)))

    def furthest(chunks: Column) -> Column:
        """0, then how far the spans of the first chunk reach, of the first two, and so on."""
        most = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s.end)))
        return F.aggregate(most, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.greatest(F.element_at(a, -1), n)))

    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(chunk)), lambda i: F.slice(spans, i, chunk))
    return _evaluated(F.filter(chunks, lambda c: F.size(c) > 0), lambda cs: _evaluated(furthest(cs), lambda ends: joined(cs, ends)))


def redact(docs: DataFrame, found: DataFrame, key: str, text: str, mask: str = "[{}]") -> DataFrame:
    """docs with every span replaced by its kind in mask; found is find_pii() of the same docs.

    Of spans that overlap, the first gives its kind and all their text goes. A null text stays null, and docs' columns
    are as they were; equal rows get equal texts; an empty table gives an empty result.
    """
    marks = F.when(F.col("_spans") != "", F.transform(F.split("_spans", ","), lambda s: F.split(s, ":"))).otherwise(F.array().cast("array<array<string>>"))
    order = F.array_sort(F.transform(marks, lambda m: F.struct(m[1].cast("int").alias("start"), m[2].cast("int").alias("end"), m[0].alias("kind"))))
    body = F.col(text)
    masked = _evaluated(order, lambda spans: _masked(body, spans, mask))
    by_row = found.where("spans <> ''").select(F.col("row_hash").alias("_row"), F.col("spans").alias("_spans")).groupBy("_row").agg(F.max("_spans").alias("_spans"))
    joined = docs.join(by_row, F.xxhash64(F.col(key), body) == F.col("_row"), "left")
    return joined.withColumn(text, F.when(body.isNotNull() & F.col("_spans").isNotNull(), masked).otherwise(body)).select(*docs.columns)
