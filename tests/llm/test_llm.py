"""Each operator on small fixtures: brute force, round trips, held-out accuracy; nulls, ties, repeats, empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, language, minhash, packing, pii, pivots, repeats, sharding, tokens, toxicity, urls
from palimpsest.llm.components import connected_components
from palimpsest.llm.scratch import Scratch, least_hashed

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, extra int"
RANDOM = random.Random(5)
VOCABULARY = ["".join(RANDOM.choice("abcdefghijklmnop") for _ in range(RANDOM.randint(2, 8))) for _ in range(400)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def corpus():
    """Near copies in chains, exact copies, short, empty and null texts, a repeated row and a null key."""
    rows, k = [], 0
    for g in range(6):
        base = words(120, g)
        for v in range(8):
            t = list(base)
            for j in random.Random(100 * g + v).sample(range(120), v):
                t[j] = "edit%d" % (j % 7)
            rows.append((k, " ".join(t)))
            k += 1
    for s in range(30):
        rows.append((k + s, " ".join(words(60, 1000 + s))))
    k += 30
    rows += [(k, None), (k + 1, ""), (k + 2, "   \n\t "), (k + 3, "one two"), (k + 4, "ONE  two"), (k + 5, rows[0][1]), (k + 6, "word " * 3000), (0, rows[0][1]), (None, rows[0][1])]
    return [(a, b, "xx", 1) for a, b in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 7), (200, 201), (5, 5), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t"))
    want = roots({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    assert {r["id"]: r["component"] for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark, "t")).count() == 0


def brute_near(rows, size, percent):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    links = [(a[0], b[0]) for a, s in zip(rows, sets) for b, t in zip(rows, sets) if s and t and a[0] is not None and b[0] is not None and 100 * len(s & t) >= percent * len(s | t)]
    return sets, roots({r[0] for r in rows if r[0] is not None}, links)


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_documents(spark, size, percent):
    rows = corpus()
    sets, want = brute_near(rows, size, percent)
    got = minhash.near_documents(frame(spark, rows), "doc_id", "text", words=size, percent=percent, block=4).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert Counter(r["n_shingles"] for r in got) == Counter(map(len, sets))
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_documents(frame(spark, []), "doc_id", "text").count() == 0


def test_pairs_of_a_large_group(spark, monkeypatch):
    """5,000 near copies of one text: at most two pairs a member are tested with leaders, and all of them link."""
    base, tested, real = words(80, 31), [], minhash._led
    rows = []
    for k in range(5000):
        t = list(base)
        t[k % 80] = f"edit{k // 80}"
        rows.append((k, " ".join(t), "xx", 1))

    def counted(scratch, pairs, *rest):
        tested.append(pairs.count())
        return real(scratch, pairs, *rest)

    monkeypatch.setattr(minhash, "_led", counted)
    got = minhash.near_documents(frame(spark, rows), "doc_id", "text", words=3, percent=85).collect()
    assert sum(tested) <= 2 * len(rows) and all(r["component_id"] == 0 for r in got) and len(got) == len(rows)


def test_bayes_bounds():
    least = minhash.least_matches(0.85, 1e-4)
    assert len(least) == 4 and least == sorted(least) and 85 < least[-1] < 109


def test_near_vectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 16))
    rows = []
    for k, v in enumerate(base):
        for c in range(6):
            rows.append((len(rows), (v + r.normal(scale=0.05 * c, size=16)).tolist(), k % 3))
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, None, 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, rows[0][1], None), (n + 5, [1.0, None], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [1.0, 2.0], 1)]
    got = {x["vec_id"]: x for x in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label", 0.93, pivots=16, block=8).collect()}
    fine = [(i, np.array(v), g) for i, v, g in rows if v and g is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a[0], b[0]) for a in fine for b in fine if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    count = Counter(a for a, _ in links)
    assert all(got[i]["n_links"] <= count[i] for i, *_ in rows)
    assert sum(x["n_links"] for x in got.values()) >= 0.9 * len(links)
    assert got[n]["n_links"] >= 1 and got[n + 7]["component_id"] == n + 6
    assert all(got[n + k]["n_links"] == 0 and got[n + k]["kept"] for k in (1, 2, 3, 4, 5))
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label").count() == 0


def test_near_vectors_of_a_hot_cluster(spark):
    """A third of the rows are one cluster of near copies."""
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(size=16) + r.normal(scale=0.1, size=(500, 16)), r.normal(size=(1000, 16))])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.93).sum(axis=1) - 1
    rows = [(k, x.tolist(), 1) for k, x in enumerate(v)]
    got = pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label", 0.93).collect()
    assert all(x["n_links"] <= want[x["vec_id"]] for x in got)
    assert sum(x["n_links"] for x in got) >= 0.97 * want.sum()


def test_pivots_follow_the_vectors():
    assert [pivots.pivots_for(n) for n in (0, 1, 51_282, 1_000_000, 64_000_000, 10**10)] == [128, 128, 128, 512, 4096, 4096]


@pytest.mark.parametrize("count", [128, 1024])
def test_recall_by_cosine(spark, count):
    """Planted pairs of 64 dimensions, in bands of cosine from the threshold up, among other vectors."""
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = r.normal(size=(600, 64))
    e -= (e * x).sum(axis=1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    c = np.repeat([0.9301, 0.94, 0.96], 200)[:, None]
    v = np.concatenate([x, c * x + np.sqrt(1 - c * c) * e, r.normal(size=(1500, 64))])
    rows = [(k, a.tolist(), 1) for k, a in enumerate(v)]
    got = {a["vec_id"]: a["n_links"] for a in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label", 0.93, pivots=count).collect()}
    recall = [np.mean([got[k] >= 1 for k in range(200 * band, 200 * band + 200)]) for band in range(3)]
    assert min(recall) >= 0.98 and all(got[k] == 0 for k in range(1200, 2700))


def test_shuffle(spark):
    rows = corpus()
    got = sharding.two_pass_shuffle(frame(spark, rows), "doc_id", "text", shards=5).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((a, b) for a, b, *_ in rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    again = sharding.two_pass_shuffle(frame(spark, rows[::-1]), "doc_id", "text", shards=5).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert sharding.two_pass_shuffle(frame(spark, []), "doc_id", "text").count() == 0


HARD = ["", "  ", " a", "a  b", "a \n b", "x\t y", "it's 'll don't  've", "<|endoftext|> a", "é　 ü x ", "😀 a😀", "a" * 500, " " * 200, "12 34a 5.6", "b " + "a" * 70 + " \n", "The end.\nNext"]


def test_ids_equal_tokenizers():
    """tokenizers as it comes; very long runs of white space and of one letter too."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    enc = tokens.Encoder(path, added=True)
    for text in [*HARD, " ".join(words(300, 1)), "\n" * 1_000_000, "\t\n" * 500_000, "a" * 100_000, " " * 999 + "x", "\n" * 1000 + "<|endoftext|>"]:
        assert np.frombuffer(enc(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces_hold_added_tokens(spark):
    """The ids are those of tokenizers as it comes, which takes <|endoftext|> for one token."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [*HARD, "a <|endoftext|> b<|endoftext|>", "<|endoftext|><|endoftext|>\n", "<|endoftext", "x  <|endoftext|>  y"]
    p = tokens.token_pieces(frame(spark, [(k, x, "xx", 1) for k, x in enumerate(texts)]), path, with_ids=True)
    assert {r["doc_id"]: r["ids"] for r in p.collect()} == {k: t.encode(x, add_special_tokens=False).ids + [2] for k, x in enumerate(texts)}


def test_pieces_and_packing(spark):
    rows = corpus() + [(900, " ".join(words(2500, 9)), "xx", 1)]
    p = tokens.token_pieces(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), size=64, with_ids=True)
    out = packing.pack(p.withColumns({"offset": F.lit("x"), "lower_bound": F.lit(0)}), 64, part_rows=50).collect()
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(tuple(np.frombuffer(enc(t or ""), "<u4").tolist()) + (2,) for _, t, *_ in rows)
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], tuple(r["ids"])))
    one = [tuple(x for _, _, _, ids in sorted(by_doc[900]) for x in ids)]
    assert one[0] in want and all(n == 64 for k, _, n, _ in by_doc[900] if k)
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in places.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 64
    lengths = np.array([r["length"] for r in out])
    bound = packing.lower_bound(lengths, 64)
    assert {r["lower_bound"] for r in out} == {bound} and bound <= len(places) <= 1.03 * bound + 1
    one = packing.pack(p, 64)
    assert one.select("sequence_id").distinct().count() == packing.best_fit_decreasing(lengths, 64).max() + 1
    assert packing.pack(p.where("false"), 64).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(0)
    for k in range(30):
        lengths = r.integers(1, 101, r.integers(1, 60))
        bins = packing.best_fit_decreasing(lengths, 100)
        assert np.bincount(bins, weights=lengths).max() <= 100
        assert packing.lower_bound(lengths, 100) <= bins.max() + 1
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3


def test_urls(spark):
    rules = [urls.Rule("org/", "allow"), urls.Rule("example.org/es/", "block"), urls.Rule("com/de/", "block"), urls.Rule("com/fr/", "allow")]
    rows = [(1, "http://A.Example.ORG/es/1?x"), (2, "https://x.org/a"), (3, "http://q.com/de/1#f"), (4, "http://notorg/"), (5, None), (6, "no scheme"), (7, "http://x.org"), (8, "http://myexample.org/es/"), (9, "http://h?q=/a/"), (2, "https://x.org/a")]
    got = urls.judge_urls(spark.createDataFrame([(a, b, 1) for a, b in rows], "page_id long, url string, host int"), "page_id", "url", rules).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by[2]["rule"] == "org/" and by[3]["verdict"] == "block" and by[4]["rule"] is None and by[7]["rule"] is None and by[8]["rule"] == "org/"
    assert [(by[k]["host"], by[k]["path"]) for k in (5, 6, 9)] == [("", ""), ("", ""), ("h", "")]
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), "page_id", "url", rules).count() == 0


def test_trees_learn(spark):
    df = spark.range(400).selectExpr(*[f"CAST(pmod(hash(id, '{f}'), 100) AS DOUBLE) AS {f}" for f in urls.FEATURES]).withColumn("y", ((F.col("depth") > 60) & (F.col("entropy") > 30)).cast("int"))
    model = urls.train(df, rounds=6)
    right = df.select(((model.predict() >= 0.5).cast("int") == F.col("y")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.95


def test_language(spark):
    kinds = {"aa": ["bla", "blu", "gro", "ist"], "bb": ["chi", "que", "tou", "ñol"]}
    rows = []
    for k in range(200):
        r = random.Random(k)
        lang = "ab"[k % 2] * 2
        rows.append((k, " ".join("".join(r.choice(kinds[lang]) for _ in range(r.randint(1, 3))) for _ in range(30)), lang, 1))
    rows += [(300, None, "aa", 1), (301, "123 !!", "bb", 1), (302, "blagro", None, 1), (303, "x" * 5000, "aa", 1)]
    docs = frame(spark, rows)
    net = language.fit(docs.where(~language.held_out("doc_id")), "text", "lang", sample_windows=800)
    got = {r["doc_id"]: r for r in language.identify(docs, net, "text").collect()}
    held = [(i, l) for i, _, l, _ in rows[:200] if i in got and __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert held and sum(got[i]["lang_pred"] == l for i, l in held) >= 0.95 * len(held)
    assert got[300]["lang_pred"] == got[301]["lang_pred"] == "und" and got[302]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(frame(spark, []), None, "text").count() == 0


def test_samples_differ(spark):
    """Copies take one place of a sample, and few different rows among many copies are all found."""
    few = spark.range(3000).selectExpr("concat('t', id % 3) AS t", "'aa' AS l")
    crowd = spark.range(5000).selectExpr("IF(id < 100, concat('t', id), concat('c', id % 2)) AS t", "'aa' AS l")
    for seed in range(4):
        assert sorted(r["t"] for r in least_hashed(few, 10, "t", "l", seed=seed).collect()) == ["t0", "t1", "t2"]
        assert len({r["t"] for r in least_hashed(crowd, 10, "t", "l", seed=seed).collect()}) == 10


def test_gradients():
    net = language.train([b"ab", b"ba"], ["x", "y"], hidden=3, epochs=1)
    d = net.ahead
    d.wx, d.wh, d.b = (p.astype(np.float64) for p in (d.wx, d.wh, d.b))
    x = np.array([[1, 2, 3]])
    out, tape = d.forward(x, keep=True)
    grads = d.backward(x, tape, np.ones_like(out))
    for p, g, at in ((d.wx, grads[0], (2, 4)), (d.wh, grads[1], (1, 5)), (d.wh, grads[1], (0, 7)), (d.b, grads[2], (2,))):
        p[at] += 1e-5
        up = d.forward(x)[0].sum()
        p[at] -= 2e-5
        down = d.forward(x)[0].sum()
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_toxicity(spark):
    rows = [(k, " ".join(words(30, k) + (["idiot"] if k % 5 == 0 else [])), "xx", 1) for k in range(300)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(200)] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + [(900, None, "xx", 1)])
    chain = toxicity.fit(docs, labels, "doc_id", "text", {"poor": "quality = 0", "toxic": "toxic = 1"})
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain, "doc_id", "text").collect()}
    assert len(got) == 301 and sum(got[k]["is_toxic"] == (k % 5 == 0) for k in range(200, 300)) >= 97
    assert toxicity.fit(docs, labels.where("false"), "doc_id", "text", {"toxic": "toxic = 1"}) is None


def test_toxicity_of_a_group_of_copies():
    """A third of the rows are one toxic text, a third one clean text; none of their words stands elsewhere."""
    texts = [" ".join(words(30, k)) for k in range(100)] + ["quiet rivers wander through meadows"] * 100 + ["vile brutish scum begone forever"] * 100
    labels = np.array([[int(k >= 200)] for k in range(300)])
    order = np.random.default_rng(2).permutation(300)
    chain = toxicity.train([texts[k] for k in order], labels[order], ["toxic"])
    p = chain.probabilities([*texts[:50], texts[150], texts[-1]])[:, 0]
    assert p[-1] >= chain.thresholds[0] and p[-1] > 0.9 and (p[:-1] < chain.thresholds[0]).all()


KIND = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in KIND.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII = ["a@b.c_d@e.f x", "é😀 bob@x.example.com, 1.2.3.4.5 and 300.1.1.1 or 007.1.1.1", "4242 4242-4242 4242 4111111111111112", "+1 (555) 010-2030. +12", "@ a@ a@b a@b.", "1" * 5000, "a" * 3000 + "@", "1.1.1.1 " * 300, None, "", "x@y.z" * 20, "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8"]


def test_base_spans(spark):
    rows = [(k, t, None, 1) for k, t in enumerate(PII)] + [(None, "a@b.co", None, 1), (0, PII[0], None, 1)]
    got = pii.find_pii(frame(spark, rows), "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a@b.co" if r["doc_id"] is None else PII[r["doc_id"]]
        want = base_spans(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:40]
        assert r["n_email"] == sum(w.startswith("email") for w in want)
    assert pii.find_pii(frame(spark, []), "doc_id", "text").count() == 0


def test_patterns_discover(spark):
    rows = [(k, f"Please contact me at user{k}@mail{k}.example.com today", None, 1) for k in range(8)]
    rows += [(100, "Please contact me at bob.smith99(at)corp2024 today", None, 1), (101, "order number 123456789 at all", None, 1)]
    got = {r["doc_id"]: r for r in pii.find_pii(frame(spark, rows), "doc_id", "text").collect()}
    assert got[100]["spans"] == "email:21:44" and got[100]["n_email"] == 0 and got[101]["spans"] == ""
    out = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows), pii.find_pii(frame(spark, rows), "doc_id", "text"), "doc_id", "text").collect()}
    assert out[100] == out[0] == "Please contact me at [email] today" and out[101] == rows[-1][1]


def test_patterns_discover_short_instances(spark):
    """One at sign or one digit makes an instance, however short the token."""
    short = ["jane.doe@intranet", "k7", "user1", "9"]
    rows = [(k, f"Please contact me at user{k}@mail{k}.example.com today", None, 1) for k in range(20)]
    rows += [(100 + k, f"Please contact me at {x} today", None, 1) for k, x in enumerate(short)] + [(200, "room 12 on floor 3, write to a@b", None, 1)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(frame(spark, rows), "doc_id", "text").collect()}
    assert [got[100 + k] for k in range(len(short))] == [f"email:21:{21 + len(x)}" for x in short] and got[200] == ""


def test_found_instances_lend_to_new_patterns(spark):
    """Seeds teach one context; what it finds teaches a second, on the other side, where no seed ever stood."""
    ids = [f"emp-{k}77" for k in range(6)]
    rows = [(k, f"please contact me at user{k}@mail{k}.example.com {w}", None, 1) for k, w in enumerate(words(20, 5))]
    rows += [(100 + k, f"please contact me at {x} {' '.join(words(3, 40 + k))}", None, 1) for k, x in enumerate(ids)]
    rows += [(200 + k, f"{' '.join(words(3, 60 + k))} {x} signed off here", None, 1) for k, x in enumerate(ids)]
    rows += [(300, "then emp-977 signed off here", None, 1), (301, "room 12, floor 3; emp-177 elsewhere", None, 1)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(frame(spark, rows), "doc_id", "text").collect()}
    assert all(got[100 + k] == f"email:21:{21 + len(x)}" for k, x in enumerate(ids))
    assert got[300] == "email:5:12" and got[301] == "" and all(got[200 + k].startswith("email:") for k in range(6))


def test_keys_are_secrets(spark):
    rows = [(k, f"{' '.join(words(4, k))} token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\" {' '.join(words(4, 50 + k))}", None, 1) for k in range(9)]
    rows += [(20, 'set token = "short7" now', None, 1), (21, hashlib.sha1(b"x").hexdigest() + " is a commit", None, 1)]
    found = pii.find_pii(frame(spark, rows), "doc_id", "text")
    got = {r["doc_id"]: r for r in found.collect()}
    assert all(got[k]["spans"].startswith("secret:") and got[k]["n_added"] == 1 for k in range(9))
    assert got[20]["spans"] == "secret:13:19" and got[21]["spans"] == ""
    assert {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows), found, "doc_id", "text").collect()}[20] == 'set token = "[secret]" now'


def test_pii_of_a_long_text(spark):
    """A megabyte of matches; time grows with the text, not with its square."""
    n = 125_000
    rows = [(1, "1.1.1.1 " * n, None, 1), (2, None, None, 1), (3, "", None, 1), (4, "é a@b.co 4111 1111 1111 1111, +1 (555) 010-2030", None, 1)]
    found = pii.find_pii(frame(spark, rows), "doc_id", "text")
    out = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows), found, "doc_id", "text").collect()}
    assert out == {1: "[ip] " * n, 2: None, 3: "", 4: "é [email] [card], [phone]"}


def test_repeats(spark):
    passage = words(70, 77)
    rows = [(k, " ".join(words(90, 500 + k) + (passage if k % 3 == 0 else []) + words(30, 600 + k))) for k in range(24)]
    rows += [(30, " ".join(words(80, 1))), (31, " ".join(words(80, 1))), (32, " ".join(passage + words(20, 3) + passage)), (33, None), (34, "short one"), (35, " ".join(passage[:40]))]
    got = {r["doc_id"]: r for r in repeats.repeated_passages(frame(spark, [(a, b, "x", 1) for a, b in rows]), "doc_id", "text", runs=4).collect()}
    every = {k: (t or "").lower().split() for k, t in rows}
    count = Counter(tuple(w[i : i + 50]) for w in every.values() for i in range(len(w) - 49))
    for k, w in every.items():
        marked = set()
        for i in range(len(w) - 49):
            if count[tuple(w[i : i + 50])] > 1:
                marked |= set(range(i, i + 50))
        assert got[k]["n_words"] == len(w) and got[k]["n_repeated"] == len(marked), k
    assert repeats.repeated_passages(frame(spark, []), "doc_id", "text").count() == 0


def test_repeats_in_a_crowd(spark, monkeypatch):
    """120 texts share a run of words; pairs of them share words before it, too far apart in any order to be neighbours."""
    monkeypatch.setattr(repeats, "MANY", 50, raising=False)
    shared = words(60, 4000)
    rows = [(k, " ".join(words(40, 5000 + k) + words(20, 6000 + k % 60) + shared + words(40, 7000 + k))) for k in range(120)]
    rows += [(200 + k, " ".join(words(40, 8000 + k) + words(15, 9000 + k % 60) + shared[:40] + words(40, 9500 + k))) for k in range(120)]
    for runs in (4, 256):
        got = repeats.repeated_passages(frame(spark, [(a, b, "x", 1) for a, b in rows]), "doc_id", "text", runs=runs).collect()
        every = {k: t.split() for k, t in rows}
        count = Counter(tuple(w[i : i + 50]) for w in every.values() for i in range(len(w) - 49))
        want = {k: {j for i in range(len(w) - 49) if count[tuple(w[i : i + 50])] > 1 for j in range(i, i + 50)} for k, w in every.items()}
        assert {r["doc_id"]: {j for s in r["spans"] for j in range(s["start"], s["end"])} for r in got} == want


def test_repeats_within_one_text(spark):
    """A text that repeats only itself, alone in its tasks: one word over and over, and one passage twice."""
    rows = [(1, "word " * 400), (2, " ".join(words(55, 12) + words(20, 13) + words(55, 12))), (3, " ".join(words(300, 14)))]
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"]] for r in repeats.repeated_passages(frame(spark, [(a, b, "x", 1) for a, b in rows]), "doc_id", "text").collect()}
    assert got == {1: [(0, 400)], 2: [(0, 55), (75, 130)], 3: []}


def test_leaks(spark):
    items = [(k, " ".join(words(40 + k, 800 + k)), 1) for k in range(12)] + [(50, None, 1), (51, "too short", 1)]
    rows = []
    for k in range(12):
        w = items[k][1].split()
        if k % 3 == 1:
            w[10] = "changed"
        if k % 3 == 2:
            w = w[: len(w) // 2]
        rows.append((k, " ".join(words(50, 900 + k) + w + words(20, 950 + k)).upper() if k % 2 else " ".join(words(5, k) + w)))
    rows += [(40, " ".join(words(200, 999))), (41, None), (42, ""), (None, items[0][1]), (0, rows[0][1])]
    it = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame(spark, [(a, b, "x", 1) for a, b in rows]), it).collect()}
    want = set()
    for k, text, *_ in rows:
        for i, item, _ in items:
            a, b = (Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in ((text or "").lower().split(), (item or "").split()))
            at = [Counter(list(map(tuple, zip(*[(text or "").lower().split()[s:][n:] for n in range(5)])))[: sum(b.values())]) for s in range(len((text or "").split()))] if k is not None and a & b else []
            if any(sum((w & b).values()) >= 0.8 * (sum(w.values()) + sum(b.values()) - sum((w & b).values())) for w in at if b):
                want.add((k, i))
    assert got == want and {(0, 0), (10, 10)} <= want and not {(2, 2), (1, 1)} & want
    assert decontaminate.find_leaks(frame(spark, []), it).count() == 0
    assert decontaminate.find_leaks(frame(spark, [(a, b, "x", 1) for a, b in rows]), it.where("false")).count() == 0


def test_block_keys_reach_the_radius(spark):
    r = random.Random(3)
    pairs = []
    for _ in range(40):
        a = r.getrandbits(64) - 2**63
        b = a
        for bit in r.sample(range(63), 20):
            b ^= 1 << bit
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a long, b long")
    near = F.arrays_overlap(decontaminate.block_keys(F.col("a"), 7, 2), decontaminate.block_keys(F.col("b"), 7, 0))
    assert df.where(~near).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = " ".join(words(50, 4321))
    rows = [(a, b, "xx", "s", len(b or "")) for a, b, *_ in corpus() if a is not None][:-1]
    rows += [(500, "intro " + item + " outro", "xx", "s", 1), (501, "write to bob@x.example.com " + " ".join(words(30, 55)), "xx", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    left = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    _, comp = brute_near(left, 5, 80)
    want = {r[0] for r in left if comp[r[0]] == r[0]} - {500}
    assert {r["doc_id"] for r in got} == want
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = next(r[1] for r in rows if r[0] == 501).replace("bob@x.example.com", "[email]")
    assert sum(r["length"] for r in got if r["doc_id"] == 501) == len(enc(text)) // 4 + 1


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    """No rows; and rows that are all rejected: null, empty and letterless texts, with a column more."""
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, piece int"
    for k, rows in enumerate(([], [(1, None, "aa", "s", None, 1), (2, "", None, "s", 0, 1), (None, "12 !", "aa", None, 4, 1)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
        assert pipeline.run(spark, f"{tmp_path}/{k}").count() == 0


def test_pipeline_judges_null_ids(spark, tmp_path):
    """Copies and leaks go whether they have a doc_id or not."""
    pipeline = pytest.importorskip("corpus_pipeline")
    item, a, b = (" ".join(words(60, k)) for k in (4400, 4401, 4402))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, "intro " + item), (2, " ".join(words(60, 4403)))]
    docs = spark.createDataFrame([(k, t, "xx", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    once = pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    left = pipeline.decontaminate(spark, once, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter([(1, a), (None, b), rows[-1]])
