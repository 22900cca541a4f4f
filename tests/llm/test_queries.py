"""The registered opN_ queries themselves, on a small folder of tables: held against SQL twins or brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from palimpsest.llm import packing, queries
from test_llm import base_spans, corpus, words

public_tokenizers = pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")
OPS = queries.queries()
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, shard int, component_id string",
    "embeddings": "vec_id long, embedding array<float>, label int, n_links string",
    "pages": "page_id long, url string, html string, host int",
    "benchmark": "item_id long, text string, doc_id int",
    "labels": "doc_id long, quality int, toxic int, text string",
}


def tables():
    """corpus() with personal data, keys, planted items and passages, long and null texts; columns that clash."""
    texts = [t for _, t, *_ in corpus()]
    items = [" ".join(words(40 + k, 700 + k)) for k in range(6)] + [None, "too short"]
    passage = " ".join(words(60, 9000))
    texts += [f"{' '.join(words(30, 20 + k))} {items[k]} {' '.join(words(9, 30 + k))}" for k in range(6)]
    texts += [f"{' '.join(words(30, 40 + k))} {passage} {' '.join(words(30, 60 + k))}" for k in range(5)]
    texts += [f"{' '.join(words(20, 80 + k))} token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\" mail u{k}@x.example.com 4111 1111 1111 1111 +1 (555) 010-2030 10.0.0.{k}" for k in range(6)]
    texts += ["\n" * 20_000, " ".join(words(20_000, 1)), "a <|endoftext|> b", "é" * 5000]
    texts += [" ".join(words(30, 300 + k)) + (" vile scum" if k % 4 == 0 else "") for k in range(300)]
    docs = [(k, t, None if k % 9 == 0 else ("aa", "bb")[k % 2], "s", None if t is None else len(t), 7, "x") for k, t in enumerate(texts)]
    labels = [(k, 1, int("vile" in (docs[k][1] or "")), "x") for k in range(len(docs)) if k % 3] + [(None, 1, 1, "x")]
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 16)).astype(np.float32)
    vectors = [(base[k % 30] + r.normal(scale=0.04 * (k // 30), size=16)).astype(np.float32).tolist() for k in range(180)]
    vectors += [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, vectors[0], []]
    embeddings = [(k, v, None if k == 5 else k % 2, "x") for k, v in enumerate(vectors)]
    urls = ["http://A.org/x", "https://example.org/es/1?q", "http://sub.example.org/en/12", "http://example.org/en/2", "http://x.com/fr/", "http://y.com/de/a#b", "http://com/de/", "nourl", None, "", "http://example.org?x=/es/", "ftp://h.net/p/q", "http://z.org/" + "a/" * 5000]
    pages = [(k, u, "<p>", 1) for k, u in enumerate(urls * 3)]
    return {"documents": docs, "embeddings": embeddings, "pages": pages, "benchmark": [(k, t, 1) for k, t in enumerate(items)], "labels": labels}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = tables()
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
    return str(at), rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def ran(spark, folder, op):
    return OPS[next(n for n in OPS if n.startswith(op + "_"))](spark, folder)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet/*.parquet'")
    c = con.execute(queries.oracle_sql()[name])
    names = sorted(x[0] for x in c.description)
    want = Counter(tuple(dict(zip((x[0] for x in c.description), r))[n] for n in names) for r in c.fetchall())
    out = OPS[name](spark, folder[0])
    assert sorted(out.columns) == names
    assert Counter(tuple(r[n] for n in names) for r in out.collect()) == want


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty_tables(spark, empty, name):
    assert OPS[name](spark, empty).count() == 0


def test_op1(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, want, bins = defaultdict(list), {}, defaultdict(list)
    for r in ran(spark, folder[0], "op1").collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, text, *_ in folder[1]["documents"]:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want[k] = [(n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {k: sorted(v) for k, v in got.items()} == want
    for places in bins.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    lengths = np.array([p[2] for v in want.values() for p in v])
    assert packing.lower_bound(lengths, 1024) <= len(bins) <= packing.best_fit_decreasing(lengths, 1024).max() + 1


def test_op3(spark, folder):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    got = {r["page_id"]: r for r in ran(spark, folder[0], "op3").collect()}
    assert len(got) == len(folder[1]["pages"])
    for k, url, *_ in folder[1]["pages"]:
        rest = (url or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule = max(fit, key=len, default=None)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == rules.get(rule, got[k]["verdict"]) and got[k]["verdict"] in ("allow", "block")


def test_op5(spark, folder):
    docs = {k: (t or "").encode() for k, t, *_ in folder[1]["documents"]}
    got = ran(spark, folder[0], "op5").collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in docs.items()}
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(16)) and max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_op6(spark, folder):
    got = {r["doc_id"]: r for r in ran(spark, folder[0], "op6").collect()}
    for k, text, *_ in folder[1]["documents"]:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= got[k]["score"] <= 1
        assert (got[k]["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text or "")) and got[k]["lang_pred"] in ("aa", "bb", "und")


def test_op7(spark, folder):
    got = {r["doc_id"]: r for r in ran(spark, folder[0], "op7").collect()}
    toxic = {k: "vile" in (t or "") for k, t, *_ in folder[1]["documents"]}
    assert set(got) == set(toxic) and sum(got[k]["is_toxic"] == toxic[k] for k in toxic) >= 0.97 * len(toxic)


def test_op8(spark, folder):
    got = {r["doc_id"]: r for r in ran(spark, folder[0], "op8").collect()}
    for k, text, *_ in folder[1]["documents"]:
        base = base_spans(text)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in ("email", "ip", "card", "phone")] == [sum(b.startswith(x + ":") for b in base) for x in ("email", "ip", "card", "phone")]
        assert set(base) <= set(got[k]["spans"].split(",")) or not base
        key = re.search(r'token = "([0-9a-f]+)"', text or "")
        assert (f"secret:{key.start(1)}:{key.end(1)}" in got[k]["spans"].split(",")) if key else got[k]["n_added"] == 0
