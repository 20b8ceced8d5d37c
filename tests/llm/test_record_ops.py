"""WARC, sharding, URL filter, embeddings, and queries against their SQL."""

import base64
import gzip
import hashlib
import random
import uuid
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from stratum.llm import embeddings, registry, sharding, url_filter, warc
from stratum.llm.common import Scratch, connected_components, shared_dir


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf).toPandas()[list(want.columns)]
    cells = lambda df: sorted(tuple("null" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in df.astype(object).itertuples(index=False))
    assert cells(got) == cells(want)


# -- op 2 ----------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def archive(spark, rows, **how):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    warc.write_archive(spark.createDataFrame(rows, PAGES).withColumn("sha256", F.lit("clash")), path, **how)
    return path


def test_archive_round_trip(spark):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "u\r\nv", "é" * 9), (4, "u", None), (5, "u", ""), (None, "u", "x"), (6, "u%20v%", "long " * 50_000)]
    path = archive(spark, rows)
    got = {r.page_id: r for r in warc.read_index(spark, path).collect()}
    for i, url, html in rows:
        raw = (html or "").encode()
        assert got[i].url == url and got[i].payload_bytes == len(raw) and got[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), None: ("revisit", 2), 6: ("response", None)}
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = warc.reconstruct(spark, path)
    assert {(r.page_id, r.url, bytes(r.payload).decode()) for r in records.collect()} == {(i, u, h or "") for i, u, h in rows}
    assert all(bytes(r.record).startswith(b"WARC/1.1\r\n") for r in records.collect())
    files = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    warc.write_files(records, files, file_bytes=200)
    raw = [gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(files).collect()]
    assert len(raw) > 1 and sum(len(list(warc.parse_stream(x))) for x in raw) == len(rows)
    back = {r.page_id: (r.record_type, bytes(r.payload)) for r in warc.read_files(spark, files).collect()}
    assert back[6] == ("response", ("long " * 50_000).encode()) and back[1] == ("revisit", b"") and len(back) == len(rows)


def test_archive_edges(spark):
    assert warc.read_index(spark, archive(spark, [])).count() == 0
    twice = warc.read_index(spark, archive(spark, [(1, "u", "x")] * 3)).collect()
    assert [r.record_type for r in twice] == ["response"] * 3
    none = warc.read_index(spark, archive(spark, [(None, "u", "x")] * 2)).collect()
    assert [r.record_type for r in none] == ["response"] * 2
    small = warc.read_index(spark, archive(spark, [(1, "u", "x"), (2, "u", "x")], min_bytes=5)).collect()
    assert {r.record_type for r in small} == {"response"}


def test_payload_of_many_records_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 10)
    rows = [(i, f"u{i}", "the same") for i in range(100)] + [(200, "u", "other")]
    path = archive(spark, rows)
    got = warc.reconstruct(spark, path).collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == rows
    assert {r.refers_to for r in got} == {99, None}


def test_records_without_id_are_told_apart(spark):
    records = warc.reconstruct(spark, archive(spark, [(None, "u", "x"), (None, "u", "x"), (None, "v", "y")])).collect()
    ids = [warc.parse_header(bytes(r.record).partition(b"\r\n\r\n")[0])["warc-record-id"] for r in records]
    assert len(set(ids)) == 3


def test_damaged_payload_is_noticed(spark):
    path = archive(spark, [(1, "u", "x")])
    bad = spark.read.parquet(f"{path}/payloads").withColumn("body", F.lit(zstandard.compress(b"z")))
    other = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    bad.write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="other bytes"):
        warc.reconstruct(spark, other).collect()


# -- op 5 ----------------------------------------------------------------------


def check_shards(rows, out, shards, largest):
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows)
    text, slots, sizes = dict(rows), defaultdict(list), [0] * shards
    for r in out:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes) / shards
    assert max(abs(s - mean) for s in sizes) <= largest + 0.11 * mean


@pytest.mark.parametrize("kind", ["even", "hot group", "long"])
def test_shards_are_even(spark, kind):
    rng = random.Random(kind)
    rows = [(i, "x" * rng.randrange(400) + str(i)) for i in range(3000)]
    if kind == "hot group":
        rows = [(i, "the same text " * 10 if i % 3 else t) for i, t in rows]
    if kind == "long":
        rows += [(9000 + i, "y" * 20_000 + str(i)) for i in range(4)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("k1", F.lit(1)), 8).collect()
    check_shards(rows, out, 8, max(len(t) for _, t in rows) + 16)
    if kind == "even":
        again = sharding.assign(spark.createDataFrame(rows[::-1], "doc_id long, text string"), 8).collect()
        assert {r.doc_id: r.shard for r in again} == {r.doc_id: r.shard for r in out}


def test_small_groups_stay_whole(spark):
    rows = [(i, f"text {i // 4} " * 5) for i in range(8000)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    where = defaultdict(set)
    for r in out:
        where[r.doc_id // 4].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_shard_edges(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert sharding.assign(df([]), 4).count() == 0
    assert sharding.assign(df([(1, None)]), 4).first().text_crc32 == 0
    same = sharding.assign(df([(1, "a")] * 5 + [(None, "b"), (None, "c")]), 3).collect()
    assert len(same) == 7
    slots = defaultdict(list)
    for r in same:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.shard for r in sharding.assign(df([(i, str(i)) for i in range(9)]), 1).collect()} == {0}


def test_write_shards(spark):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    df = df.withColumns({"size": F.lit(-1), "k1": F.lit("a"), "k2": F.lit("b"), "shard": F.lit("c")})
    sharding.write_shards(df, 5, path)
    back = sharding.read_shards(df, path)
    assert back.columns == [*df.columns, "_shard"] and back.select("_shard").distinct().count() == 5
    assert sorted(back.drop("_shard").collect()) == sorted(df.collect())
    empty = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    sharding.write_shards(df.limit(0), 5, empty)
    with pytest.raises(ValueError, match="in the way"):
        sharding.write_shards(df.withColumn("_shard", F.lit(1)), 5, path)


def brute_shards(rows, shards):
    """Rows in the order of their hashes, cut at the border of a group that is nearest to each target."""
    total = sum(r.size for r in rows)
    rows = sorted(rows, key=lambda r: (r.k1, r.k2))
    border, at = {0: 0}, 0
    for i, r in enumerate(rows):
        at += r.size
        if i + 1 == len(rows) or rows[i + 1].k1 != r.k1:
            border[i + 1] = at
    return rows, [min(border.items(), key=lambda b: abs(b[1] - total * (s + 1) / shards)) for s in range(shards - 1)], total


def test_shards_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keyed = docs.select("doc_id", "text", (F.octet_length("text") + 16).alias("size"), F.xxhash64("text").alias("k1"), F.xxhash64("doc_id").alias("k2")).collect()
    out = sharding.op5_sharding(spark, sf).collect()
    check_shards([(r.doc_id, r.text) for r in keyed], out, 40, max(r.size for r in keyed) + 0.1 * sum(r.size for r in keyed) / 40)
    where = {r.doc_id: r.shard for r in out}
    rows, cuts, total = brute_shards(keyed, 40)
    shards = [where[r.doc_id] for r in rows]
    assert shards == sorted(shards), "shards follow the order of the keys"
    for s, (_, below) in enumerate(cuts):
        got = sum(r.size for r in keyed if where[r.doc_id] <= s)
        assert abs(got - total * (s + 1) / 40) <= abs(below - total * (s + 1) / 40) + 0.0005 * total / 40
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}


def test_only_large_groups_are_cut(spark):
    rows = [(i, f"{i % 300} " * 20) for i in range(3000)]
    assert sharding.cut_groups(spark.createDataFrame(rows, "doc_id long, text string"), 10) == 0
    rows += [(9000 + i, "large " * 50) for i in range(2000)]
    assert sharding.cut_groups(spark.createDataFrame(rows, "doc_id long, text string"), 10) == 1


# -- op 7 ----------------------------------------------------------------------


def brute_rule(host, path, rules):
    best = None
    for action, rule in rules:
        h, p = url_filter.split_rule(rule)
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return best


def test_urls_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    part = lambda: rng.choice(["a", "b", "example", "x-y"])
    rules = [(rng.choice(["block", "allow"]), f"{part()}.{rng.choice(['com', 'net'])}/{rng.choice(['', 'en/', 'en/7', 'd'])}") for _ in range(30)] + [("block", "com/en/")]
    rules = list({r: (a, r) for a, r in rules}.values())
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'A.b.'])}{part()}.{rng.choice(['com', 'net', 'org'])}{rng.choice(['', '/', '/en/', '/en/77?q=/x', '/d#e', '?en/'])}" for _ in range(2000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = url_filter.filter_urls(pages, rules).collect()
    monkeypatch.setattr(url_filter, "MAX_RULE_BYTES", 10)
    assert sorted(url_filter.filter_urls(pages, rules).collect()) == sorted(got)
    for r in got:
        best = brute_rule(r.host, r.path, rules)
        assert (r.verdict, r.rule) == (best or ("allow", None)), urls[r.page_id]


def test_url_edges(spark):
    rows = [(1, None), (2, "no scheme/en/"), (3, "http://"), (4, "x://HOST.Com/En/?a#b"), (5, "a://b://c/d"), (6, "http://É.com/en/"), (6, "http://É.com/en/"), (None, "http://com/en/")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filter.DEFAULT_RULES).collect()
    assert [(r.host, r.path, r.verdict) for r in got] == [("", "", "allow"), ("", "", "allow"), ("", "", "allow"), ("host.com", "/En/", "allow"), ("b:", "//c/d", "allow"), ("É.com", "/en/", "block"), ("É.com", "/en/", "block"), ("com", "/en/", "block")]
    assert {r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), []).collect()} == {"allow"}
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.DEFAULT_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.RuleIndex([("deny", "x/")])
    for how in (url_filter.filter_urls, lambda p, r: url_filter.filter_urls_by_table(p, spark.createDataFrame(r, "action string, rule string"))):
        more = spark.createDataFrame([(1, "http://\u00c9X.com/a"), (2, "http://h.org/" + "a" * 300_000), (3, "http://ab/c"), (4, "http://q/x"), (5, None)], "page_id long, url string")
        rules = [("block", "\u00c9X.com/"), ("block", "H.org/a"), ("allow", "b/c"), ("block", "ab/"), ("block", "q/x"), ("allow", "q/x"), ("allow", "x.a/1"), ("block", "a/1/"), ("block", "x.a/1")]
        got = {r.page_id: (r.rule, r.verdict) for r in how(more, rules).collect()}
        assert got == {1: ("\u00c9x.com/", "block"), 2: ("h.org/a", "block"), 3: ("ab/", "block"), 4: ("q/x", "block"), 5: (None, "allow")}
        tie = spark.createDataFrame([(1, "http://www.a/bc")], "page_id long, url string")
        assert [r.rule for r in how(tie, [("allow", "a/bc"), ("block", "www.a/"), ("block", "www.a/b"), ("allow", "a/b")]).collect()] == ["www.a/b"]
    with pytest.raises(ValueError, match="in the way"):
        url_filter.filter_urls(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, rule string"), [], keep=["page_id", "rule"])


def test_colliding_keys_are_confirmed(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 7)
    index = url_filter.RuleIndex([("block", "a.com/x"), ("allow", "b.com/y")])
    assert [index.rules[k] if k >= 0 else None for k in index.longest([("a.com", "/x"), ("b.com", "/y"), ("c.com", "/x")])] == ["a.com/x", "b.com/y", None]


# -- op 9 ----------------------------------------------------------------------


def brute_vectors(rows):
    ok = [(i, np.array(v, dtype=float), lab) for i, v, lab in rows if i is not None and v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = defaultdict(int), {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for k, (i, v, a) in enumerate(ok):
        for j, w, b in ok[:k]:
            if a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i, _, _ in rows if i is not None}


@pytest.mark.parametrize(("spread", "block"), [("random", 64), ("clusters", 64), ("low", 64), ("clusters", 2048), ("low", 7)])
def test_vectors_against_brute_force(spark, spread, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "DEAL", 100)
    rng = np.random.default_rng(3)
    dims = 3 if spread == "low" else 24
    base = rng.normal(size=(40 if spread == "clusters" else 600, dims))
    rows = []
    for i in range(600):
        v = base[i % len(base)] + (rng.normal(size=dims) * 0.06 if spread == "clusters" else 0)
        rows.append((i, [float(x) for x in v], int(i % 7 != 0)))
    rows += [(1000 + i, rows[3][1], 1) for i in range(30)]
    stats: dict = {}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), stats=stats).collect()}
    assert got == brute_vectors(rows)
    assert stats["compared"] < stats["pairs"]


def test_vectors_within_the_chord_link_whole(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, *(rng.normal(size=5) * 0.004)], 1) for i in range(150)] + [(500 + i, [0.0, 1.0, *(rng.normal(size=4) * 0.5)], 1) for i in range(90)]
    rows = [(i, [float(x) for x in v], lab) for i, v, lab in rows]
    stats: dict = {}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), stats=stats).collect()}
    assert got == brute_vectors(rows) and got[0] == (149, 0) and stats["compared"] < 150 * 149 / 2


def test_cosine_at_the_threshold_links(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.6, 0.8], 1), (3, [0.59, 0.81], 1)]
    got = {r.vec_id: r.n_links for r in embeddings.similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.6).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_cover_tree_levels(spark):
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(400, 3))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tree = embeddings.CoverTree(unit, np.arange(400))
    assert sorted(tree.order.tolist()) == list(range(400))
    for node, kids in enumerate(tree.children):
        own = unit[tree.order[tree.start[node] : tree.stop[node]]]
        assert np.sqrt(((own - tree.centre[node]) ** 2).sum(axis=1)).max() <= tree.reach[node] + 1e-7
        if kids is not None:
            centres = tree.centre[list(kids)]
            assert (centres[0] == tree.centre[node]).all() and max(tree.reach[list(kids)]) <= tree.reach[node] + 1e-6
            assert [tree.start[node], tree.stop[node]] == [tree.start[kids[0]], tree.stop[kids[-1]]]


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e200, 0.0], 1), (None, [1.0, 0.0], 1), (13, [-0.0, -1.0], 1)]
    out = embeddings.similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert got[1] == (2, 1, True) and got[2] == got[12] == (2, 1, False) and got[None] == (0, None, None)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 13)) and len(out) == 14
    assert embeddings.similar(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# -- shared --------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 700 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    s = Scratch(spark, "test")
    got = {r.node: r.root for r in connected_components(s, spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert connected_components(s, spark.createDataFrame([], "a long, b long"), "d").count() == 0
