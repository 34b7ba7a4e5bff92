"""Operators 2 and 9."""

import numpy as np
import pytest

from quantloom.llm import queries, sharding, url_filter

URLS = [None, "", "no-scheme.net/x", "http://a.example.net/en/1", "HTTP://WWW.Example.NET/en/1?x#y", "https://x.net", "https://x.net/", "http://example.com/de/1", "http://m.example.com/fr/2", "http://notexample.com/de/1", "http://a.org/fr/x", "http://a.org/de/x", "http://a.org?/fr/", "a://b://c.net/x", "http://net/", "http://É.net/é"]


def brute(url, rules=url_filter.RULES):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")


def test_judge_urls(pages):
    for r in url_filter.judge_urls(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute((URLS * 2)[r.page_id])
    assert url_filter.judge_urls(pages.limit(0)).collect() == []


def test_sharded_is_the_same(spark, pages):
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    key = lambda df: sorted(df.collect(), key=lambda r: r.page_id)
    assert key(url_filter.judge_urls_sharded(pages, rules, shards=3)) == key(url_filter.judge_urls(pages))


def test_digests_that_collide(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    words = [f"w{i}" * (i % 4 + 1) for i in range(50)]
    a = url_filter.DigestArray.mapped(url_filter.DigestArray.pack((w, i) for i, w in enumerate(words)))
    assert a.probe(words).tolist() == list(range(50)) and a.probe(["none", "nope!", ""]).tolist() == [-1] * 3
    assert url_filter.DigestArray.mapped(url_filter.DigestArray.pack([])).probe(["x"]).tolist() == [-1]


def test_large_list_is_not_broadcast(pages, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 10)
    with pytest.raises(ValueError, match="sharded"):
        url_filter.judge_urls(pages)


def brute_table(names, size):
    import hashlib

    prefs = []
    for x in names:
        d = hashlib.sha256(x.encode()).digest()
        off, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        prefs.append([(off + j * skip) % size for j in range(size)])
    table = [-1] * size
    while -1 in table:
        for i, p in enumerate(prefs):
            free = [s for s in p if table[s] < 0]
            if free:
                table[free[0]] = i
    return table


def test_table_is_filled_in_turns():
    names = [f"n{i}" for i in range(5)]
    assert sharding.lookup_table(names, 101).tolist() == brute_table(names, 101)
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(names, 100)
    with pytest.raises(ValueError, match="distinct"):
        sharding.lookup_table(["a", "a"], 101)


def test_shards_are_even_and_few_slots_move():
    names = [f"s{i}" for i in range(20)]
    a, b = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    counts = np.bincount(a)
    assert counts.max() - counts.min() <= 1
    stays = a < 19
    assert (a[stays] != b[stays]).mean() < 0.05


def test_assign_shards(spark, docs):
    df = docs.select("doc_id", "text").withColumn("shard", docs.text)
    rows = sharding.assign_shards(df, ["doc_id"], ["a", "b", "c"], 101).collect()
    table = sharding.lookup_table(["a", "b", "c"], 101)
    assert len(rows) == df.count() and all(r.shard == table[r.slot] for r in rows)
    assert sharding.assign_shards(df.limit(0), ["doc_id"], ["a"], 101).collect() == []
    assert {"op9_shard_lookup", "op2_url_rules"} <= queries.QUERIES.keys()


def test_ties_and_other_capitals(spark):
    rules = [("ÄB.de", "", "block"), ("b.co", "/xy", "block"), ("a.b.co", "/", "allow"), ("q.io", "/", "allow"), ("Q.io", "/", "block")]
    urls = ["http://ÄB.de/", "http://äb.de/", "http://a.b.co/xy", "http://q.io/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = ["block", "allow", "allow", "allow"]
    assert [r.verdict for r in url_filter.judge_urls(df, rules).orderBy("page_id").collect()] == want
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert [r.verdict for r in url_filter.judge_urls_sharded(df, listed, shards=2).orderBy("page_id").collect()] == want


def test_query_places_by_brute_force(spark, folder, docs):
    """The slot is the key's hash, the shard the one that a turn by turn filling of all 65,537 slots gives."""
    import hashlib

    import xxhash

    size, names = 65_537, queries.SHARDS
    at, step = zip(*(((int.from_bytes(d[:8], "big") % size), int.from_bytes(d[8:16], "big") % (size - 1) + 1) for d in (hashlib.sha256(x.encode()).digest() for x in names)), strict=True)
    owner, turn = {}, [0] * len(names)
    while len(owner) < size:
        for i in range(len(names)):
            if len(owner) == size:
                break
            while (at[i] + turn[i] * step[i]) % size in owner:
                turn[i] += 1
            owner[(at[i] + turn[i] * step[i]) % size] = i
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    got = queries.op9_shard_lookup(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    for r in got:
        h = 42 if r.doc_id is None else signed(xxhash.xxh64_intdigest(int(r.doc_id).to_bytes(8, "little", signed=True), 42))
        assert r.slot == h % size and r.shard == owner[r.slot]
    assert {r.doc_id: r.n_bytes for r in got} == {r.doc_id: len((r.text or "").encode()) for r in docs.collect()}
