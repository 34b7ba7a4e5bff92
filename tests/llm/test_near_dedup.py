"""Operator 10 against all pairs."""

import itertools
import random
import re

import pytest

from quantloom.llm import near_dedup, queries
from quantloom.llm.graph import components


def brute(rows):
    """doc -> (set size, smallest reachable id)."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = brute([r for r in rows if r[0] is not None])
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
        else:
            assert r.component_id is None and r.kept


def test_odd_texts_and_copies(spark, docs):
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])


def test_groups_of_edits(spark, words):
    rng, rows = random.Random(4), []
    for group in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(6, 250))]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    boiler = " ".join(rng.choice(words) for _ in range(60))
    rows += [boiler + " " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rng.shuffle(rows)
    check(spark, [*enumerate(rows)])


def test_a_chain_of_links(spark):
    w = [f"w{i}" for i in range(400)]
    check(spark, [(i, " ".join(w[12 * i : 12 * i + 200])) for i in range(16)])


def test_repeated_rows_and_empty(spark):
    text = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(1, 26, 1, True), (1, 26, 1, True), (2, 26, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []
    assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(df).collect()) == [1, 1, 3, 4]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for e in edges for x in e if e[0] != e[1])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op10_bottom_k(spark, path).collect()} == want


def test_rows_of_one_id_are_dropped_by_their_own_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, 7), (2, a, 7), (2, b, 7), (2, a, 8), (None, a, 7), (3, None, 7), (4, None, 7), (5, b, 9), (6, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    left = near_dedup.drop_near_duplicates(df)
    assert left.schema == df.schema
    assert sorted(map(str, left.collect())) == sorted(map(str, spark.createDataFrame([rows[i] for i in (0, 2, 4, 5, 6, 8)], df.schema).collect()))
    assert near_dedup.drop_near_duplicates(df.limit(0)).collect() == []


def test_stars_take_no_turn(spark, monkeypatch):
    """Links between known labels are added to these; stars are told as such without another turn of joins."""
    from quantloom.llm import graph

    written, put = [], graph.Scratch.written
    monkeypatch.setattr(graph.Scratch, "written", lambda self, df, what: (written.append(what), put(self, df, what))[1])
    found = components(spark.createDataFrame([(2, 1), (3, 1), (7, 5), (1, 1)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 5)] and written == ["edges0"]
    joined = components(found.toDF("a", "b").union(spark.createDataFrame([(7, 3)], "a long, b long")))
    assert sorted(map(tuple, joined.collect())) == [(x, 1) for x in (1, 2, 3, 5, 7)]
    written.clear()
    texts = [" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59)), "another text of a few words"]
    got = near_dedup.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(0, 0), (1, 0), (2, 2)]
    assert [w for w in written if w.startswith("edges")] == ["edges0", "edges0"]
