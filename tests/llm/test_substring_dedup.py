"""Operator 8 and its index against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from quantloom.llm import queries, substring_dedup
from quantloom.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(id, text) -> words, removed, kept."""
    seen = {}
    for d, t in sorted(r for r in rows if r[0] is not None):
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), d)
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and seen[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        yield d, len(w), sum(gone), [x for x, g in zip(w, gone) if not g]


def check(spark, rows, window=50):
    df = spark.createDataFrame([(d, t, 3, 4) for d, t in rows], "doc_id long, text string, n_removed int, whole int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, WORD.findall(r.text or "")) for r in substring_dedup.remove_repeats(df, window=window).collect()), key=repr)
    assert got == sorted(brute(rows, window), key=repr)


def test_odd_texts_and_copies(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(spark, rows)
    kept = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    whole = {(d, n) for d, _, n, _ in brute(rows, 50)}
    assert all(kept[d] == t for d, t in rows if (d, 0) in whole)  # texts that lose nothing stay byte for byte


@pytest.mark.parametrize("hot", [1, 5, 10**6])
@pytest.mark.parametrize("shard", [40, 1 << 19])
def test_passages(spark, words, monkeypatch, hot, shard):
    """A passage that most documents share, others that few do, overlaps and periodic texts."""
    monkeypatch.setattr(substring_dedup, "HOT_TEXTS", hot)
    monkeypatch.setattr(substring_dedup, "MARK_BITS", 1 << 18 if hot == 1 else 1 << 25)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rng, rows = random.Random(hot), []
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage, others = some(70), [some(rng.randint(40, 90)) for _ in range(5)]
    for i in range(40):
        t = some(rng.randint(0, 60)) + passage[rng.randint(0, 5) : rng.randint(60, 70)] + some(rng.randint(0, 30)) + rng.choice(others) + some(rng.randint(0, 9))
        rows.append((i * 3, " ".join(t)))
    rows += [(200 + i, "ab " * rng.randint(1, 200) + "cd " * rng.randint(1, 80)) for i in range(6)]
    rng.shuffle(rows)
    check(spark, rows)


def test_short_window_and_same_ids(spark):
    check(spark, [(1, "a b c d e"), (2, "x b c d y"), (3, "b c d b c d"), (4, None), (None, "a b c d e"), (5, "")], 3)
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "b c d z"), (2, "z b c d")], "doc_id long, text string")
    assert sorted(r.text for r in substring_dedup.remove_repeats(df, window=3, counts=None).collect()) == ["a b c d", "a b c d", "b c d z", "z "]
    assert substring_dedup.remove_repeats(df.limit(0)).collect() == []


def test_statistics_of_foreign_texts():
    rng = random.Random(1)
    pack = lambda S: (np.array([x for s in S for x in s], np.int64), np.cumsum([0] + [len(s) for s in S]))
    for trial in range(100):
        limit, v = rng.randint(1, 9), rng.randint(1, 6)
        seqs = [[rng.randint(1, v) * 7 for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 12))]
        asked = seqs if trial % 2 else [[rng.randint(1, v + 1) * 7 for _ in range(rng.randint(1, 30))] for _ in range(4)]
        index, (w, b) = FMIndex(*pack(seqs), limit), pack(asked)
        depth, full = index.statistics(w, b), index.statistics(w, b, limit)
        for q, s in zip(asked, b):
            for i in range(len(q)):
                occurs = lambda m: any(t[j : j + m] == q[i : i + m] for t in seqs for j in range(len(t) - m + 1))  # noqa: B023, E731
                m = max(m for m in range(min(limit, len(q) - i) + 1) if m == 0 or occurs(m))
                assert depth[s + i] == m and (full[s + i] >= limit) == (m >= limit)


def test_search_in_groups():
    """Windows of later documents that earlier ones of the key's group have; documents with several stretches, copies."""
    rng = random.Random(2)
    for _ in range(60):
        window, rows = rng.randint(2, 4), []
        for key in range(rng.randint(1, 4)):
            for _ in range(rng.randint(1, 9)):
                low = rng.randint(0, 6)
                rows.append((key, low, low + rng.choice((0, 0, 2)), [10 * key + rng.randint(0, 2) for _ in range(rng.randint(window, 9))]))  # equal windows have equal keys
        symbols, bounds = np.array([x for r in rows for x in r[3]], np.int64), np.cumsum([0] + [len(r[3]) for r in rows])
        before, copied = substring_dedup.search(*(np.array([r[k] for r in rows]) for k in range(3)), symbols, bounds, window)
        windows = lambda r: [tuple(r[3][i : i + window]) for i in range(len(r[3]) - window + 1)]  # noqa: B023, E731
        for r, at in zip(rows, bounds):
            earlier = lambda d: {x for o in rows if o[0] == r[0] and o[1] < d for x in windows(o)}  # noqa: B023, E731
            for i, x in enumerate(windows(r)):
                assert before[at + i] == (x in earlier(r[1]))
                assert r[2] == r[1] or copied[at + i]


def mirrored(size, a="a", b="b"):
    """Two sequences of so many signs that a polynomial hash modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return [b if x else a for x in bits], [a if x else b for x in bits]


def test_sequences_that_weak_hashes_confuse(spark):
    p, q = ("".join(x) for x in mirrored(1024))
    other = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([p, *other])), (2, " ".join([q, *other]))]
    rows += [(3 + i, " ".join(x)) for i, x in enumerate(mirrored(1024, "x", "y"))]
    check(spark, rows)


def test_query(spark, folder, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {(d, n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, n, g, k in brute(rows, 50)}
    assert {tuple(r) for r in queries.op8_fm_index(spark, folder).collect()} == want
