"""Operator 12."""

import hashlib
import random

import numpy as np
import pytest

from quantloom.llm import prefix_hash, queries


def prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def likeness(a, b):
    if not a and not b:
        return 1.0
    p = prefix(a, b)
    return (p + min(prefix(a[::-1], b[::-1]), min(len(a), len(b)) - p)) / max(len(a), len(b))


def fingerprint(t):
    hashes = [sum((ord(c) + 1) * pow(b, i, p) for i, c in enumerate(t)) % p for b, p in zip(prefix_hash.BASES, prefix_hash.PRIMES, strict=True)]
    return f"{len(t):x}-{hashes[0]:08x}{hashes[1]:08x}"


def plain(texts):
    """Of texts in order."""
    for t, u in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        yield len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e), round(likeness(t, e), 9), round(likeness(t, u), 9)


def rows_of(df):
    return [(r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect()]


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_query_against_plain_version(spark, folder, docs, parts, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = queries.op12_prefix_hashes(spark, folder)
        texts = [r.text or "" for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))]
        assert sorted(rows_of(got)) == sorted(plain(texts))
        own = {r.doc_id: r.fingerprint for r in got.collect()}
        assert len(own) == docs.count() and all(own[r.doc_id] == fingerprint(r.text or "") for r in docs.collect() if len(r.text or "") < 2000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repeated_ids_one_row_and_none(spark, docs):
    rows = [(5, "one"), (5, "two"), (5, "one"), (None, "x"), (None, None), (9, "abcdef")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = prefix_hash.fingerprint_neighbours(df, parts=3)
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(str(i) for i, _ in rows)
    assert {(r.doc_id, r.fingerprint) for r in got.collect()} == {(i, fingerprint(t or "")) for i, t in rows}
    # rows of one id and text stand together, so that all but the last have themselves as the next
    assert sum(r.near_next == 1 for r in got.where("doc_id = 9").collect()) == 2
    one = prefix_hash.fingerprint_neighbours(df.where("text = 'abcdef'").limit(1)).first()
    assert (one.edited, one.near_next) == ("abcabc", 1.0)
    assert prefix_hash.fingerprint_neighbours(docs.limit(0)).collect() == []


def test_long_extension_and_slices(spark, monkeypatch):
    """Texts of more than a slice, so that pairs stand in different ones."""
    rng = random.Random(2)
    base = "".join(rng.choice("ab é\U0001f600") for _ in range(700_000))
    texts = [base, base[:350_000] + "!" + base[350_001:], "!" + base[1:], base, "", ""]
    df = spark.createDataFrame(list(enumerate(reversed(texts))), "doc_id long, text string")
    got = [r.near_next for r in prefix_hash.fingerprint_neighbours(df, parts=2).orderBy("doc_id", ascending=False).collect()]
    n = len(base)
    assert got[:3] == pytest.approx([(n - 1) / n, (n - 350_001 + 0) / n, (n - 1) / n]) and got[3:] == [0.0, 1.0, 0.0]


def test_spans(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        b = a[rng.randint(0, 3) :] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))
        rows.append((a, rng.randint(-1, 12), b, rng.randint(0, 12), rng.randint(0, 6), "kept"))
    rows += [(None, 0, "a", 0, 0, "kept"), ("a", None, "a", 0, 1, "kept"), ("a", 0, "a", 0, None, "kept")]
    df = spark.createDataFrame(rows, "a string, i int, b string, j long, n int, same string")
    for r in prefix_hash.common_spans(df, "a", "i", "b", "j", "n").collect():
        if None in (r.a, r.b, r.i, r.j) or not (0 <= r.i <= len(r.a) and 0 <= r.j <= len(r.b)):
            assert (r.same, r.forwards, r.backwards) == (None, None, None)
            continue
        fits = r.n is not None and r.i + r.n <= len(r.a) and r.j + r.n <= len(r.b)
        assert r.same == (r.a[r.i : r.i + r.n] == r.b[r.j : r.j + r.n] if fits else None)
        assert (r.forwards, r.backwards) == (prefix(r.a[r.i :], r.b[r.j :]), prefix(r.a[: r.i][::-1], r.b[: r.j][::-1]))


def test_periodic_and_binary_texts_differ():
    """Strings that are known to collide where sums are taken modulo a power of two."""
    t = "a"
    for _ in range(11):
        t = t + t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    h = prefix_hash.PrefixHashes([t, u, t])
    assert not h.equal(np.array([0]), np.array([2048]), np.array([2048]))[0] and h.equal(np.array([0]), np.array([4096]), np.array([2048]))[0]
