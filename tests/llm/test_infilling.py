"""Operator 13."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import infilling, queries


def plain(doc, text):
    t = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, t
    if h4 % 100 < 20:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


KEY = lambda r: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in r)


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(9)
    texts = ["<P> in it", "a <M>", "<", "<S", "S>", "<P", "end <", "<<S>", "it<", "x" * 5000, "é1é", "a-b c"] + ["same text, many times <"] * 300 + ["other"] * 40
    texts += ["".join(rng.choice(["ab", " ", "<", "S", ">", "P", "é", "1", "\n", "M"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(5, "it<", "clash"), (None, "no id", "clash"), (None, None, "clash"), (7, "other", "clash"), (7, "other", "clash")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(5)


@pytest.mark.parametrize("most", [1, 7, 1024])
def test_against_plain_version(many, most):
    got = infilling.fill_in_middle(many, most=most)
    want = [plain(r.doc_id, r.text) for r in many.collect()]
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(want, key=KEY)
    back = got.select("doc_id", infilling.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(map(tuple, back.collect()), key=KEY) == sorted(((r.doc_id, r.text or "") for r in many.collect()), key=KEY)


def test_query(spark, folder, docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*p[:5], sha(p[5]), sha(r.text or "")) for r in docs.collect() for p in [plain(r.doc_id, r.text)]]
    assert sorted(map(tuple, queries.op13_fill_in_middle(spark, folder).collect()), key=KEY) == sorted(want, key=KEY)


def test_nothing(spark, nothing):
    assert queries.op13_fill_in_middle(spark, nothing).collect() == []


def test_entries(many):
    """One entry a text, and parts of a common one; groups are told by content, also where digests are of no use."""
    index = infilling.boundary_index(many).collect()
    assert len({r.text for r in index}) == len(index) and sum(len(r.docs) for r in index) == many.count()
    parts = [len(r.docs) for r in infilling.distinct_texts(many, most=50).where("text like 'same%'").collect()]
    assert sum(parts) == 300 and len(parts) >= 6 and max(parts) < 100
    for r in index:
        ends = infilling.token_ends(r.text)
        assert r.n_tokens == len(ends) and infilling.EliasFano(bytes(r.ends)).select(np.arange(len(ends))).tolist() == ends.tolist()


def test_digests_that_collide(many, monkeypatch):
    keyed = infilling._keyed
    monkeypatch.setattr(infilling, "_keyed", lambda df, doc, text: keyed(df, doc, text).withColumns({"d1": F.length("text").cast("long") % 2, "d2": F.lit(0).cast("long")}))
    test_against_plain_version(many, 1024)


@pytest.mark.parametrize("n, top", [(0, 0), (1, 1), (1, 1 << 40), (5, 5), (1000, 1000), (1000, 90_000), (3, 70)])
def test_lists(n, top):
    rng = np.random.default_rng(n + top)
    values = np.sort(rng.integers(0, top + 1, n)) if top < 1 << 30 else np.array([top])
    raw = infilling.encode_list(values, top)
    assert infilling.EliasFano(raw).select(np.arange(n)).tolist() == values.tolist()
    if n == 1000:
        assert len(raw) * 8 < n * (2.5 + max(0, np.log2(top / n))) + 1000  # about 2 + log2(top / n) bits each
