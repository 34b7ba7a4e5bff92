import math
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quantloom.llm import quality_classifier as qc, queries

BAD = "shout badword nasty"


@pytest.fixture(scope="module")
def rated(spark, words):
    """Rows (doc_id, text, grade parts): words at random; toxic ones hold bad words, poor ones shout."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        body = [words[k] for k in rng.integers(0, len(words), int(rng.integers(20, 200)))]
        quality, toxic = int(rng.random() > 0.3), int(rng.random() < 0.3)
        if toxic:
            for w in BAD.split():
                body.insert(int(rng.integers(0, len(body))), w)
        if not quality:
            body = [w.upper() + "!!" for w in body]
        rows.append((i, " ".join(body), quality, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def plain_features(text, bits):
    """All features of one text, one at a time."""
    raw = (text or "").encode()
    number = lambda x: int(xxhash.xxh3_64_intdigest(x))
    mixed = lambda x: int(qc.mix(np.array([x % 2**64], np.uint64))[0])
    found = [m[0].lower() for m in re.finditer(rb"[A-Za-z\x80-\xff]+", raw)]
    out = {number(w) for w in found}
    out |= {mixed(number(w[:k]) + k) for w in found for k in qc.PREFIXES if len(w) > k}
    size = max(len(raw), 1)
    sets = [rb"[A-Z]", rb"[0-9]", rb"[!?]", rb"[^A-Za-z\x80-\xff0-9\t-\r .,;:'\"\-()!?]"]
    shares = [len(re.findall(x, raw)) / size for x in sets]
    shares.append(sum(x == y for x, y in zip(found, found[1:])) / max(len(found), 1))
    lines = re.findall(rb"[^\n]+", raw)
    shares.append((len(lines) - len(set(lines))) / max(len(lines), 1))
    for i, share in enumerate(shares):
        step = min(max(24 + math.floor(4 * math.log(share)), 1), 24) if share > 0 else 0
        out.add(mixed(step + 1 + 1000 * i))
    return {x >> (64 - bits) for x in out}


def test_features_of_a_batch_are_those_of_single_texts(odd):
    texts = [*odd, "one two\none two\nONE TWO!!", "x"]
    rows, hashed = qc.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own = set(hashed[rows == i].tolist())
        alone = set(qc.features(pa.array([t], pa.string()))[1].tolist())
        assert own == alone == plain_features(t, qc.BITS)


def test_held_out_accuracy_and_order(spark, rated):
    train, held = rated.where("doc_id % 3 > 0"), rated.where("doc_id % 3 = 0")
    model = qc.fit_documents(rated, train.select("doc_id", "quality", "toxic"))
    assert (np.diff(model.thresholds) > 0).all()
    got = qc.grade_documents(held, model).toPandas().set_index("doc_id")
    want = held.toPandas().set_index("doc_id")
    want = (want.quality + 1 - want.toxic).loc[got.index]
    assert ((got.p_2 >= 0.5) == (want == 2)).mean() > 0.95
    assert (got.p_1 >= got.p_2).all() and np.allclose(got.expected_grade, got.p_1 + got.p_2)
    assert (np.abs(got.expected_grade - want) < 0.5).mean() > 0.9


def test_fit_finds_the_likelihoods_top():
    """One feature, three grades: the slope and thresholds of a plain search."""
    rng = np.random.default_rng(5)
    x = rng.random(4000) < 0.5
    u = rng.logistic(size=4000)
    grades = ((u + 2.0 * x) > -1).astype(int) + ((u + 2.0 * x) > 1)
    m = qc.fit(np.flatnonzero(x), np.full(int(x.sum()), 7), grades, 3)
    assert abs(m.weights[7] - 2.0) < 0.35 and abs(m.thresholds[0] + 1) < 0.3 and abs(m.thresholds[1] - 1) < 0.3


def test_sample_is_bounded_and_repeats_count_once(spark):
    labels = spark.range(5000).selectExpr("id doc_id", "1 quality", "0 toxic").union(spark.sql("select 3L, 0, 1 union all select null, 1, 0 union all select 4L, null, 0"))
    got = qc.rated_sample(labels, rows=500).toPandas()
    assert len(got) == 500 and got.doc.is_unique
    every = qc.rated_sample(labels, rows=10_000).toPandas().set_index("doc").grade
    assert len(every) == 5000 and every[3] == 0 and every[4] == 2


@pytest.mark.parametrize("n", [500, 501, 600, 634, 635, 636, 700])
def test_sample_of_hardly_more_rows_than_it_takes(spark, n):
    labels = spark.range(n).selectExpr("id doc_id", "1 quality", "0 toxic")
    by_hash = [r.id for r in spark.range(n).orderBy(qc.F.shiftrightunsigned(qc.F.xxhash64("id"), 1), "id").limit(500).collect()]
    assert [r.doc for r in qc.rated_sample(labels, rows=500).collect()] == by_hash


def test_odd_rows_and_tables(spark, docs, rated):
    model = qc.fit_documents(rated, rated)
    got = qc.grade_documents(docs, model)
    assert got.columns == ["doc_id", "expected_grade", "p_1", "p_2", "kept"] and got.count() == docs.count()
    assert qc.grade_documents(docs.limit(0), model).count() == 0
    kept = qc.keep_top(docs, model)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(r.doc_id for r in got.where("kept and doc_id is not null").collect())
    empty = qc.fit_documents(docs.limit(0), rated)
    assert not empty.weights.any() and qc.grade_documents(docs, empty).where("not kept").count() == 0
    assert not qc.fit_documents(rated, rated.limit(0)).weights.any()


def plain_grades(model, text):
    s = sum(float(model.weights[h]) for h in plain_features(text, qc.BITS))
    return [1 / (1 + math.exp(min(max(t - s, -500), 500))) for t in model.thresholds]


def test_query_against_plain_scores(spark, rated, docs, tmp_path):
    """Scores, tail probabilities and choices of the query, worked out document by document; a row twice, an id twice."""
    both = rated.select("doc_id", "text").union(docs.select("doc_id", "text")).union(rated.limit(3).select("doc_id", "text")).withColumn("kept", qc.F.lit(7))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    rated.select("doc_id", "quality", "toxic").withColumn("text", qc.F.lit("x")).write.parquet(f"{tmp_path}/labels.parquet")
    model = qc.fit_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    got = sorted(queries.op3_ordinal_quality(spark, str(tmp_path)).collect(), key=repr)
    want = []
    for r in both.collect():
        p = plain_grades(model, r.text)
        want.append((r.doc_id, sum(p), *p, p[-1] >= qc.LEAST))
    key = lambda x: (x[0] is None, x[0] or 0, round(x[1], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[0] == w[0] and np.allclose(g[1:4], w[1:4], atol=1e-9) and (g[4] == w[4] or abs(w[3] - qc.LEAST) < 1e-9)


def test_ties(spark):
    """A probability that equals the threshold is enough."""
    model = qc.CumulativeLink(np.zeros(1 << 8, np.float32), np.zeros(2))
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [r.kept for r in qc.grade_documents(df, model).collect()] == [True, True]
    assert qc.keep_top(df, model).count() == 2 and qc.keep_top(df, model, least=0.5 + 1e-9).count() == 0
