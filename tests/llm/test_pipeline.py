import collections
import random

import pytest

import corpus_pipeline
from quantloom.llm import quality_classifier, quality_rules


@pytest.fixture(scope="module")
def corpus(spark, words, tmp_path_factory):
    rng = random.Random(23)
    # as in languages, some words are frequent and most are not: the quality rules judge just that
    often = [1 / (k + 1) for k in range(len(words))]
    draw = lambda n: rng.choices(words, often, k=n)
    shared, near = draw(70), draw(150)
    texts = [None, "", "too short"]
    texts += [" ".join(near)] * 2 + [" ".join(near[:149] + ["other"])]
    texts += [" ".join(draw(60) + shared + draw(40)) for _ in range(3)]
    texts += [" ".join(draw(rng.randint(60, 200))) for _ in range(40)]
    texts += ["badword " + " ".join(draw(80)) + " nasty badword" for _ in range(20)]
    d = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("badword" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def plain_near(texts):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    best = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = best[i], best[j]
                best = {k: min(a, b) if v in (a, b) else v for k, v in best.items()}
    return {i: t for i, t in texts.items() if best[i] == i}


def plain_cut(texts):
    where = collections.defaultdict(lambda: 1 << 60)
    split = {i: t.split() for i, t in texts.items()}
    for i, w in split.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])] = min(i, where[tuple(w[k : k + 50])])
    out = {}
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - 49) if where[tuple(w[k : k + 50])] < i for j in range(50)}
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages_against_plain_versions(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names, functions = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality_rules", "quality_classifier", "near_dedup", "substring_dedup", "packing")
    one = functions[0](spark, docs, corpus)
    judged = {r.doc_id: r.kept for r in quality_rules.judge_quality(docs).collect()}
    assert one.schema == docs.schema and {r.doc_id for r in one.collect()} == {i for i, k in judged.items() if k}
    two = functions[1](spark, one, corpus)
    kept = {r.doc_id: r.text for r in two.collect()}
    model = quality_classifier.fit_documents(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    assert set(kept) == {r.doc_id for r in quality_classifier.grade_documents(one, model).where("kept").collect()}
    assert not any("badword" in t for t in kept.values()) and len(kept) > 40
    three = functions[2](spark, two, corpus)
    left = {r.doc_id: r.text for r in three.collect()}
    assert three.schema == docs.schema and left == plain_near(kept)
    four = functions[3](spark, three, corpus)
    assert [f.name for f in four.schema] == [f.name for f in docs.schema]
    cut = {r.doc_id: r for r in four.collect()}
    assert {i: r.text.split() for i, r in cut.items()} == plain_cut(left)
    assert all(r.n_chars == len(r.text) for r in cut.values())
    pieces = corpus_pipeline.run(spark, corpus).collect()
    assert {p.doc_id for p in pieces} == set(cut)
    again = functions[4](spark, four, corpus).collect()
    assert sorted(map(tuple, ((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces))) == sorted(map(tuple, ((p.doc_id, p.start, p.length, p.ids_crc32) for p in again)))


def test_empty_documents(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids_and_clashing_columns(spark, corpus, tmp_path):
    """Every row is judged by its own text; further columns go through all stages but the last as they are."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    good = [r for r in docs.collect() if len(r.text or "") > 700 and "badword" not in r.text]
    rows = [(*r, "k", 1, "v") for r in docs.collect()]
    rows += [(None, good[0].text, "en", "s", 1, "k", 2, "v"), (None, good[1].text, None, None, None, None, None, None), (good[2].doc_id, good[3].text + " tail", "en", "s", 1, "k", 3, "v"), (*good[4], "k", 4, "v"), (*good[4], "k", 5, "v")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, component_id string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    all_docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = all_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, str(tmp_path))
        assert now.columns == all_docs.columns
        ids = lambda df: collections.Counter((r.doc_id, r.n_words, r.kept) for r in df.collect())
        assert not ids(now) - ids(before)
    left = now.collect()
    assert {4, 5} <= {r.n_words for r in left} and sum(r.doc_id is None for r in left) == 2
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in left}
