"""Operator 6 against a plain Python version."""

import math
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quantloom.llm import quality_rules as rules
from quantloom.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    seen, covered = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), [False] * len(w)
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered[i : i + 3] = [True] * 3
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = sum(covered)
    return len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in t), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)


def classes(t):
    import unicodedata

    w = sum(map(len, WORD.findall(t)))
    kind = lambda k: sum(unicodedata.category(c) == k for c in t)
    own = [kind("Ll"), kind("Lu"), kind("Nd"), sum(c in ".,;:!?'\"()-" for c in t)]
    return [*own, w - sum(own), len(t) - w]


def divergence(p, q):
    part = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) / 2 for x, y in zip(a, b) if x > 0)
    return max(part(p, q) + part(q, p), 0)


def plain_references(rows):
    """language -> (mean class shares, common words and their mean shares), and of all documents."""
    out = {}
    for lang in (*rules.LANGUAGES, rules.ANY):
        own = [(r.text or "") for r in rows if len(WORD.findall(r.text or "")) >= rules.LEAST_WORDS and lang in (r.lang, rules.ANY)]
        if not own:
            continue
        total = Counter()
        for t in own:
            w = WORD.findall(t)
            for x, n in Counter(w).items():
                total[x] += n / len(w)
        top = sorted(total, key=lambda x: (-round(total[x], 9), x.encode()))[: rules.COMMON]
        out[lang] = [sum(c) / len(own) for c in zip(*([x / len(t) for x in classes(t)] for t in own))], {x: total[x] / len(own) for x in top}
    return out


def plain_distances(r, refs):
    t = r.text or ""
    c, common = refs.get(r.lang) or refs[rules.ANY]
    w, by_class, by_word = WORD.findall(t), None, None
    if len(t) >= rules.LEAST_CHARACTERS:
        by_class = math.sqrt(divergence([x / len(t) for x in classes(t)], c))
    if len(w) >= rules.LEAST_WORDS:
        n = Counter(w)
        p = [n[x] / len(w) for x in common]
        by_word = math.sqrt(max(divergence([*p, max(1 - sum(p), 0)], [*common.values(), max(1 - sum(common.values()), 0)]) - rules.WORD_NOISE / len(w), 0))
    return by_class, by_word


def test_base_counts(docs):
    got = {r.doc_id: r for r in rules.judge_quality(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base(r.text), r.text
        assert not (g.base_failed and g.kept)


def test_repeats(spark):
    texts = ["a b c a b c", "a a a a a", "a b", "x\nx\n \nx \nx", "a b c d a b c d a b c", "\n\n", "a a b a a b\ta a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.judge_quality(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_distances(small):
    rows = small.collect()
    want, refs = plain_references(rows), rules.language_references(small)
    assert set(want) == set(refs)
    for lang, (c, w) in want.items():
        assert refs[lang].classes == pytest.approx(c) and set(refs[lang].words) == set(w)
        assert all(refs[lang].words[x] == pytest.approx(v) for x, v in w.items())
    plain = {lang: (list(r.classes), r.words) for lang, r in refs.items()}
    for r in rules.judge_quality(small, refs, keep=("doc_id", "text", "lang")).collect():
        for got, d in zip((r.class_distance, r.word_distance), plain_distances(r, plain), strict=True):
            assert got is None and d is None or got == pytest.approx(d, abs=1e-6)
        far = (r.class_distance or 0) > rules.MOST_CLASS_DISTANCE or (r.word_distance or 0) > rules.MOST_WORD_DISTANCE
        assert r.kept == (not r.base_failed and not far)


def test_references_of_a_clean_set(spark, small):
    """References of other documents judge these; a language without one is compared with all."""
    clean = small.where("lang = 'en'")
    refs = rules.language_references(clean)
    assert set(refs) == {"en", rules.ANY} and refs["en"].classes == pytest.approx(refs[rules.ANY].classes) and refs["en"].words == pytest.approx(refs[rules.ANY].words)
    got = {r.doc_id: r for r in rules.judge_quality(small, refs, keep=("doc_id", "lang")).collect()}
    far = [r.word_distance for r in got.values() if r.lang == "de" and r.word_distance is not None]
    near = [r.word_distance for r in got.values() if r.lang == "en" and r.word_distance is not None]
    assert far and near and statistics.median(far) > rules.MOST_WORD_DISTANCE > statistics.median(near)
    none = rules.judge_quality(small, {}).collect()
    assert all(r.class_distance is None and r.word_distance is None and r.kept == (not r.base_failed) for r in none)


def test_bins_hold_every_word():
    for n in (0, 1, 5, 256, 900):
        share = {f"w{i}": 1 / (i + 2) for i in range(n)}
        hashes = {w: hash((w, 1)) | 1 for w in share}
        table, held = rules.bins(share, hashes)
        at = {h: i for i, h in enumerate(table) if h}
        assert len(table) & (len(table) - 1) == 0 and len(at) == n
        assert all(at[hashes[w]] in rules._places(hashes[w], len(table)) and held[at[hashes[w]]] == x for w, x in share.items())


def test_labelled_good_documents_stay(spark):
    path = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = [r for r in queries.op6_divergence(spark, path).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in got if labels[r.doc_id] == 1)
    bad = [r.kept for r in got if labels[r.doc_id] == 0]
    assert sum(bad) < 0.4 * len(bad)


def test_nulls_clashes_and_empty(spark, docs):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "word " * 80, "xx", "y"), (2, "word " * 80, None, "y")], "doc_id long, text string, lang string, kept string")
    got = rules.judge_quality(df, keep=("doc_id", "kept")).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, False), (2, False), (2, False)]
    assert rules.judge_quality(df.limit(0)).collect() == []
    assert rules.keep_good(docs).columns == docs.columns
    want = {r.doc_id for r in rules.judge_quality(docs).collect() if r.kept}
    assert {r.doc_id for r in rules.keep_good(docs).collect()} == want and want


def test_no_python_in_the_plan(small):
    import contextlib
    import io

    with contextlib.redirect_stdout(out := io.StringIO()):
        rules.judge_quality(small).explain("extended")
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()


def test_windows_alike_in_upper_bits(spark):
    """Windows whose places sort beside each other are told apart by all their bits; the same ones are found among them."""
    cases = [([5, 6, 7], 0), ([5, 6, 5], 5), ([1 << 40, 1 << 40 | 3, -9, 1 << 40], 6), ([-1, -2, -1, -2, -3], 6), ([], 0), ([8], 0), ([-(1 << 63), (1 << 63) - 1, -(1 << 63), 4, 4], 7)]
    df = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(cases)], "i int, w array<bigint>, n long")
    df = df.select("i", "n", "w").withColumn("p", rules.placed_windows(df["w"])).withColumn("got", rules.repeated_words(F.col("w"), F.col("p")))
    for r in df.collect():
        starts = {i for i, g in enumerate(r.w) if r.w.count(g) > 1}
        assert r.got == r.n == len({i + k for i in starts for k in range(3)})


def test_references_from_a_hundred_words_on(spark):
    """99 words are too few, whatever white space is around them; 100 are enough."""
    few, enough = "ab " * 99, "\n cd, " * 99 + "\x0befg"
    for texts in ([few, "  " + few, "\t" + few + "\n", "ab\xa0cd " * 99, None, ""], [few, enough, " " + enough + " ", enough + enough]):
        df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
        want, got = plain_references(df.collect()), rules.language_references(df)
        assert set(want) == set(got) and bool(got) == (enough in texts)
        for lang, (c, w) in want.items():
            assert got[lang].classes == pytest.approx(c) and got[lang].words == pytest.approx(w)


def test_whole_texts_are_gone_through_once(small):
    """Characters are removed from whole texts once; all other counts are of the short rest. Numbers are sorted at the top
    of a select, where Spark sorts them as numbers, and hashed once a word."""
    import contextlib
    import io

    with contextlib.redirect_stdout(out := io.StringIO()):
        rules.judge_quality(small).explain()
    initial = out.getvalue().split("Initial Plan")[-1]
    assert initial.count("regexp_replace(__t") == 1 and initial.count("regexp_replace(__rest") == 1
    assert "sort_array(transform(__windows" in initial and initial.count("lambdafunction(xxhash64(lambda x") <= 2


def test_sums_of_buckets_come_as_arrays(spark):
    """The driver holds the buckets' sums as numbers in arrays, not as rows."""
    import tracemalloc

    words = spark.range(120_000).selectExpr("if(id % 2 = 0, 'de', 'en') g", "if(id < 20, 100.0D * (id + 1), 1.0D) s", "concat('w', id % 90001) word")
    rules._common_words(words.limit(10), 4)
    tracemalloc.start()
    try:
        got, most = rules._common_words(words, 4), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    sums = Counter()
    for i in range(120_000):
        for g in ("en" if i % 2 else "de", rules.ANY):
            sums[g, f"w{i % 90001}"] += 100.0 * (i + 1) if i < 20 else 1.0
    for g in ("de", "en", rules.ANY):
        want = sorted((-v, w) for (h, w), v in sums.items() if h == g)[:4]
        assert sorted((-v, w) for w, v in got[g].items()) == want
    assert most < 8e6
