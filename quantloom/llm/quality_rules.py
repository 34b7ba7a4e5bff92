"""Operator 6, quality rules: distribution divergence. DataFrame functions only.

Each document has two histograms: of its characters by class, and of its words by its language's common words (all
others are one bin). A language's common words and both of its references are worked out from its documents in one
aggregate: each document's words weigh as shares of it, so that a long one counts no more than others. A document is
rejected where the Jensen-Shannon distance to a reference exceeds a threshold. Documents too short for a histogram to say
much are not judged by it, and of longer ones the part of the divergence that their length alone explains is taken off.
Base rules on length and repeated three-word windows come first.

References may be those of another, cleaner set of documents: judge_quality takes them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE

#: Languages that have references of their own where the caller names no others.
LANGUAGES = ("de", "en", "es", "fr")
#: The most frequent words of a language that have a bin each; a parameter.
COMMON = 256
#: Buckets of hashed words whose sums say which words may be common.
BUCKETS = 1 << 16
#: Characters by class; what is in none of these and no white space is the last class but one, white space the last.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r".,;:!?'\"()\-")
#: Jensen-Shannon distances (square roots of divergences to base 2, 0 to 1) above which a document is rejected.
MOST_CLASS_DISTANCE = 0.28
MOST_WORD_DISTANCE = 0.36
#: Of a document of n words, so much over n is taken off the divergence of its words.
WORD_NOISE = 20.0
#: Characters and words that a document must have to be judged by the one and the other.
LEAST_CHARACTERS = 200
LEAST_WORDS = 100
#: The base rules.
BASE_WORDS = 50
BASE_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: The bits of a number in which a place within a document is held.
PLACE = (1 << 31) - 1
#: The reference for languages that aren't listed: of all documents.
ANY = "*"


@dataclass(frozen=True)
class Reference:
    """classes: mean shares of the character classes; words: mean shares of the common words."""

    classes: tuple[float, ...] = ()
    words: dict[str, float] = field(default_factory=dict)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, also where body uses it in other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def windows_of(hashes: Column) -> Column:
    """64-bit hashes of all three-word windows, from the hashes of words."""
    window = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    return let(hashes, window)


def placed_windows(windows: Column) -> Column:
    """The upper bits of each window's hash and, below these, where it starts, sorted; null where no two are the same.

    As plain numbers they sort fast, at the top of a select at least: within a lambda Spark would sort objects."""
    placed = F.transform(windows, lambda g, i: g.bitwiseAND(~PLACE).bitwiseOR(i.cast("long")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(placed))


def repeated_words(windows: Column, placed: Column) -> Column:
    """Words in three-word windows that are found twice or more, each word once, from windows_of and placed_windows, both
    columns. Windows are told apart by 64-bit hashes: neighbours with the same upper bits are looked at again."""
    like_next = lambda p, k: F.shiftright(F.get(p, k).bitwiseXOR(F.get(p, k + 1)), PLACE.bit_length()) == 0
    left = let(placed, lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 2), lambda k: like_next(p, k)))
    start_of = lambda k: F.get(placed, k).bitwiseAND(PLACE).cast("int")

    def covered(k: Column) -> Column:
        starts = F.transform(F.array_distinct(F.concat(k, F.transform(k, lambda x: x + 1))), start_of)
        alike = F.sort_array(F.transform(starts, lambda i: F.struct(F.get(windows, i).alias("g"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(s, lambda x, k: F.coalesce(x["g"] == F.get(s, k - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, k + 1)["g"], F.lit(False)))

        places = F.sort_array(F.transform(let(alike, twice), lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")), lambda a: a["n"])

    return F.when(placed.isNull(), F.lit(0).cast("long")).otherwise(let(left, covered))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _only(text: Column, kept: str) -> Column:
    """How many characters of a class there are."""
    return F.char_length(F.regexp_replace(text, f"[^{kept}]+", ""))


def rest_of(text: Column) -> Column:
    """A text without its characters of the first class, which most are of: what is left is short to go through again."""
    return F.regexp_replace(text, f"{CLASSES[0]}+", "")


def solid_of(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def class_counts(text: Column, rest: Column, solid: Column) -> Column:
    """Characters of each class in a text, others, and white space; rest: rest_of(text), solid: solid_of(rest)."""
    own = F.array((F.char_length(text) - F.char_length(rest)).cast("double"), *[_only(solid, c).cast("double") for c in CLASSES[1:]])
    white = F.char_length(rest) - F.char_length(solid)
    return let(own, lambda a: F.concat(a, F.array((F.char_length(text) - white - F.aggregate(a, F.lit(0.0), lambda x, y: x + y)).cast("double"), white.cast("double"))))


def shares(counts: Column) -> Column:
    """Counts as shares of their sum; null where there are none."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    return let(counts, lambda c: let(total(c), lambda t: F.when(t > 0, F.transform(c, lambda x: x / t))))


def _term(p: Column, q: Column) -> Column:
    """What a bin with shares p and q adds to the divergence."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2


def divergence(p: Column, q: Column) -> Column:
    """The Jensen-Shannon divergence of two arrays of shares; null if one is null."""
    return F.aggregate(F.zip_with(p, q, _term), F.lit(0.0), lambda a, b: a + b)


# ---- words and their bins: a table in which the hash of a word says at which two places it may be ---------------------


def _places(hashed: int, size: int) -> tuple[int, int]:
    return hashed & (size - 1), hashed >> 32 & (size - 1)


def bins(reference: dict[str, float], hashes: dict[str, int]) -> tuple[list[int], list[float]]:
    """Hashes of the common words, each at one of its two places, and the shares at these places."""
    size = 16
    while size < 4 * len(reference):
        size *= 2
    while True:
        table: dict[int, str] = {}
        for word in sorted(reference):
            at = _places(hashes[word], size)[0]
            for _ in range(64):  # each word that is in the way moves on to its other place
                table[at], word = word, table.get(at)
                if word is None:
                    break
                at = sum(_places(hashes[word], size)) - at
            else:
                break
        else:
            held = [table.get(i) for i in range(size)]
            return [0 if w is None else hashes[w] for w in held], [0.0 if w is None else reference[w] for w in held]
        size *= 2


def marks(reference: dict[str, float], hashes: dict[str, int]) -> list[bool]:
    """Whether a common word may have a hash with these lower bits: it is so for few other words."""
    size = 16
    while size < 16 * len(reference):
        size *= 2
    held = {hashes[w] & (size - 1) for w in reference}
    return [i in held for i in range(size)]


def marked(hashes: Column, mark: Column) -> Column:
    """The hashes that may be a common word's."""
    return let(mark, lambda m: let(F.size(m).cast("long") - 1, lambda last: F.filter(hashes, lambda h: F.get(m, h.bitwiseAND(last)))))


def word_divergence(n: Column, found: Column, own: Column, table: Column, share: Column, weighed: Column, whole: Column) -> Column:
    """The divergence of a document's n words from the shares of common words (whole: their sum), all others being one bin.

    found: the sorted hashes of its words that are marked, own: each of them once, both columns. The table tells which are
    common; weighed: shares times their logarithms to base 2. A common word of shares p and q adds
    (p log p + q log q - (p + q) log (p + q) + p + q) / 2, one that the document doesn't have half its share."""
    ends = F.filter(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))), lambda i: ~F.get(found, i).eqNullSafe(F.get(found, i + 1)))
    parts = let(ends, lambda k: F.transform(k, lambda e, i: (e - F.coalesce(F.get(k, i - 1), F.lit(-1))) / n))
    first = lambda h, last: h.bitwiseAND(last)
    other = lambda h, last: F.shiftright(h, 32).bitwiseAND(last)
    at = lambda h, last: F.when(F.get(table, first(h, last)) == h, first(h, last)).when(F.get(table, other(h, last)) == h, other(h, last))
    placed = let(F.size(table).cast("long") - 1, lambda last: F.zip_with(own, parts, lambda h, p: F.struct(p.alias("p"), at(h, last).alias("at"))))
    sums = lambda x: F.struct(x["p"].alias("p"), (x["p"] + F.get(share, x["at"])).alias("s"), F.get(weighed, x["at"]).alias("w"))

    def summed(r: Column) -> Column:
        total = F.aggregate(r, F.lit(0.0), lambda a, x: a + (x["p"] * F.log2(x["p"]) + x["w"] - x["s"] * F.log2(x["s"])))
        part = F.aggregate(r, F.lit(0.0), lambda a, x: a + x["p"])
        return (total + part + whole) / 2 + _term(F.greatest(1.0 - part, F.lit(0.0)), F.greatest(1.0 - whole, F.lit(0.0)))

    return let(F.transform(F.filter(placed, lambda x: x["at"].isNotNull()), sums), summed)


# ---- references and judgements ---------------------------------------------------------------------------------------


def _language(lang: str, present: bool, languages: Sequence[str]) -> Column:
    return F.when(F.col(lang).isin(*languages), F.col(lang)).otherwise(ANY) if present and languages else F.lit(ANY)


def _by_language(language: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(language == name, value).otherwise(out)
    return out


def language_references(df: DataFrame, *, text: str = "text", lang: str = "lang", common: int = COMMON, languages: Sequence[str] = LANGUAGES) -> dict[str, Reference]:
    """A reference for each of the languages that has documents, and one of all documents (ANY), from those of LEAST_WORDS
    words or more. At most `common` words of each, and a row of class sums, come to the driver."""
    body = F.coalesce(F.col(text), F.lit(""))
    texts = df.select(body.alias("t"), _language(lang, lang in df.columns, languages).alias("g"))
    # as many words are told from the beginning of a text, without splitting it
    long = F.col("t").rlike(f"^[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{{LEAST_WORDS - 1}}}[^{SPACE}]")
    counts = texts.where(long).select("g", "t", rest_of(F.col("t")).alias("rest")).select("g", "t", "rest", solid_of(F.col("rest")).alias("solid"))
    counts = counts.select("g", shares(class_counts(F.col("t"), F.col("rest"), F.col("solid"))).alias("c"))
    sums = {r["g"]: r for r in counts.groupBy("g").agg(F.count("c").alias("n"), *[F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 2)]).collect()}
    # the outer form of explode: for the other one Spark would split each text again, to leave out those without words
    texts, long = texts.select("g", words_of(F.col("t")).alias("w")), F.size("w") >= LEAST_WORDS
    words = texts.select("g", (1.0 / F.greatest(F.size("w"), F.lit(1))).alias("s"), F.when(long, F.col("w")).alias("w")).select("g", "s", F.explode_outer("w").alias("word")).where("word is not null")
    top = _common_words(words, common)
    out = {}
    for g in (*languages, ANY):
        own = [r for k, r in sums.items() if r["n"] and g in (k, ANY)]
        if own:
            n = sum(r["n"] for r in own)
            out[g] = Reference(tuple(sum(r[f"c{i}"] for r in own) / n for i in range(len(CLASSES) + 2)), {w: s / n for w, s in top.get(g, {}).items()})
    return out


def _common_words(words: DataFrame, common: int) -> dict[str, dict[str, float]]:
    """Of rows (g, s, word) the `common` words of each g, and of all (ANY), with the largest sums of s.

    Most words are rare, and need not be counted one by one: sums of hashed buckets come first (BUCKETS numbers of each g
    to the driver), then only words in the fullest buckets are counted. No word of another bucket can be among the common
    ones if the last of these has more than the whole of any such bucket; else more buckets are taken."""
    bucket = F.xxhash64("word").bitwiseAND(BUCKETS - 1).cast("int")
    held: defaultdict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS))
    sums = words.groupBy("g", bucket.alias("b")).agg(F.sum("s").alias("s")).toArrow()  # numbers in arrays: as rows they would take many times the memory
    names = sums["g"].combine_chunks().dictionary_encode()
    number, place, weight = np.asarray(names.indices), np.asarray(sums["b"]), np.asarray(sums["s"])
    for i, g in enumerate(names.dictionary.to_pylist()):
        for h in {g, ANY}:
            held[h] += np.bincount(place[number == i], weight[number == i], BUCKETS)
    wanted = 8 * common
    while True:
        order = {g: np.argsort(-v, kind="stable") for g, v in held.items()}
        rest = {g: float(held[g][o[wanted]]) if wanted < BUCKETS else 0.0 for g, o in order.items()}
        chosen = sorted({(g, b) for g in held for o in (order[g], order[ANY]) for b in o[:wanted].tolist()})
        if not chosen:
            return {}
        some = F.broadcast(words.sparkSession.createDataFrame(chosen, "g string, b int"))
        counted = words.withColumn("b", bucket).join(some, ["g", "b"]).groupBy("g", "word").agg(F.sum("s").alias("s"))
        both = counted.select(F.explode(F.array_distinct(F.array("g", F.lit(ANY)))).alias("g"), "word", "s").groupBy("g", "word").agg(F.sum("s").alias("s"))
        first = Window.partitionBy("g").orderBy(F.desc(F.round("s", 9)), "word")
        rows = both.withColumn("r", F.row_number().over(first)).where(F.col("r") <= common).collect()
        out: dict[str, dict[str, float]] = {}
        for r in rows:
            out.setdefault(r["g"], {})[r["word"]] = r["s"]
        if wanted >= BUCKETS or all((min(w.values()) if len(w) == common else 0.0) > rest[g] + 1e-9 or rest[g] == 0.0 for g, w in out.items()):
            return out
        wanted *= 4


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def judge_quality(df: DataFrame, references: dict[str, Reference] | None = None, *, text: str = "text", lang: str = "lang", keep: Sequence[str] = ("doc_id",), languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """keep columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, class_distance,
    word_distance (double, to six digits; null where not judged) and kept.

    A null text has no words and fails the base rules. A null or unlisted language, and one without a reference, is
    compared with that of all documents. Repeated rows are judged alike; texts of any length are taken whole. Columns not
    in keep are left out; a keep column named like a result gives way to it. Without references those of df itself are
    worked out first, for each of the languages: name those whose documents are many enough to tell of a language; all
    others are compared with the mixture of all.
    """
    references = language_references(df, text=text, lang=lang, languages=languages) if references is None else references
    kept = [c for c in keep if c not in RESULTS]
    base = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)], F.coalesce(F.col(text), F.lit("")).alias("__t"), _language(lang, lang in df.columns, languages).alias("__language"))
    own = [f"__k{i}" for i in range(len(kept))]
    base = base.select(*own, "__t", "__language", hashes_of(words_of(F.col("__t"))).alias("__h"), rest_of(F.col("__t")).alias("__rest"))
    chosen = {k: references.get(k) or references.get(ANY) or Reference() for k in (*languages, ANY)}
    language = F.col("__language")
    hashed = _hashes(df, sorted({w for r in chosen.values() for w in r.words}))
    held = {k: bins(r.words, hashed) for k, r in chosen.items()}
    # as one text that Spark folds into a constant: an expression for each number would take long to plan
    array = lambda values, kind: F.lit(None).cast(f"array<{kind}>") if not values else F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
    classes = _by_language(language, {k: array(r.classes, "double") for k, r in chosen.items()})
    table = _by_language(language, {k: array(h if chosen[k].words else None, "bigint") for k, (h, _) in held.items()})
    share = _by_language(language, {k: array(s if chosen[k].words else None, "double") for k, (_, s) in held.items()})
    weighed = _by_language(language, {k: array([q * log2(q) if q > 0 else 0.0 for q in s] if chosen[k].words else None, "double") for k, (_, s) in held.items()})
    mark = _by_language(language, {k: array([int(b) for b in marks(r.words, hashed)] if r.words else None, "boolean") for k, r in chosen.items()})
    n = F.size("__h").cast("long")
    # what Spark runs compiled at the top of a select it would run step by step within a lambda: hence columns of their own
    base = base.select(*own, "__t", "__language", "__h", "__rest", solid_of(F.col("__rest")).alias("__solid"), windows_of(F.col("__h")).alias("__windows"), F.when(n >= LEAST_WORDS, F.sort_array(marked(F.col("__h"), mark))).alias("__found"))
    base = base.select(*own, "__t", "__language", n.alias("n_words"), "__rest", "__solid", "__windows", placed_windows(F.col("__windows")).alias("__placed"), "__found", F.array_distinct("__found").alias("__own"))
    n = F.col("n_words")
    chars = F.char_length("__t") - F.char_length("__rest") + F.char_length("__solid")
    off = lambda d, less: let(d - less, lambda x: F.when(x.isNotNull(), F.round(F.sqrt(F.greatest(x, F.lit(0.0))), 6)))
    whole = _by_language(language, {k: F.lit(float(sum(r.words.values()))) for k, r in chosen.items()})
    divergent = lambda t, s, w, q: word_divergence(n.cast("double"), F.col("__found"), F.col("__own"), t, s, w, q)
    by_words = let(table, lambda t: let(share, lambda s: let(weighed, lambda w: let(whole, lambda q: F.when(t.isNotNull(), divergent(t, s, w, q))))))
    base = base.select(
        *own, n, chars.cast("long").alias("word_chars"), _only(F.col("__solid"), SYMBOLS).cast("long").alias("n_symbols"), repeated_lines(F.col("__t")).alias("n_dup_lines"), repeated_words(F.col("__windows"), F.col("__placed")).alias("n_repeat_words"),
        F.when(F.char_length("__t") >= LEAST_CHARACTERS, off(divergence(shares(class_counts(F.col("__t"), F.col("__rest"), F.col("__solid"))), classes), F.lit(0.0))).alias("class_distance"),
        F.when(n >= LEAST_WORDS, off(by_words, WORD_NOISE / n)).alias("word_distance"),
    )
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED_PERCENT * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    return base.select(*[F.col(o).alias(c) for o, c in zip(own, kept, strict=True)], *RESULTS[:5], failed.alias("base_failed"), "class_distance", "word_distance", (~failed & ~far).alias("kept"))


def _hashes(df: DataFrame, words: list[str]) -> dict[str, int]:
    """Spark's own hashes of the common words (at most COMMON of each language)."""
    if not words:
        return {}
    held = F.transform(F.split(F.lit(" ".join(words)), " "), lambda w: F.xxhash64(w))
    return dict(zip(words, df.sparkSession.range(1).select(held.alias("h")).first()["h"], strict=True))


def keep_good(df: DataFrame, references: dict[str, Reference] | None = None, *, text: str = "text", lang: str = "lang", languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """The rows of df that are kept, with all their columns as they are.

    Judged as by judge_quality: a null or empty text goes, repeated rows are judged alike whatever their ids, null ids
    make no difference, texts of any length are taken whole, and no column of df clashes with a result. An empty df
    gives no rows."""
    whole = df.select(F.struct(*df.columns).alias("__row"), F.col(text).alias("__text"), (F.col(lang) if lang in df.columns else F.lit(None).cast("string")).alias("__lang"))
    judged = judge_quality(whole, references, text="__text", lang="__lang", keep=("__row",), languages=languages)
    # a column that isn't deterministic, and is asked for (it is never null), keeps the filter above this projection; Spark
    # would otherwise put copies of all that kept is made of in its place, each of which is worked out anew
    judged = judged.withColumn("__n", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & F.col("__n").isNotNull() & (F.col("__n") >= 0)).select("__row.*")
