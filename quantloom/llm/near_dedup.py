"""Operator 10, MinHash near-dedup: bottom-k sketches from one hash function.

1. One hash of each distinct shingle gives a document's set; its k smallest values are the sketch (the whole set, where
   it is no larger). Documents of equal sets are one class, stood for by its smallest id.
2. Inverted lists of the retained values. A pair as similar as asked for shares at least half of its sketches' values
   (4.6 standard deviations below what is expected at the threshold), so a class enters only the lists of its rarest
   values, so many that two such classes must meet in one; values in one sketch alone, and values that very many share,
   lead nowhere.
3. In each list, every class is paired with the list's most typical one. After these links are known, only classes of
   a list that are in different components are left to be compared: short lists within, members of longer ones where
   prefixes of their full sets, rarest shingles first, say that they may be similar enough. n copies cost n pairs.
4. The union sketch (the k smallest values of both) estimates the similarity; pairs far below the threshold go.
5. The full sets of the rest, of 128-bit values, are intersected: links are exact.

Null ids take no part: such rows come back with no component and are kept. Empty texts have an empty set and no links.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Scratch, Words, grams, mix, ship, slices
from .graph import components

SHINGLE = 5
PERCENT = 75
#: Values in a sketch.
K = 64
#: Of estimates and of shared values: the least share with which a pair goes on to be verified.
LEAST = 0.5
#: Lists of at most so many classes are compared within; members of longer ones meet by prefixes of their full sets.
SHORT = 16


def shingle_sets(column, size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text, as 128-bit values in two halves, in order of the first: A-Z lowered; fewer words
    than size are one shingle. Halves come from the two halves of the words' digests, so neither tells of the other."""
    w = Words(column, lower=True)
    halves = w.digests()
    wide = [grams(h, size) for h in halves]
    out = []
    for a, z in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        n = z - a
        if n >= size:
            x, y = (g[a : z - size + 1] for g in wide)
            order = np.argsort(x)
            x, y = x[order], y[order]
            same = x[1:] == x[:-1]
            if same.any():
                if (same & (y[1:] != y[:-1])).any():  # first halves that are equal by chance
                    order = np.lexsort((y, x))
                    x, y = x[order], y[order]
                keep = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                x, y = x[keep], y[keep]
            out.append((x, y))
        elif n:
            out.append(tuple(mix(grams(h[a:z], n) + np.uint64(n)) for h in halves))
        else:
            out.append((np.empty(0, np.uint64), np.empty(0, np.uint64)))
    return out


def _as_lists(parts: list[np.ndarray]):
    import pyarrow as pa

    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)))


def signatures(df: DataFrame, doc: str, text: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """doc, n (size of the set), d1 and d2 (digest of the set), sketch (its k smallest values, ascending)."""
    import pyarrow as pa

    ship(df.sparkSession)

    def run(batches):
        for big in batches:
            for batch in slices(big):
                sets = shingle_sets(batch.column("text"), size)
                digest = [xxhash.xxh3_128_digest(x.tobytes() + y.tobytes()) for x, y in sets]
                both = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2) if digest else np.empty((0, 2), "<i8")
                sketch = _as_lists([x[:k] >> np.uint64(1) for x, _ in sets])
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([len(x) for x, _ in sets], pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), sketch], ["doc", "n", "d1", "d2", "sketch"])

    return df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, "doc long, n long, d1 long, d2 long, sketch array<long>")


def full_sets(df: DataFrame, size: int = SHINGLE) -> DataFrame:
    """node and its whole set, of rows (node, text): shingles (first halves), and whole (both halves, as bytes)."""
    import pyarrow as pa

    def run(batches):
        for big in batches:
            for batch in slices(big):
                sets = shingle_sets(batch.column("text"), size)
                yield pa.RecordBatch.from_arrays([batch.column("node"), _as_lists([x for x, _ in sets]), pa.array([x.tobytes() + y.tobytes() for x, y in sets], pa.binary())], ["node", "shingles", "whole"])

    return df.mapInArrow(run, "node long, shingles array<long>, whole binary")


def _confirmed(both: DataFrame, percent: int) -> DataFrame:
    """Of rows (a, b, xa, xb) the pairs whose whole sets are as similar as asked for."""
    import pyarrow as pa

    def run(batches):
        for big in batches:
            for batch in slices(big, "xa", "xb", most=4 << 20):
                keep = []
                for p, q in zip(batch.column("xa"), batch.column("xb"), strict=True):
                    p, q = np.frombuffer(p.as_buffer(), np.uint64).reshape(2, -1), np.frombuffer(q.as_buffer(), np.uint64).reshape(2, -1)
                    at = np.minimum(np.searchsorted(q[0], p[0]), q.shape[1] - 1)
                    common = int(np.count_nonzero((q[0][at] == p[0]) & (q[1][at] == p[1])))
                    keep.append(common * 100 >= (p.shape[1] + q.shape[1] - common) * percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def estimate(a, b, k: int = K):
    """The union sketch's estimate of the similarity of two sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _lists(nodes: DataFrame) -> DataFrame:
    """value, node, score: the inverted lists that nodes (node, sketch) enter; score is how typical a node is."""
    retained = nodes.select("node", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    often = retained.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    shared = retained.join(often, "value")
    per_node = "(partition by node order by often, value)"
    ranked = shared.selectExpr("node", "value", "m", f"row_number() over {per_node} rank", "count(*) over (partition by node) known", "sum(often) over (partition by node) score")
    # of m values, m - ceil(m * LEAST) + 1 must do; those of one sketch alone come first in the order
    return ranked.where(F.col("rank") <= F.col("m") - F.ceil(F.col("m") * LEAST) + 1 - (F.col("m") - F.col("known"))).select("value", "node", "score")


def _by_prefix(members: DataFrame, sources: DataFrame, scratch: Scratch, percent: int, size: int) -> DataFrame:
    """Pairs (a, b) of members (node, label) with different labels that may be as similar as asked for, by their full sets.

    Shingles in ascending order of how many members have them: two sets can only be that similar if they meet among the
    first n - ceil(n * percent / 100) + 1, at places behind which enough is left of both. What few members have comes
    first, so one that differs from all others in more than that meets nobody.
    """
    sets = full_sets(sources.join(members, "node", "left_semi"), size).join(members, "node").select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("e"))
    sets = scratch.written(sets, "members")
    often = sets.groupBy("e").agg(F.count("*").alias("often")).where("often > 1")
    ranked = sets.join(often, "e").selectExpr("node", "label", "n", "e", "row_number() over (partition by node order by often, e) r", "count(*) over (partition by node) known")
    ranked = ranked.selectExpr("node", "label", "n", "e", "n - known + r place").where(f"place <= n - ceil(n * {percent} / 100) + 1")
    enough = f"(1 + least(p.n - p.place, q.n - q.place)) * {100 + percent} >= {percent} * (p.n + q.n)"
    meet = ranked.alias("p").join(ranked.alias("q"), F.expr(f"p.e = q.e and p.label < q.label and least(p.n, q.n) * 100 >= greatest(p.n, q.n) * {percent} and {enough}"))
    return meet.select(F.expr("greatest(p.node, q.node)").alias("a"), F.expr("least(p.node, q.node)").alias("b")).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, sources: DataFrame, scratch: Scratch, percent: int, k: int, size: int) -> DataFrame:
    """Of pairs (a, b) those as similar as asked for, after the estimate by sets."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    near = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).where(estimate(F.col("sa"), F.col("sb"), k) >= LEAST).select("a", "b")
    near = scratch.written(near, "pairs")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = scratch.written(full_sets(sources.join(wanted, "node", "left_semi"), size).select("node", "whole"), "sets")
    both = near.join(sets.select(F.col("node").alias("a"), F.col("whole").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("whole").alias("xb")), "b")
    return _confirmed(both.select("a", "b", "xa", "xb"), percent)


def _judged(df: DataFrame, doc: str, text: str, percent: int, k: int, size: int) -> DataFrame:
    """doc, n, d1, d2 (the digest of the set) and component of each row."""
    scratch = Scratch(df.sparkSession)
    own = scratch.written(signatures(df, doc, text, k, size), "signatures")
    known = own.where("doc is not null and n > 0")
    classes = known.groupBy("d1", "d2").agg(F.min("doc").alias("node"))
    chosen = scratch.written(known.join(classes, ["d1", "d2"]).where("doc = node").select("node", "n", "sketch"), "classes")
    lists = scratch.written(_lists(chosen), "lists")
    sources = df.select(F.col(doc).cast("long").alias("node"), F.col(text).alias("text"))
    typical = lists.groupBy("value").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("t"), F.count("*").alias("c")).where("c > 1").select("value", (-F.col("t.minus")).alias("hub"))
    first = lists.join(typical, "value").where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    first = scratch.written(first, "first")
    links = scratch.written(_verified(first, chosen, sources, scratch, percent, k, size), "links")
    scratch.drop("pairs", "sets")
    labels = scratch.written(components(links), "labels")
    # what is left: classes of one list in different components, that haven't been compared
    named = lists.join(labels, "node", "left").select("value", "node", F.coalesce("label", "node").alias("label"))
    open_lists = named.groupBy("value").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c")).where("x < y").select("value", (F.col("c") > SHORT).alias("long"))
    named = scratch.written(named.join(open_lists, "value"), "open")
    short = named.where("not long")
    rest = short.alias("p").join(short.alias("q"), F.expr("p.value = q.value and p.label < q.label")).select(F.expr("greatest(p.node, q.node)").alias("a"), F.expr("least(p.node, q.node)").alias("b"))
    rest = rest.union(_by_prefix(named.where("long").select("node", "label").distinct(), sources, scratch, percent, size)).distinct()
    more = _verified(rest.join(first, ["a", "b"], "left_anti"), chosen, sources, scratch, percent, k, size)
    labels = scratch.written(components(labels.toDF("a", "b").union(more)), "components")
    scratch.drop("classes", "lists", "first", "links", "labels", "open", "members", "pairs", "sets")
    found = classes.join(labels, "node", "left").select("d1", "d2", F.coalesce("label", "node").alias("component"))
    out = own.select("doc", "n", "d1", "d2").join(found, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.select("doc", "n", "d1", "d2", F.when(F.col("doc").isNotNull(), component).alias("component"))


def near_duplicates(df: DataFrame, *, doc: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = K, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included), kept (whether that is its own).

    One row for each row of df; other columns have no part. Rows with equal ids are judged each by its text; ids are
    taken to be unique. An empty df gives no rows.
    """
    out = _judged(df, doc, text, percent, k, size)
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, *, doc: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = K, size: int = SHINGLE) -> DataFrame:
    """df without the rows that a smaller id stands for; all its columns stay as they are.

    Rows go by their id and the digest of their set, so that of rows with one id and different texts each is judged by its
    own. Rows of null ids, null texts and texts without words stay; so do repeated rows of a document that stays. Texts of
    any length are taken whole; an empty df gives no rows.
    """
    import pyarrow as pa

    gone = _judged(df, doc, text, percent, k, size).where("component <> doc").select(F.col("doc").alias("__doc"), F.col("d1").alias("__d1"), F.col("d2").alias("__d2")).distinct()
    digests = T.StructType([*df.schema, T.StructField("__d1", T.LongType()), T.StructField("__d2", T.LongType())])

    def run(batches):
        for big in batches:
            for batch in slices(big, text):
                digest = [xxhash.xxh3_128_digest(x.tobytes() + y.tobytes()) for x, y in shingle_sets(batch.column(text), size)]
                both = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], digests.names)

    named = df.mapInArrow(run, digests)
    same = (named[doc].cast(T.LongType()) == gone["__doc"]) & (named["__d1"] == gone["__d1"]) & (named["__d2"] == gone["__d2"])
    return named.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
