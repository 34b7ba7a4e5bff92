"""Operator 11, centroid clustering: k-means over integer vectors with block-norm screening.

Each vector is cut into blocks; the norms of its blocks are its compressed form, worked out once and stored with it. By the
Cauchy-Schwarz inequality the squared distance to a centroid is at least the sum, over blocks, of the squared difference
of the two norms. The centroid with the least bound is measured exactly first; of the others only those whose bound is not
above the best distance so far get an exact distance, in integers. Screening never changes a result.

Every round reads the stored vectors once and sends back one row of integer sums for each centroid and task.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Scratch, ship

DIMENSIONS, BLOCK, SCALE, CLUSTERS, ROUNDS = 64, 8, 1024, 8, 10
#: Scaled components are held within this, so that every squared distance of 64 of them fits into a long.
LARGEST = 1 << 27
#: Up to this, products and sums of 64 components are exact in doubles as well.
EXACT = 1 << 20


def block_norms(x: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The norm of each block of consecutive components."""
    return np.sqrt((x.astype(float) ** 2).reshape(len(x), -1, block).sum(axis=2))


def lower_bounds(norms: np.ndarray, centre_norms: np.ndarray) -> np.ndarray:
    """Below the squared distance of each vector to each centroid, rounding included."""
    bound = np.zeros((len(norms), len(centre_norms)))
    for s in range(norms.shape[1]):
        bound += (norms[:, s, None] - centre_norms[None, :, s]) ** 2
    size = (norms**2).sum(axis=1)[:, None] + (centre_norms**2).sum(axis=1)[None, :]
    return bound - 1e-9 * size - 0.5


def nearest(x: np.ndarray, norms: np.ndarray, centres: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row the number of the nearest centroid (of equal ones the smallest), its squared distance, and in all how many
    exact distances were needed."""
    small = max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) <= EXACT
    x = x.astype(float if small else np.int64)
    c = centres.astype(x.dtype)
    bound = lower_bounds(norms, block_norms(centres, block))
    rows = np.arange(len(x))
    first = bound.argmin(axis=1)
    gap = x - c[first]
    best, label, needed = np.einsum("ij,ij->i", gap, gap), first.copy(), len(x)
    for k in range(len(centres)):
        left = rows[(bound[:, k] <= best) & (first != k)]
        if not len(left):
            continue
        gap = x[left] - c[k]
        d = np.einsum("ij,ij->i", gap, gap)
        needed += len(left)
        better = (d < best[left]) | ((d == best[left]) & (k < label[left]))
        label[left[better]], best[left[better]] = k, d[better]
    return label, best.astype(np.int64), needed


def compressed(df: DataFrame, id_column: str, vector: str, dimensions: int, scale: int, block: int) -> DataFrame:
    """id, components (scaled to integers, as bytes) and norms (of blocks, as bytes) of the vectors that have just so many
    components, all of them finite numbers."""
    import pyarrow as pa

    v = F.col(vector)
    whole = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    held = df.where(v.isNotNull() & whole).select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype("<i4")
            norms = block_norms(x, block)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, norms))], ["id", "components", "norms"])

    return held.mapInArrow(run, "id long, components binary, norms binary")


def _arrays(batch, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    joined = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1)
    return joined("components", "<i4"), joined("norms", "<f8")


def first_centres(vectors: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors of the smallest sha256 of `seed:id`; null ids come last, equal ones by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(order.alias("order"), "components").orderBy(F.col("order").asc_nulls_last(), "components").limit(clusters).collect()
    return np.array([np.frombuffer(bytes(r["components"]), "<i4") for r in rows], np.int64)


def _moved(vectors: DataFrame, centres: np.ndarray, block: int) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; a centroid without any stays. Sums of a task are added up in
    decimals, whatever the number of vectors."""
    import pyarrow as pa

    k, dimensions = centres.shape

    def run(batches):
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, norms = _arrays(batch, dimensions)
                label = nearest(x, norms, centres, block)[0]
                for c in np.unique(label):
                    mine = x[label == c]
                    sums[c] += mine.sum(axis=0, dtype=np.int64)
                    counts[c] += len(mine)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.mapInArrow(run, "cluster long, n long, sums array<long>").where("n > 0")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s"))
    rows = each.groupBy("cluster", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()  # k x dimensions
    out = centres.copy()
    for r in rows:
        out[r["cluster"], r["d"]] = int(r["s"]) // r["n"]
    return out


def cluster_vectors(df: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, block: int = BLOCK, seed: str = "3") -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance (squared), centroid (its final components) and exact, the
    number of exact distances for the vectors of its batch, over their number: what screening leaves to do.

    Kept are vectors of just `dimensions` components, none of them null or not finite, each turned into floor(scale * x);
    values beyond 2 ** 27 are held at that. Rows with null or repeated ids are vectors of their own; fewer vectors than
    clusters make fewer clusters; no vectors, no rows. Other columns of df have no part in it.
    """
    import pyarrow as pa

    if dimensions % block:
        raise ValueError("block must divide the number of components")
    ship(df.sparkSession)
    vectors = Scratch(df.sparkSession).written(compressed(df, id_column, vector, dimensions, scale, block), "vectors")
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("exact", T.DoubleType())])
    centres = first_centres(vectors, clusters, seed)
    if not len(centres):
        return df.sparkSession.createDataFrame([], T.StructType([*schema, T.StructField("centroid", T.ArrayType(T.LongType()))]))
    for _ in range(rounds):
        moved = _moved(vectors, centres, block)
        if (moved == centres).all():
            break  # every later round would be the same
        centres = moved

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                label, distance, needed = nearest(*_arrays(batch, dimensions), centres, block)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(label.astype(np.int32)), pa.array(distance), pa.array(np.full(len(label), needed / len(label)))], schema.names)

    final = F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in c]) for c in centres])
    return vectors.mapInArrow(run, schema).withColumn("centroid", F.get(final, F.col("cluster")))


def with_inertia(assigned: DataFrame) -> DataFrame:
    """assigned (a result of cluster_vectors) with cluster_inertia and inertia, the distances summed up over each cluster and
    over all. One row for each cluster comes to the driver; a sum beyond a long is null."""
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    number = lambda v: F.lit(v if v < 1 << 63 else None).cast("long")
    own = F.create_map(*[x for c, s in sums.items() for x in (F.lit(c), number(s))]) if sums else F.create_map().cast("map<int,bigint>")
    return assigned.withColumns({"cluster_inertia": own[F.col("cluster")], "inertia": number(sum(sums.values()))})


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()
