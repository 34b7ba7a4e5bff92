"""Operator 7, packing: order-preserving windows by dynamic programming.

Documents, in ascending order, form one stream of token ids in each range of document ids. Windows of at most `size`
ids are cut from the stream so that padding plus penalties for cutting a document are least: no penalty at a document's
end, a small one at a sentence's end, a large one within a sentence. With places p and costs c, the best total up to
place j is  min over i, p[j] - p[i] <= size, of  best[i] + size - (p[j] - p[i]) + c[j];  best[i] + p[i] of the places in
reach stand in a monotone queue, so each place enters and leaves once.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ship, slices
from .tokens import library_encoder

SIZE = 2048
END_ID = 1
SENTENCE_PENALTY = 8
WITHIN_PENALTY = 256
#: In a sentence, places this far apart may be cut as well, so that one longer than a window has cuts.
WITHIN_STEP = 64
#: Ids over which one run of the recurrence goes; the last windows of a run are left to the next.
RUN = 1 << 19
SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def best_cuts(places: np.ndarray, costs: np.ndarray, size: int) -> list[int]:
    """Numbers of the places at which the cheapest windows end, the last place among them. places ascend from above 0,
    no two neighbours further apart than size."""
    p, c = [0, *places.tolist()], [0, *costs.tolist()]
    best, back = [0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    key = [0] * len(p)
    for j in range(1, len(p)):
        at = p[j]
        while at - p[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        total = best[j] = key[i] + size - at + c[j]
        total += at
        key[j] = total
        while queue and key[queue[-1]] >= total:
            queue.pop()
        queue.append(j)
    out, j = [], len(p) - 1
    while j:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


def places_of(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows may end, and their costs. ends: where documents end."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    stops = np.flatnonzero(sentence_end[ids]) + 1
    cost[stops] = SENTENCE_PENALTY
    cost[ends] = 0
    known = np.concatenate(([0], np.flatnonzero(cost >= 0)))
    gaps = np.diff(known)
    step = min(WITHIN_STEP, size)
    for k in np.flatnonzero(gaps > step):
        within = np.arange(known[k] + step, known[k + 1], step)
        cost[within] = WITHIN_PENALTY
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


class Packer:
    """Takes documents in order, gives pieces (document number, start, length, crc, window number, offset)."""

    def __init__(self, sentence_end: np.ndarray, size: int = SIZE):
        self.sentence_end, self.size = sentence_end, size
        self.docs: list[tuple[object, int, np.ndarray]] = []  # name, ids of it that went before, the rest
        self.held, self.window = 0, 0

    def add(self, name, ids: np.ndarray):
        self.docs.append((name, 0, ids))
        self.held += len(ids)
        if self.held >= RUN:
            yield from self._cut(False)

    def finish(self):
        if self.held:
            yield from self._cut(True)

    def _cut(self, last: bool):
        ids = np.concatenate([d for _, _, d in self.docs])
        bounds = np.zeros(len(self.docs) + 1, np.int64)
        np.cumsum([len(d) for _, _, d in self.docs], out=bounds[1:])
        places, costs = places_of(ids, bounds[1:], self.sentence_end, self.size)
        cuts = places[best_cuts(places, costs, self.size)]
        if not last:
            cuts = cuts[cuts <= len(ids) - 4 * self.size]  # near the end the best depends on what follows
        if not len(cuts):
            return
        done = int(cuts[-1])
        edges = np.union1d(bounds[bounds < done], np.concatenate(([0], cuts)))
        doc = np.searchsorted(bounds, edges[:-1], side="right") - 1
        window = np.searchsorted(cuts, edges[:-1], side="right")
        starts = np.concatenate(([0], cuts))[window]
        raw = ids.astype("<u4")
        total = [before + len(d) for _, before, d in self.docs]
        for a, z, d, w, s in zip(edges[:-1].tolist(), edges[1:].tolist(), doc.tolist(), window.tolist(), starts.tolist(), strict=True):
            name, before, _ = self.docs[d]
            yield name, before + a - int(bounds[d]), z - a, zlib.crc32(raw[a:z]), total[d], self.window + w, a - s
        self.window += len(cuts)
        k = int(np.searchsorted(bounds, done, side="right")) - 1
        rest = self.docs[k:]
        if rest:
            name, before, d = rest[0]
            cut = done - int(bounds[k])
            rest[0] = (name, before + cut, d[cut:])
        self.docs, self.held = rest, len(ids) - done


@lru_cache(maxsize=4)
def sentence_ends(vocabulary: str) -> np.ndarray:
    """For each id, whether it ends a sentence: signs only, the last of which is a stop, a question or exclamation mark. Worked
    out once in a Python worker, not for each task."""
    import regex

    library = library_encoder(vocabulary).library
    out = np.zeros(max(65_536, library.get_vocab_size(with_added_tokens=True) + 1), bool)
    shape = regex.compile(r"[^\p{L}\p{N}]*[.!?]+(</w>)?")
    for s, i in library.get_vocab(with_added_tokens=False).items():
        out[i] = bool(shape.fullmatch(s))
    out.flags.writeable = False
    return out


def pack_documents(df: DataFrame, vocabulary: str, *, doc: str = "doc_id", text: str = "text", end_id: int = END_ID, size: int = SIZE, parts: int | None = None) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty: its one id is the end id. Rows of equal or null document ids are documents of their own (null
    first, equal ones by text). Sequences keep the order of documents within a range of ids, and their numbers rise with
    it; the last sequence of each range may be short. Cuts are the best of each run of RUN ids (hundreds of sequences), whose
    last few are cut anew with the next run: nearly, but not always, the best of a range as a whole. An empty df gives no
    rows; other columns have no part in it.
    """
    import pyarrow as pa

    spark = df.sparkSession
    ship(spark)
    base = df.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = base.repartitionByRange(n, "doc").sortWithinPartitions("doc", "text")

    def run(batches):
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), library_encoder(vocabulary)
        packer = Packer(sentence_ends(vocabulary), size)

        def rows(pieces: Sequence[tuple]):
            columns = list(zip(*pieces, strict=True)) or [()] * 7
            columns[5] = [(part << 32) + w for w in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], SCHEMA.names)

        for big in batches:
            for batch in slices(big):
                pieces = []
                for name, ids in zip(batch.column("doc").to_pylist(), own.ended(batch.column("text"), end_id), strict=True):
                    pieces.extend(packer.add(name, ids))
                if pieces:
                    yield rows([(p[0], p[1], p[2], p[3], p[4], p[5], p[6]) for p in pieces])
        if pieces := list(packer.finish()):
            yield rows(pieces)

    return ranged.mapInArrow(run, SCHEMA)
