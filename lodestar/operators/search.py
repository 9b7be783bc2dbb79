"""Exact top-K search: filter, then score, then keep the best.

A search is a lazy DataFrame: Filter below Project below TakeOrderedAndProject, so only k
rows of each partition move. Vectors and metadata of the hits are carried by column
pruning alone; nothing is cached or collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.checks import check_top_k, check_vector
from ..functions.vector import l2_norm, norm_of, score
from ..plans.filters import Filter

DEFAULT_TOP_K = 10

#: Probes and records scored at once by top_k_each.
TILE = (256, 2048)
#: Numbers that a task holds for a block of probes: their components, and the scores kept. A block has LEAST_PROBES in any case.
HELD, LEAST_PROBES = 1 << 21, 100


def variant(records: DataFrame) -> Column:
    """The stored VARIANT of the metadata, or the parsed text."""
    if "v" in records.columns:
        return F.col("v")
    records.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.try_parse_json("metadata")


def apply_filter(records: DataFrame, where: Filter | Column | str | None) -> DataFrame:
    if where is None:
        return records
    if isinstance(where, str):
        where = Filter.parse(where)
    if isinstance(where, Filter):
        where = where.column(variant(records), F.col("metadata"))
    return records.where(where)


def score_all(records: DataFrame, probe: Sequence[float]) -> DataFrame:
    """records with a 32-bit score; a stored norm is used where there is one."""
    norm = F.col("norm") if "norm" in records.columns else l2_norm(F.col("vector"))
    return records.select("id", score(probe, F.col("vector"), norm).alias("score"), "vector", "metadata")


def top_k(records: DataFrame, probe: Sequence[float], k: int = DEFAULT_TOP_K, where: Filter | Column | str | None = None) -> DataFrame:
    """id, score, vector, metadata of the k best: score descending, then id ascending."""
    return score_all(apply_filter(records, where), probe).orderBy(F.desc("score"), "id").limit(check_top_k(k))


def top_k_batched(records: DataFrame, probe: Sequence[float], k: int = DEFAULT_TOP_K, where: Filter | Column | str | None = None) -> DataFrame:
    """id, score of the k best by matrix products over Arrow batches; near-ties may order differently from top_k."""
    k = check_top_k(k)
    q, qn = np.asarray(probe, np.float64), float(norm_of(probe))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, np.int64), np.zeros(0, np.float32))
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            denom = np.sqrt((v * v).sum(axis=1)) * qn
            with np.errstate(all="ignore"):
                s = np.where(denom == 0, 0, v @ q / denom).astype(np.float32)
            ids, s = np.concatenate([best[0], b.column("id").to_numpy()]), np.concatenate([best[1], s])
            keep = np.lexsort((ids, -s))[:k]
            best = ids[keep], s[keep]
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1], pa.float32())], names=["id", "score"])

    rows = apply_filter(records, where).select("id", "vector")
    return rows.mapInArrow(run, "id long, score float").orderBy(F.desc("score"), "id").limit(k)


def top_k_each(records: DataFrame, probes: DataFrame, k: int = DEFAULT_TOP_K, where: Filter | Column | str | None = None, max_probes: int = 10_000) -> DataFrame:
    """probe_id, id, score: the k best for each probe (probe_id, probe); probe ids are distinct.

    The probes are stated queries. They go to the tasks in blocks of at most max_probes, fewer
    where vectors or k are long, a pass over the records each. A task scores them in tiles and
    keeps k rows a probe, so its memory depends neither on the number of probes nor of records,
    and no row meets a row it must not.
    """
    k = check_top_k(k)
    parts = [_top_k_block(records, *block, k, where) for block in _blocks(probes, k, max_probes)]
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(W.partitionBy("probe_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).drop("rank")


def _blocks(probes: DataFrame, k: int, max_probes: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and vectors of the probes in blocks, streamed to the driver; one empty block if there are none."""
    names, vectors = [], []
    for name, vector in probes.select("probe_id", "probe").repartition("probe_id").toLocalIterator():
        if len(names) >= max_probes or len(names) >= LEAST_PROBES and len(names) * max(vectors[0].size, k) >= HELD:
            yield names, vectors
            names, vectors = [], []
        names.append(name)
        vectors.append(np.array(vector, np.float64))
    yield names, vectors


def _top_k_block(records: DataFrame, probe_ids: list[int], probes: list[np.ndarray], k: int, where: Filter | Column | str | None) -> DataFrame:
    """The k best of each task for a block of probes."""
    names = np.array(probe_ids, np.int64)
    q = np.array(probes, np.float64).reshape(len(names), -1) if probes else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [(names[a : a + TILE[0]], q[a : a + TILE[0]]) for a in range(0, len(names), TILE[0])]
        none = [(np.zeros((len(n), 0), np.float32), np.zeros((len(n), 0), np.int64)) for n, _ in tiles]

        def rows(best: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for (n, _), (s, i) in zip(tiles, best):
                cols = [pa.array(np.repeat(n, i.shape[1])), pa.array(i.ravel()), pa.array(s.ravel(), pa.float32())]
                yield pa.RecordBatch.from_arrays(cols, names=["probe_id", "id", "score"])

        best = none
        for b in batches:
            if not (b.num_rows and tiles and k):
                continue
            vectors = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            ids = b.column("id").to_numpy()
            for a in range(0, b.num_rows, TILE[1]):
                v = vectors[a : a + TILE[1]].astype(np.float64)
                best = [_better(held, p, v, ids[a : a + TILE[1]], k) for held, (_, p) in zip(best, tiles)]
                # only where k passes what a block allows for: what was kept so far goes out, the ranks decide
                if sum(i.size for _, i in best) > 2 * HELD:
                    yield from rows(best)
                    best = none
        yield from rows(best)

    return apply_filter(records, where).select("id", "vector").mapInArrow(run, "probe_id long, id long, score float")


def _better(held: tuple[np.ndarray, np.ndarray], q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best for each probe of those held, best first, and of more records; NaN ranks first."""
    denom = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))
    with np.errstate(all="ignore"):
        s = np.where(denom == 0, 0, q @ v.T / denom).astype(np.float32)
    order = lambda x: np.where(np.isnan(x), np.float32(np.inf), x)
    rank, n = order(s), held[0].shape[1]
    # what k others of a probe pass is not among the best
    if n == k:
        last = order(held[0][:, -1:])
        hit = (rank > last) | (rank == last) & (ids < held[1][:, -1:])
    elif len(ids) > k:
        hit = rank >= np.partition(rank, len(ids) - k, axis=1)[:, len(ids) - k, None]
    else:
        hit = np.ones(rank.shape, bool)
    p, r = np.nonzero(hit)
    p, s, i = np.concatenate([np.repeat(np.arange(len(q)), n), p]), np.concatenate([held[0].ravel(), s[p, r]]), np.concatenate([held[1].ravel(), ids[r]])
    by = np.lexsort((i, -order(s), p))
    keep = by[np.searchsorted(p[by], np.arange(len(q)))[:, None] + np.arange(min(k, n + len(ids)))]
    return s[keep], i[keep]


class Query:
    """A hybrid query on a collection: Query("items", probe).top_k(5).filter("price < 10").run(db)."""

    def __init__(self, collection: str, vector: Sequence[float]):
        self.collection, self.vector = collection, list(vector)
        self.k, self.where = DEFAULT_TOP_K, None

    def top_k(self, k: int) -> Query:
        self.k = check_top_k(k)
        return self

    def filter(self, where: Filter | Column | str) -> Query:
        self.where = Filter.parse(where) if isinstance(where, str) else where
        return self

    def run(self, db) -> DataFrame:
        dim = db.dim(self.collection)
        check_vector(self.vector, dim)
        return top_k(db.records(self.collection, pos=False), self.vector, self.k, self.where)
