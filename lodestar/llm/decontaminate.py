"""Benchmark decontamination by spaced-seed hashing.

Words are lower-case runs without white space, bare of punctuation at their ends. A mask
hashes the words at its ones and ignores the others, so that a window with substituted
words in the ignored places still meets its original. Test items of fewer than LONG words
have masks of their own length, one for each choice of the places that the similarity lets
differ. A longer item, of which `free` words may differ, is cut into free + 1 blocks, each
under a mask of ones: however the words are substituted, one block is left whole. So every
leak within the similarity has a hit; none is missed.

1. Test items give seeds (hash, item, position); their hashes set bits of a bitmap of
   fixed size, which is all that is broadcast.
2. Training texts are scanned once. Windows that find their bit are hits; hits near one
   another form a cluster, which is kept with the words around it.
3. Hits join the seeds on the hash; each hit names an item and a diagonal. On every
   distinct diagonal of a cluster the words of the whole item are compared with the text,
   and a document is contaminated by an item if at least `similarity` of the words of the
   item agree in place.

Null and empty texts have no words; an item without words is not searched, and one of fewer
than five must agree in full. Equal rows give equal results: leaks() has one row per doc_id
and item, the best diagonal (most equal words, then the smallest start), and rows without an
id come under a null id. decontaminate() goes by id and text, so that rows of one id or of
none are told apart. Very long texts are read whole; clusters hold the words around hits
alone. Other columns are not read, or stay where they are, so names can't clash. Empty
tables give no leaks.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, bitmap, documents, in_bitmap, slices

#: Items of this many words are cut into blocks; for shorter ones the masks are few enough to have all.
LONG = 11
PUNCT = ".,;:!?\"'()[]{}<>|*-_#"
U = np.uint64


def word_hashes(text: str | None, known: dict[str, int]) -> list[int]:
    out = []
    for w in (text or "").lower().split():
        h = known.get(w)
        if h is None:
            bare = w.strip(PUNCT)
            h = known[w] = xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")) if bare else -1
        if h >= 0:
            out.append(h)
    return out


@functools.cache
def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the window at every position (uint64)."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.full(n, U(len(mask) << 16 | int(mask, 2)), U)  # of one mask only
    for k, off in enumerate(_offsets(mask)):
        h = (h ^ words[off : off + n]) * U(0x9E3779B97F4A7C15 + 2 * k)
        h ^= h >> U(29)
    return h


def test_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words array<long>) of items that are searched; item is a key of the row."""

    def run(batches):
        known, key = {}, TaskContext.get().partitionId() << 33
        for b in slices(batches):
            words = [np.array(word_hashes(t, known), U).view(np.int64) for t in b.column("text").to_pylist()]
            keep = [len(w) > 0 for w in words]
            ids = [i for i, k in zip(b.column("doc_id").to_pylist(), keep) if k]
            keys = pa.array(range(key, key + len(ids)), pa.int64())
            key += len(ids)
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.int64()), pa.array([w for w, k in zip(words, keep) if k], pa.list_(pa.int64()))], names=["item", "item_id", "words"])

    return benchmark.mapInArrow(run, "item long, item_id long, words array<long>")


@functools.cache
def masks_of(n: int, similarity: float) -> list[tuple[int, str]]:
    """(start, mask) for an item of n words; any substitutions within the similarity spare one."""
    free = n - math.ceil(round(similarity * n, 9))
    if n >= LONG:
        cut = [n * k // (free + 1) for k in range(free + 2)]
        return [(a, "1" * (z - a)) for a, z in zip(cut, cut[1:])]
    return [(0, "".join("0" if i in gone else "1" for i in range(n))) for gone in combinations(range(n), free)]


def seeds(items: DataFrame, similarity: float) -> DataFrame:
    """(h, item, at) of the masks of all items."""

    def run(batches):
        for b in batches:
            rows = ([], [], [])
            for i, ws in zip(b.column("item").to_pylist(), b.column("words").to_pylist()):
                ws = np.array(ws, np.int64).view(U)
                for at, m in masks_of(len(ws), similarity):
                    h = seed_hashes(ws[at : at + len(m)], m)
                    rows[0].extend(h.view(np.int64).tolist())
                    rows[1].append(i)
                    rows[2].append(at)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32())], names=["h", "item", "at"])

    return items.mapInArrow(run, "h long, item long, at int")


CLUSTER = "key long, doc_id long, body long, start int, words array<long>, hits array<struct<h:long,at:int>>"
_CLUSTER = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("body", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.int64())), ("hits", pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())])))])


def _clusters(table, masks: list[str], reach: int):
    """Clusters of hits, each with the words up to `reach` around it."""

    def run(batches):
        key, known = TaskContext.get().partitionId() << 33, {}
        for b in slices(batches, 4 << 20):
            if len(known) > 500_000:
                known = {}
            ids, bodies, found = b.column("doc_id").to_pylist(), b.column("body").to_pylist(), [word_hashes(t, known) for t in b.column("text").to_pylist()]
            size = np.fromiter(map(len, found), np.int64, len(found))
            stop = np.cumsum(size)
            words = np.array([h for hs in found for h in hs], U)
            doc_of = np.repeat(np.arange(len(found)), size)
            where, what = [], []
            for m in masks:
                h = seed_hashes(words, m)
                at = np.flatnonzero(in_bitmap(table.value, h))
                at = at[doc_of[at] == doc_of[at + len(m) - 1]]
                where.append(at)
                what.append(h[at])
            at, h = np.concatenate([np.zeros(0, np.int64), *where]), np.concatenate([np.zeros(0, U), *what])
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
            cut = np.flatnonzero((np.diff(at) > 2 * reach) | (np.diff(doc_of[at]) > 0)) + 1
            rows = []
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(at)]):
                d = int(doc_of[at[a]])
                first = int(stop[d] - size[d])
                lo, hi = max(first, int(at[a]) - reach), min(int(stop[d]), int(at[z - 1]) + reach + 16)
                hits = [{"h": int(x), "at": int(p) - lo} for x, p in zip(h[a:z].view(np.int64), at[a:z])]
                rows.append({"key": key, "doc_id": ids[d], "body": bodies[d], "start": lo - first, "words": words[lo:hi].view(np.int64).tolist(), "hits": hits})
                key += 1
            yield pa.RecordBatch.from_pylist(rows, schema=_CLUSTER)

    return run


def _leaks(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """doc_id, body (a hash of the text), item_id, start, n_equal, n_words of documents and test items (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    items = scratch.write(test_items(benchmark), "items")
    size = F.size("words")
    longest = items.agg(F.max(size)).first()[0] or 0
    sizes = [r[0] for r in items.select(size).distinct().collect()]
    masks = sorted({m for n in sizes for _, m in masks_of(n, similarity)})
    planted = scratch.write(seeds(items, similarity), "seeds")
    table = spark.sparkContext.broadcast(bitmap(planted))
    clusters = scratch.write(docs.withColumn("body", F.xxhash64("text")).mapInArrow(_clusters(table, masks, longest), CLUSTER), "clusters")
    hits = clusters.select("key", F.explode("hits").alias("hit")).select("key", F.col("hit.h").alias("h"), F.col("hit.at").alias("p"))
    diagonals = hits.join(planted, "h").select("key", "item", (F.col("p") - F.col("at")).alias("diagonal")).distinct()
    pairs = diagonals.join(clusters.select("key", "doc_id", "body", "start", F.col("words").alias("text")), "key").join(items, "item")
    lo = F.greatest(F.lit(0), -F.col("diagonal"))
    n = F.least(F.size("words"), F.size("text") - F.col("diagonal")) - lo
    same = F.zip_with(F.slice("words", lo + 1, n), F.slice("text", lo + F.col("diagonal") + 1, n), lambda a, b: (a == b).cast("int"))
    equal = F.aggregate(same, F.lit(0), lambda s, x: s + x)
    scored = pairs.select("doc_id", "body", "item_id", (F.col("start") + F.col("diagonal")).alias("start"), equal.alias("n_equal"), F.size("words").alias("n_words"))
    return scored.where(F.col("n_equal") >= similarity * F.col("n_words"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, start (in words), n_equal, n_words, similarity; one row per leak."""
    scored = _leaks(documents(docs, id_col, text_col), documents(benchmark, item_col, item_text), similarity)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", (-F.col("start")).alias("back"), "n_words")).alias("b"))
    return best.select(
        "doc_id",
        "item_id",
        (-F.col("b.back")).cast("long").alias("start"),
        F.col("b.n_equal").cast("long").alias("n_equal"),
        F.col("b.n_words").cast("long").alias("n_words"),
        (F.col("b.n_equal") / F.col("b.n_words")).alias("similarity"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs without contaminated documents."""
    gone = _leaks(documents(docs, id_col, text_col), documents(benchmark, item_col, item_text), similarity).select("doc_id", "body").distinct()
    gone = Scratch(docs.sparkSession, "leaks").write(gone, "gone").toDF("gone_id", "gone_body")
    d = docs.alias("d")
    same = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("gone_body"))
    return d.join(gone, same, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
