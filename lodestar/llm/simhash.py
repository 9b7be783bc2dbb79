"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint bit is set if it is set in over half the XXH64 (seed 42) of the word
shingles of a text. Fingerprints within the radius r are linked. Every bit position i
has a non-zero vector m(i) of r + 1 bits, and table v, for each of the 2**(r+1) - 1
non-zero vectors, keeps the bits with <m(i), v> = 1. The r positions in which two linked
fingerprints differ span at most r dimensions, so some v is orthogonal to all of them:
in that table the two collide, always, not just probably.

Equal fingerprints are one row before any table is built. Tasks stream their buckets in
key order and emit a spanning forest of each bucket, never its pairs: a breadth-first
walk compares a reached fingerprint only with those not reached yet. A bucket over the
limit is passed on. Without sketches, fingerprints are distinct, and a second covering
family splits it (each link still meets in some part of it), round after round. With
sketches, any number of rows can have one fingerprint, which no mask over it splits; the
rows passed on, each once, are dealt into blocks instead, and every two blocks are one
bucket, so that all pairs are compared. What is left after MASK_LEVELS ends so, too.

A link can also ask for a second look: a sketch of 256 bits over the set of longer shingles
travels with the fingerprint, and both distances must be small. near_dedup() uses
fingerprints of single words, which a few edits hardly move, and sketches of five-word
shingles to find candidates: at a Jaccard similarity of 0.8 two sketches differ in 39 bits
on average, unrelated ones in 128; 56 are let through. The shingle sets themselves decide,
see verified(): a link has an exact Jaccard similarity of 0.8 at least.

Null and empty texts have no words and fingerprint 0, linked like any other. For simhash(),
rows with a null doc_id get a fingerprint, but no component; repeated rows and ids are rows
like any other, and an id is the name of all rows that have it. near_dedup() tells rows
apart by a key of their own: of a group the row with the smallest doc_id stays (nulls last,
then the order of reading), of exact repeats one, and a text that shares only its doc_id
with others is not touched. Very long texts are read whole, in parts of bounded size. Other
columns are not read (simhash), or travel in a struct (near_dedup), so names can't clash. An
empty table gives an empty result.
"""

from __future__ import annotations

import random
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import Scratch, documents, packed, signed, slices, unpacked

#: For a byte, its bits as eight counters of eight bits.
SPREAD = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], np.uint64)
SEED = 42
#: Covering families tried on fingerprints without sketches.
MASK_LEVELS = 9
NO_LIMIT = 1 << 62
SKETCH = ["s0", "s1", "s2", "s3"]
NODE = ["fp", "rep", *SKETCH]
PAIR = "edge boolean, a long, b long, key long, s0 long, s1 long, s2 long, s3 long"
_PAIR = pa.schema([("edge", pa.bool_()), *((c, pa.int64()) for c in ("a", "b", "key", *SKETCH))])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    """A second hash from the first."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bits(words: list[bytes], shingle: int, lanes: int = 1, block: int = 1 << 16) -> list[int]:
    """`lanes` signed 64-bit parts of the fingerprint of the shingles of words; the first is over XXH64 itself."""
    if not words:
        return [0] * lanes
    k = min(shingle, len(words))
    n = len(words) - k + 1
    counts = np.zeros((lanes, 64), np.int64)
    for at in range(0, n, block):
        part = words[at : at + block + k - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(k)))) if k > 1 else part
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        starts = np.arange(0, len(h), 255)
        for lane in range(lanes):
            h = _mixed(h) if lane else h
            packed = SPREAD[h.view(np.uint8).reshape(-1, 8)]
            counts[lane] += np.add.reduceat(packed, starts, axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view(np.int64).ravel().tolist()


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """The hashes of the distinct shingles, in order."""
    k = min(k, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)))) if k > 1 else words
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def sketch_of(h: np.ndarray, lanes: int = 4) -> list[int]:
    """`lanes` signed 64-bit parts of the fingerprint of a set of hashes."""
    out, starts = [], np.arange(0, len(h), 255)
    for lane in range(lanes if len(h) else 0):
        h = _mixed(h) if lane else h
        counts = np.add.reduceat(SPREAD[h.view(np.uint8).reshape(-1, 8)], starts, axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * counts > len(h), bitorder="little").view(np.int64).tolist()
    return out or [0] * lanes


def fingerprints(docs: DataFrame, shingle: int, sketch: int | None = None) -> DataFrame:
    """docs (with a column text) and fp; with a sketch also a key of the row, s0 to s3, and sid, which names the set of shingles."""
    more = ["key", "fp", *SKETCH, "sid"] if sketch else ["fp"]

    def run(batches):
        key = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            rows = []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                fp = bits(words, shingle)
                if sketch:
                    h = shingle_set(words, sketch)
                    rows.append([key, *fp, *sketch_of(h), signed(xxhash.xxh64_intdigest(h.tobytes()))])
                    key += 1
                else:
                    rows.append(fp)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in zip(*rows))], names=[*b.schema.names, *more])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in more)]))


def masks(radius: int, family: int = 0) -> list[int]:
    """The covering masks; families differ in which positions share a vector."""
    order = list(range(64))
    if family:
        random.Random(family).shuffle(order)
    tables = (1 << (radius + 1)) - 1
    vector = {pos: 1 + i % tables for i, pos in enumerate(order)}
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, tables + 1)]


def linked(fp: np.ndarray, sk: np.ndarray, p, q, radius: int, far: int | None) -> np.ndarray:
    """Which of the rows q are linked to p (or to each p)?"""
    near = np.bitwise_count(fp[q] ^ fp[p]) <= radius
    if far is not None:
        near &= np.bitwise_count(sk[q] ^ sk[p]).sum(axis=1, dtype=np.int64) <= far
    return near


def forest(fp: np.ndarray, sk: np.ndarray, radius: int, far: int | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links of fingerprints (n) with sketches (n, 4), unsigned."""
    edges, rest = [], np.arange(len(fp))
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            p = stack.pop()
            near = linked(fp, sk, p, rest, radius, far)
            if near.any():
                hits = rest[near].tolist()
                edges += [(p, q) for q in hits]
                stack += hits
                rest = rest[~near]
    return edges


class Union:
    """Union-find over the ids of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _met(batches):
    """Rows (key, rep) in key order; those whose key another row has, too."""
    key, rep, done = np.zeros(0, np.int64), np.zeros(0, np.int64), True
    for b in batches:
        if not b.num_rows:
            continue
        key, rep = np.concatenate([key, b.column("key").to_numpy()]), np.concatenate([rep, b.column("rep").to_numpy()])
        same = key[1:] == key[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        last = bool(keep[-1])
        keep[0] &= not (done and len(key) > b.num_rows)  # it has been passed on already
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(rep[keep])], names=["key", "rep"])
        key, rep, done = key[-1:], rep[-1:], last


def _buckets(radius: int, far: int | None, limit: int):
    """Rows (key, fp, rep, sketch) in key order; emits the edges of spanning forests, and the rows of buckets over the limit."""
    names = ["key", *(NODE if far is not None else NODE[:2])]

    def edges_of(found):
        n = len(found)
        a, b = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array([True] * n), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(n, pa.int64()) for _ in range(5))], schema=_PAIR)

    def deferred(key, fp, rep, *sk):
        sk = sk or (np.zeros(len(key), np.int64),) * 4
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), bool)), *map(pa.array, (fp, rep, key, *sk))], schema=_PAIR)

    def run(batches):
        union = Union()
        held = (np.empty(0, np.int64),) * len(names)
        passing = None

        def settle(cols):
            """Whole buckets only."""
            key, rep = cols[0], cols[2]
            # unsigned: of a negative number numpy would count the bits of the absolute value
            fp, sk = cols[1].view(np.uint64), np.column_stack(cols[3:] or [key]).view(np.uint64)
            start = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            size = np.diff(np.concatenate([start, [len(key)]]))
            found, late = [], []
            two = start[size == 2]
            two = two[linked(fp, sk, two, two + 1, radius, far)]
            found += zip(rep[two].tolist(), rep[two + 1].tolist())
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                if n > limit:
                    late.append(tuple(c[s : s + n] for c in cols))
                else:
                    found += ((int(rep[s + i]), int(rep[s + j])) for i, j in forest(fp[s : s + n], sk[s : s + n], radius, far))
            found = [x for x in found if union.join(*x)]
            if found:
                yield edges_of(found)
            for x in late:
                yield deferred(*x)

        for b in batches:
            cols = tuple(np.concatenate([h, b.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, names))
            if passing is not None:
                n = int(np.searchsorted(cols[0] != passing, True))
                if n:
                    yield deferred(*(c[:n] for c in cols))
                    cols = tuple(c[n:] for c in cols)
                passing = None if len(cols[0]) else passing
            if not len(cols[0]):
                held = cols
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield from settle(tuple(c[:last] for c in cols))
            held = tuple(c[last:] for c in cols)
            if len(held[0]) > limit:
                passing = int(held[0][0])
                yield deferred(*held)
                held = tuple(c[:0] for c in held)
        if len(held[0]):
            yield from settle(held)

    return run


def block_pairs(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (key, node) in which every two rows share a key; a key has two blocks of about limit rows."""
    blocks = max(1, -(-rows.count() // limit))
    mine, other = F.pmod(F.xxhash64("rep"), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.withColumn("mine", mine).withColumn("other", other)
    return dealt.select(F.xxhash64(F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), *rows.columns)


def links(nodes: DataFrame, radius: int, scratch: Scratch, far: int | None = None, limit: int = 20_000) -> DataFrame:
    """Edges (a, b) between the representatives of nodes that connect all links."""
    edges, level = None, 0
    columns = NODE if far is not None else NODE[:2]
    rows = nodes.select(F.lit(0).cast("long").alias("key"), *columns)
    while True:
        last = level == (MASK_LEVELS if far is None else 1)
        if last:
            # a mask can't split equal fingerprints: all pairs of the rows left, each row once
            spread = block_pairs(scratch.write(rows.select(*columns).distinct(), "links-rest"), limit)
        else:
            tables = F.array(*[F.xxhash64(F.lit(v), F.col("key"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for v, m in enumerate(masks(radius, level))])
            if far is None:
                spread = rows.select(F.explode(tables).alias("key"), *columns)
            else:  # most rows meet no other in most tables: only those that do take their sketches along
                spread = rows.select(F.explode(tables).alias("key"), "rep").repartition("key").sortWithinPartitions("key")
                spread = scratch.write(spread.mapInArrow(_met, "key long, rep long"), "met").join(rows.select(*columns), "rep")
        out = spread.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_buckets(radius, far, NO_LIMIT if last else limit), PAIR)
        out = scratch.write(out, f"links{level}")
        edges = out.where("edge").select("a", "b") if edges is None else edges.union(out.where("edge").select("a", "b"))
        rows = out.where("not edge").select("key", F.col("a").alias("fp"), F.col("b").alias("rep"), *columns[2:])
        level += 1
        if last or rows.isEmpty():
            return edges


def _jaccard(least: float):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sets(shingle: int):
    def run(batches):
        for b in slices(batches):
            sets = [shingle_set(words_of(t), shingle).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sets, pa.binary())], names=["node", "x"])

    return run


def similar(sets: list[np.ndarray], least: float, columns: int = 2048) -> np.ndarray:
    """Which sets have a Jaccard similarity of `least` with which others: all of a bucket at once, exactly (not with themselves)."""
    size = np.array(list(map(len, sets)), np.float64)
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(code, minlength=len(every)) > 1  # members of one set alone are in no overlap
    number = np.cumsum(shared) - 1
    row, col = np.repeat(np.arange(len(sets)), size.astype(np.int64))[shared[code]], number[code][shared[code]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(shared.sum()), columns):
        a, z = np.searchsorted(col, [k, k + columns])
        x = np.zeros((len(sets), columns), np.float32)
        x[row[a:z], col[a:z] - k] = 1
        both += x @ x.T  # whole numbers below 2**24: exact
    both = both.astype(np.float64)
    return both >= least * (size[:, None] + size - both)


def _connect(least: float):
    """Rows (bucket, node, label, mine, x) by bucket; emits links that connect the labels of a bucket.

    Of a bucket of two blocks only pairs across them count; those within one have a bucket of their own.
    """

    def settle(rows):
        node, label, mine, sets = (list(c) for c in zip(*rows))
        if len(set(label)) < 2:
            return []
        label, mine = np.unique(label, return_inverse=True)[1], np.array(mine)
        link = similar([np.frombuffer(x, np.uint64) for x in sets], least) & (label[:, None] != label)
        if len(set(mine.tolist())) > 1:
            link &= mine[:, None] != mine
        found, union = [], Union()
        for p in np.flatnonzero(link.any(axis=1)).tolist():
            to = np.flatnonzero(link[p])
            _, first = np.unique(label[to], return_index=True)
            found += [(node[p], node[q]) for q in to[first].tolist() if union.join(int(label[p]), int(label[q]))]
        return found

    def run(batches):
        held, bucket = [], None
        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "node", "label", "mine", "x"))):
                if k != bucket:
                    if held and (found := settle(held)):
                        yield _edges(found)
                    held, bucket = [], k
                held.append(row)
        if held and (found := settle(held)):
            yield _edges(found)

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(rows: DataFrame, nodes: DataFrame, radius: int, far: int, shingle: int, least: float, scratch: Scratch, limit: int = 20_000, block: int = 500, block_bytes: int = 8 << 20) -> DataFrame:
    """Edges (a, b), all with a Jaccard similarity of `least`, that connect every such pair within a component of candidates.

    The forest of the candidates is verified first. Where a component of candidates is not
    connected by what passed, a link beside the forest may connect its parts. There the sets
    of its nodes are dealt into blocks of bounded size, every two of them meet in a task, and
    the task compares all sets of different parts; it emits at most one link for two parts.
    """
    candidates = links(nodes, radius, scratch, far, limit).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    candidates = scratch.write(candidates, "candidates")
    groups = scratch.write(components(candidates, scratch), "groups")
    sets = scratch.write(rows.select("key", "text").join(groups.select(F.col("node").alias("key")), "key", "left_semi").mapInArrow(_sets(shingle), "node long, x binary"), "sets")
    first, second = sets.toDF("a", "x"), sets.toDF("b", "y")
    sure = scratch.write(candidates.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(_jaccard(least), "a long, b long"), "sure")
    parts = components(sure, scratch).withColumnRenamed("component", "label")
    parts = scratch.write(groups.join(parts, "node", "left").join(sets.select("node", F.octet_length("x").alias("size")), "node").select("node", "component", F.coalesce("label", "node").alias("label"), "size"), "parts")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / block_bytes))
    torn = parts.groupBy("component").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), blocks.cast("int").alias("blocks")).where("lo <> hi")
    dealt = parts.join(torn, "component").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    bucket = F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other"))
    met = dealt.select(bucket.alias("bucket"), "node", "label", "mine").join(sets, "node")
    more = met.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_connect(least), "a long, b long")
    return sure.unionByName(scratch.write(more, "more"))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp (long), component_id; one row per input row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(documents(docs, id_col, text_col), shingle).select("doc_id", "fp"), "fps")
    nodes = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = scratch.write(nodes.select("fp", F.col("fp").alias("rep"), "least"), "nodes")
    labels = components(links(nodes, radius, scratch), scratch)
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(smallest, "component").select("fp", "component_id")
    return fps.join(found, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 1, radius: int = 5, sketch: tuple[int, int] = (5, 56), least: float = 0.8) -> DataFrame:
    """The rows of docs that are the first of their group."""
    scratch = Scratch(docs.sparkSession, "near")
    words, far = sketch
    rows = scratch.write(fingerprints(packed(docs, id_col, text_col), shingle, words), "rows")
    alike = ["fp", *SKETCH, "sid"]
    nodes = rows.groupBy(*alike).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first"))
    nodes = scratch.write(nodes.select("fp", *SKETCH, "first", F.col("first.key").alias("rep")), "nodes")
    labels = components(verified(rows, nodes, radius, far, words, least, scratch), scratch).withColumnRenamed("node", "rep")
    kept = nodes.join(labels, "rep", "left").groupBy(F.coalesce("component", "rep").alias("component")).agg(F.min("first").alias("first"))
    gone = rows.select("key").join(kept.select(F.col("first.key").alias("key")), "key", "left_anti")
    return unpacked(rows.join(gone, "key", "left_anti"), docs, text_col)
