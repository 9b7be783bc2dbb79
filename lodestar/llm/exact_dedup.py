"""Exact dedup with an extendible-hash index kept in the shared folder.

1. Map tasks normalise texts (A-Z only), collapse equal texts of a bounded window
   byte for byte, and write one entry per distinct text of the window to the shared
   folder, beside one small row per document that points at its entry.
2. The directory starts with one bucket and doubles while a bucket holds more bytes
   than its capacity; overfull buckets split on the next bit of the XXH64 of the text.
   Only a histogram over hash prefixes reaches the driver, of a few prefixes a bucket and
   at most 2**MAX_DEPTH; where the data outgrow that, the capacity grows with them.
3. Every bucket belongs to one owner task; owners hold contiguous key ranges. An owner
   streams its entries in hash order, chains entries of one hash, and compares bytes
   with each text of the chain, so that a hash collision never merges two texts.
4. A text with entries in very many windows is first dealt to several owners, who compare
   bytes in the same way; the entries that they are left with go to the owner of the hash.
5. Documents get their class back by joining on their entry, not on the text, so a
   text that a third of all rows share is spread over as many keys as windows.

Nulls in the text count as the empty text; very long texts are compared whole. Of equal
texts the row with the largest doc_id stays (a null doc_id is smaller than any other); of
repeated rows with that id exactly one is kept. Other columns are not read, so their names
can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, documents, signed, slices

MAX_DEPTH = 18
#: Entries of one hash beyond which a text is first compared by several owners.
HOT = 1000
LOWEST = -(1 << 63)
ENTRY = "doc_id long, gid long, keeper boolean, h long, n long, top long, size long, sha string, body binary"
CLASS = "gid long, keep_id long, keep_gid long, group_size long"
_ENTRY = pa.schema([("doc_id", pa.int64()), ("gid", pa.int64()), ("keeper", pa.bool_()), ("h", pa.int64()), ("n", pa.int64()), ("top", pa.int64()), ("size", pa.int64()), ("sha", pa.string()), ("body", pa.binary())])
_CLASS = pa.schema([("gid", pa.int64()), ("keep_id", pa.int64()), ("keep_gid", pa.int64()), ("group_size", pa.int64())])


def _entries(window_bytes: int):
    def run(batches):
        gid = TaskContext.get().partitionId() << 34
        for b in slices(batches, window_bytes):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            seen: dict[bytes, int] = {}
            top, size, of = [], [], []
            for i, t in zip(ids, texts):
                i = LOWEST if i is None else i
                k = seen.setdefault((t or "").encode("utf-8", "surrogatepass").lower(), len(seen))
                of.append(k)
                if k == len(top):
                    top.append(i)
                    size.append(1)
                else:
                    size[k] += 1
                    top[k] = max(top[k], i)
            bodies, first, kept = list(seen), set(), set()
            rows = {name: [] for name in _ENTRY.names}
            for i, k in zip(ids, of):
                head = k not in first
                first.add(k)
                keeper = (LOWEST if i is None else i) == top[k] and k not in kept
                if keeper:
                    kept.add(k)
                body = bodies[k] if head else None
                rows["doc_id"].append(i)
                rows["gid"].append(gid + k)
                rows["keeper"].append(keeper)
                rows["h"].append(signed(xxhash.xxh64_intdigest(body)) if head else None)
                rows["n"].append(size[k] if head else None)
                rows["top"].append(top[k] if head else None)
                rows["size"].append(len(body) if head else None)
                rows["sha"].append(hashlib.sha256(body).hexdigest() if head else None)
                rows["body"].append(body)
            gid += len(seen)
            yield pa.RecordBatch.from_pydict(rows, schema=_ENTRY)

    return run


def _owners(batches):
    """Entries sorted by hash: close a chain when the hash changes."""
    chain: list[list] = []
    last = None
    out = {name: [] for name in _CLASS.names}

    def close():
        for _, keep, keep_gid, size, gids in chain:
            out["gid"] += gids
            out["keep_id"] += [keep] * len(gids)
            out["keep_gid"] += [keep_gid] * len(gids)
            out["group_size"] += [size] * len(gids)
        chain.clear()

    for b in batches:
        for gid, h, n, top, body in zip(*(b.column(c).to_pylist() for c in ("gid", "h", "n", "top", "body"))):
            if h != last:
                close()
                last = h
            for c in chain:
                if c[0] == body:
                    if (top, -gid) > (c[1], -c[2]):
                        c[1], c[2] = top, gid
                    c[3] += n
                    c[4].append(gid)
                    break
            else:
                chain.append([body, top, gid, n, [gid]])
        if len(out["gid"]) > 50_000:
            yield pa.RecordBatch.from_pydict(out, schema=_CLASS)
            out = {name: [] for name in _CLASS.names}
    close()
    if out["gid"]:
        yield pa.RecordBatch.from_pydict(out, schema=_CLASS)


def directory(histogram: list[tuple[int, int]], depth: int, capacity: int) -> tuple[int, list[int]]:
    """Extendible hashing over a histogram of hash prefixes of `depth` bits.

    Returns the global depth and, for every slot of the directory, its bucket: a bucket of
    local depth d is shared by 2**(global - d) neighbouring slots.
    """
    size = [0] * (1 << depth)
    for prefix, n in histogram:
        size[prefix] += n
    total = [0]
    for n in size:
        total.append(total[-1] + n)
    buckets, work, top = [], [(0, 0)], 0
    while work:
        prefix, d = work.pop()
        lo, hi = prefix << (depth - d), (prefix + 1) << (depth - d)
        if d < depth and total[hi] - total[lo] > capacity:
            work += [(2 * prefix + 1, d + 1), (2 * prefix, d + 1)]
            top = max(top, d + 1)  # the directory doubles up to the deepest bucket
        else:
            buckets.append((prefix, d))
    slots: list[int] = []
    for k, (_, d) in enumerate(buckets):
        slots += [k] * (1 << (top - d))
    return top, slots


def classes(heads: DataFrame, place: Callable[[DataFrame], DataFrame], scratch: Scratch, hot: int = HOT) -> DataFrame:
    """gid, keep_id, keep_gid, group_size of entries (gid, h, n, top, body); place deals entries to owners, in hash order."""
    columns = ["gid", "h", "n", "top", "body"]
    often = heads.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot)
    often = scratch.write(often.select("h", F.ceil(F.col("k") / hot).cast("int").alias("parts")), "often")
    many = often.count()
    if not many:
        return place(heads.select(*columns)).mapInArrow(_owners, CLASS)
    marked = heads.select(*columns).join(F.broadcast(often) if many <= 100_000 else often, "h", "left")
    dealt = marked.where("parts is not null").select("gid", F.xxhash64("h", F.pmod(F.xxhash64("gid"), F.col("parts"))).alias("h"), "n", "top", "body", F.col("h").alias("own"))
    first = scratch.write(dealt.select(*columns).repartition("h").sortWithinPartitions("h").mapInArrow(_owners, CLASS), "hot")
    left = first.where("gid = keep_gid").select("gid", F.col("group_size").alias("n"), F.col("keep_id").alias("top"))
    left = left.join(dealt.select("gid", F.col("own").alias("h"), "body"), "gid").select(*columns)
    second = scratch.write(place(marked.where("parts is null").select(*columns).unionByName(left)).mapInArrow(_owners, CLASS), "classes")
    through = first.select("gid", F.col("keep_gid").alias("part")).join(second.withColumnRenamed("gid", "part"), "part").drop("part")
    return second.join(first.select("gid"), "gid", "left_anti").unionByName(through)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window_bytes: int = 8 << 20, bucket_bytes: int = 8 << 20, hot: int = HOT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    entries = scratch.write(documents(docs, id_col, text_col).mapInArrow(_entries(window_bytes), ENTRY), "entries", "lz4")
    heads = entries.where("h is not null")
    weight = F.col("size") + 64
    total = heads.agg(F.sum(weight)).first()[0] or 0
    bits = min(MAX_DEPTH, max(1, (8 * total // bucket_bytes).bit_length()))
    capacity = max(bucket_bytes, 8 * total >> bits)
    counted = heads.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("p")).agg(F.sum(weight).alias("n")).toArrow()
    depth, slots = directory(list(zip(counted.column("p").to_pylist(), counted.column("n").to_pylist())), bits, capacity)
    owners = max(slots) + 1
    index = scratch.write(spark.createDataFrame([(s, k) for s, k in enumerate(slots)], "slot long, bucket int").coalesce(1), "directory")
    slot = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")

    def place(rows: DataFrame) -> DataFrame:
        owned = rows.withColumn("slot", slot).join(F.broadcast(index), "slot")  # 2**MAX_DEPTH slots at most
        return owned.repartitionById(owners, "bucket").select(*rows.columns).sortWithinPartitions("h")

    found = classes(heads, place, scratch, hot)
    shas = heads.select("gid", "sha")
    keep = F.when(F.col("keep_id") != LOWEST, F.col("keep_id"))
    return (
        entries.select("doc_id", "gid", "keeper")
        .join(found.join(shas, "gid"), "gid")
        .select("doc_id", keep.alias("keep_id"), "group_size", (F.col("keeper") & (F.col("gid") == F.col("keep_gid"))).alias("kept"), F.col("sha").alias("text_sha256"))
    )
