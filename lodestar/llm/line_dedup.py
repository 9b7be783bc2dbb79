"""Line dedup over content-defined chunks of lines.

A text is cut after a line where a rolling hash over the hashes of the last two lines
falls on a fixed remainder, so that boundaries depend on what the lines say and not on
where they stand; a chunk has MIN_LINES to MAX_LINES lines, and a rest too short for a
chunk goes with the one before it. A line of LONG bytes or more says enough to be a chunk
of its own: there are boundaries on both sides of it. Of a chunk of several lines, or of one
long line, that occurs more than once, in one document or in several, the first occurrence
(smallest doc_id, then position) stays and all others are removed. Chunks without a visible
character are left alone, and so are single short lines.

1. All chunk hashes are counted; those that occur twice or more set bits of a bitmap of
   fixed size. Documents whose chunks miss the bitmap are done: nothing of them repeats.
2. The other documents are written once to the shared folder under row keys. Map tasks
   collapse equal chunks of a bounded window, so that a chunk which a third of all rows
   share is a few entries; owner tasks stream the entries in hash order and compare bytes
   with every text of the chain, hot ones in two steps, as in exact_dedup.py.
3. Removals come back by row key, not by chunk.

Null texts stay null, empty ones empty; very long texts are chunked whole. Rows with equal
doc_id, repeated rows too, are ordered by where they were read; a null doc_id comes last.
All columns of the input are returned, in a struct until then, so names can't clash; a
`counted` name that is a column already is refused. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exact_dedup import HOT, classes
from .shared import Scratch, bitmap, in_bitmap, packed, signed, slices, unpacked

MIN_LINES, MAX_LINES, DIVISOR, LONG = 2, 32, 2, 96
#: Odd multipliers of the rolling hash.
MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LAST = (1 << 63) - 1


def chunks(body: bytes) -> list[bytes]:
    """The chunks of a text; joined by line feeds they give it back."""
    lines = body.split(b"\n")
    out, start, before = [], 0, 0

    def cut(stop: int) -> None:
        nonlocal start
        if start < stop:
            out.append(b"\n".join(lines[start:stop]))
            start = stop

    for i, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line)
        rolled = (before * MUL[0] + h * MUL[1]) & 0xFFFFFFFFFFFFFFFF
        if len(line) >= LONG:
            cut(i)
            cut(i + 1)
        elif (n := i + 1 - start) >= MAX_LINES or n >= MIN_LINES and (rolled >> 32) % DIVISOR == 0:
            cut(i + 1)
        before = h
    if 0 < len(lines) - start < MIN_LINES and out and b"\n" in out[-1]:
        out[-1] += b"\n" + b"\n".join(lines[start:])
    else:
        cut(len(lines))
    return out


def _hash(chunk: bytes) -> int | None:
    """The hash of a chunk that is removed where it repeats."""
    return xxhash.xxh64_intdigest(chunk) if (len(chunk) >= LONG or b"\n" in chunk) and chunk.strip() else None


def _bytes(t: str | None) -> bytes:
    return (t or "").encode("utf-8", "surrogatepass")


def _all_hashes(batches):
    for b in slices(batches):
        hs = [signed(h) for t in b.column("text").to_pylist() for c in chunks(_bytes(t)) if (h := _hash(c)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64())], names=["h"])


def _hits(t: str | None, table: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(number, hash, chunk) of the chunks that may occur again."""
    found = [(k, h, c) for k, c in enumerate(chunks(_bytes(t))) if (h := _hash(c)) is not None]
    if not found:
        return []
    ok = in_bitmap(table, np.array([x[1] for x in found], np.uint64))
    return [x for x, o in zip(found, ok.tolist()) if o]


def _sieve(table, want: bool):
    """Rows with (or without) a chunk in the bitmap; with one, under row keys."""

    def run(batches):
        key = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            mask = pa.array([bool(_hits(t, table.value)) is want for t in b.column("text").to_pylist()])
            b = b.filter(mask)
            if want:
                keys = pa.array(range(key, key + b.num_rows), pa.int64())
                key += b.num_rows
                b = pa.RecordBatch.from_arrays([keys, *b.columns], names=["key", *b.schema.names])
            yield b

    return run


OCC = "gid long, key long, no int, first boolean, h long, n long, top long, body binary"
_OCC = pa.schema([("gid", pa.int64()), ("key", pa.int64()), ("no", pa.int32()), ("first", pa.bool_()), ("h", pa.int64()), ("n", pa.int64()), ("top", pa.int64()), ("body", pa.binary())])


def _occurrences(table, window_bytes: int):
    """One row per chunk that may repeat; the first row of equal ones of a window has the bytes."""

    def run(batches):
        gid = TaskContext.get().partitionId() << 34
        for b in slices(batches, window_bytes):
            groups: dict[bytes, list] = {}
            for i, key, t in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist()):
                for no, h, c in _hits(t, table.value):
                    groups.setdefault(c, [h]).append((LAST if i is None else i, key, no))
            rows = []
            for k, (c, (h, *where)) in enumerate(groups.items()):
                first = min(where)
                # the owner keeps the largest top, so the smallest id is the largest here
                rows += [(gid + k, key, no, w == first, *((signed(h), len(where), ~first[0], c) if w == first else (None,) * 4)) for w in where for _, key, no in [w]]
            gid += len(groups)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OCC.types)] if rows else [pa.array([], t) for t in _OCC.types], schema=_OCC)

    return run


def _apply(batches):
    for b in slices(batches):
        texts, removed_lines = [], []
        for t, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
            n = 0
            if gone:
                cs, out = chunks(_bytes(t)), set(gone)
                n = sum(c.count(b"\n") + 1 for k, c in enumerate(cs) if k in out)
                t = b"\n".join(c for k, c in enumerate(cs) if k not in out).decode("utf-8", "surrogatepass")
            texts.append(t)
            removed_lines.append(n)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(removed_lines, pa.int64())], names=["row", "text", "removed_lines"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counted: str | None = None, window_bytes: int = 8 << 20, hot: int = HOT) -> DataFrame:
    """docs with repeated chunks removed from the text; `counted` names a column for the lines removed."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    if counted in docs.columns:
        raise ValueError(f"{counted} is a column already")
    rows = packed(docs, id_col, text_col)
    shape = rows.schema

    every = rows.select("text").mapInArrow(_all_hashes, "h long")
    table = spark.sparkContext.broadcast(bitmap(every.groupBy("h").count().where("count > 1")))
    clear = rows.mapInArrow(_sieve(table, False), shape)
    mixed = scratch.write(rows.mapInArrow(_sieve(table, True), T.StructType([T.StructField("key", T.LongType()), *shape.fields])), "mixed")

    occ = scratch.write(mixed.select("doc_id", "key", "text").mapInArrow(_occurrences(table, window_bytes), OCC), "occurrences", "lz4")
    heads = occ.where("h is not null").select("gid", "h", "n", "top", "body")
    found = classes(heads, lambda rows: rows.repartition("h").sortWithinPartitions("h"), scratch, hot)
    gone = occ.select("gid", "key", "no", "first").join(found, "gid").where("not (first and gid = keep_gid)")
    lists = gone.groupBy("key").agg(F.collect_list("no").alias("gone"))
    changed = mixed.join(lists, "key", "left").select("row", "text", "gone")
    done = changed.mapInArrow(_apply, T.StructType([shape["row"], shape["text"], T.StructField("removed_lines", T.LongType())]))
    whole = clear.select("row", "text", F.lit(0).cast("long").alias("removed_lines")).unionByName(done)
    return unpacked(whole, docs, text_col, *([F.col("removed_lines").alias(counted)] if counted else []))
