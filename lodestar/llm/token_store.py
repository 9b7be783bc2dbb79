"""Token-id files: tokenize, write range-coded frames in doc_id order, read them back.

Format: Parquet files of frames. A frame holds whole documents: their ids and lengths in
tokens, the tables that its blocks start from, the coded blocks of `block_length` ids (see
range_coder.py) and a CRC-32 for each block. Files are ranges of doc_id, frames follow one
another inside a file, so (file, frame) is the order of the ids. Spark's commit protocol
leaves no half-written file when an executor is lost.

Null texts are empty and hold the end id alone. Rows with equal doc_id follow the XXH64 of
their text, and nulls come first; equal rows are written each. A very long text is a frame
of its own size. Other columns are not read, so their names can't clash. An empty table
gives empty files and an empty result.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .range_coder import decode, encode
from .shared import Scratch, documents, slices, trim
from .transducer import Spans, byte_alphabet, specials_of
from .words import IdTable

STOP = "\0"
FRAME = "file int, frame int, n_ids long, doc_ids array<long>, lengths array<long>, block_length int, tables binary, blocks array<binary>, checksums array<long>"
_FRAME = pa.schema([("file", pa.int32()), ("frame", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("block_length", pa.int32()), ("tables", pa.binary()), ("blocks", pa.list_(pa.binary())), ("checksums", pa.list_(pa.int64()))])
_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class WordIds:
    """Ids by the tokenizers library, asked once for each pretoken that is not in the table.

    Pretokens are tokenized independently of one another, so a text's ids are those of its
    pretokens side by side. The table is emptied over a limit; that changes no id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        if whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids must be below 65536")
        # the same model, for pretokens: nothing is left to look for. The library is quickest with many
        # in one string; they end in a byte that takes part in no merge
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.single, self.many = Tokenizer(whole.model), Tokenizer(whole.model)
        self.single.pre_tokenizer = as_bytes
        self.many.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(STOP, "merged_with_previous"), as_bytes])
        stop = next(c for c, b in byte_alphabet().items() if b == ord(STOP))
        self.stop = whole.token_to_id(stop) if not any(stop in t and t != stop for t in whole.get_vocab()) else None
        self.specials = specials_of(path)
        self.known = IdTable(self.ask, list(self.specials.values()), most=1_400_000)

    def ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has."""
        plain = self.stop is not None and not any(STOP in w for w in words)
        flat = []
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            if plain:
                flat.append(np.array(self.many.encode_batch_fast([STOP.join(part) + STOP], add_special_tokens=False)[0].ids, np.uint16))
            else:
                for e in self.single.encode_batch_fast(part, add_special_tokens=False):
                    flat.append(np.array(e.ids, np.uint16))
        if not plain:
            return np.concatenate([np.zeros(0, np.uint16), *flat]), np.fromiter(map(len, flat), np.int64, len(flat))
        every = np.concatenate([np.zeros(0, np.uint16), *flat])
        stops = np.flatnonzero(every == self.stop)
        return np.delete(every, stops), np.diff(stops, prepend=-1) - 1

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, and the number of ids of each."""
        return self.known.ids(Spans(texts, list(self.specials)), end_id)


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def write_tokens(docs: DataFrame, path: str, scratch: Scratch, end_id: int = 0, frame_ids: int = 4 << 20, block_ids: int = 1024) -> DataFrame:
    """Write the frames of documents (doc_id, text) in doc_id order; returns them as read back."""

    def run(batches):
        table = word_ids(path)
        file, frame = TaskContext.get().partitionId(), 0
        ids, lengths, held, size = [], [], [], 0

        def flush():
            stream = np.concatenate(held)
            tables, blocks, crcs = encode(stream, block_ids)
            row = {"file": file, "frame": frame, "n_ids": len(stream), "doc_ids": ids, "lengths": lengths, "block_length": block_ids, "tables": tables, "blocks": blocks, "checksums": crcs}
            return pa.RecordBatch.from_pylist([row], schema=_FRAME)

        for b in slices(batches, 2 << 20):
            coded, n = table.encode(b.column("text").to_pylist(), end_id)
            ids += b.column("doc_id").to_pylist()
            lengths += n.tolist()
            held.append(coded)
            size += len(coded)
            if size >= frame_ids:
                yield flush()
                ids, lengths, held, size, frame = [], [], [], 0, frame + 1
        if ids:
            yield flush()

    keyed = docs.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return scratch.write(ordered.mapInArrow(run, FRAME), "frames", "uncompressed")


def read_tokens(frames: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def run(batches):
        word_ids.cache_clear()  # a worker that has written before needs its table no more
        trim()
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                ids = decode(r["n_ids"], r["block_length"], r["tables"], r["blocks"], r["checksums"]).astype("<u4")
                stops = np.cumsum([0, *r["lengths"]])
                crcs = [zlib.crc32(ids[a:z]) for a, z in zip(stops.tolist(), stops[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(stops[:-1] + r["before"], pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array(crcs, pa.int64())], schema=_DOC)

    files = frames.groupBy("file").agg(F.sum("n_ids").alias("n"))
    files = files.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("base"))  # a row per file
    sizes = frames.select("file", "frame", "n_ids")
    inside = sizes.select("file", "frame", (F.sum("n_ids").over(W.partitionBy("file").orderBy("frame")) - F.col("n_ids")).alias("within"))
    before = inside.join(files, "file").select("file", "frame", (F.col("base") + F.col("within")).alias("before"))
    # a row of three numbers per frame of some million ids; where these are many, the frames move instead
    small = frames.count() <= 200_000
    return frames.join(F.broadcast(before) if small else before, ["file", "frame"]).drop("file", "frame").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write token files of docs and read them back: doc_id, start, n_tokens, ids_crc32."""
    scratch = Scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(documents(docs, id_col, text_col), path, scratch, end_id))
