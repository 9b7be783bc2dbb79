"""Shared-folder tables and small Arrow helpers used by the operators of this package.

Tables that an operator needs twice, or that must outlive a lost executor, are
written once as Parquet under the folder named by ``spark.checkpoint.dir`` and
read back; nothing is kept in executor-local storage.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Batches to and from Python are cut by bytes, so long texts don't add up in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


class Scratch:
    """Tables of one operator run in the shared folder; removed when the JVM ends, or by drop() and clear()."""

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        bounded(spark)
        self.made.append(self)
        self.spark = spark
        self.base = f"{shared_root(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
        self._fs(self.base)[0].deleteOnExit(self._fs(self.base)[1])

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write df once and return it as read from the shared folder."""
        path = f"{self.base}/{name}"
        df.write.option("compression", codec).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        fs, p = self._fs(f"{self.base}/{name}" if name else self.base)
        fs.delete(p, True)

    @classmethod
    def clear(cls, since: int = 0) -> None:
        """Remove the tables of all runs but the first `since`; for callers that have written all results."""
        while len(cls.made) > since:
            cls.made.pop().drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns can't clash."""
    bounded(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, text: all columns but the text in a struct, so that no name can clash and the text travels once."""
    bounded(docs.sparkSession)
    cols = [(F.lit(None).cast(docs.schema[c].dataType) if c == text_col else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(F.struct(*cols).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def unpacked(rows: DataFrame, docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    """The columns of docs out of packed rows, and more."""
    return rows.select(*[(F.col("text") if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)], *more)


def trim() -> None:
    """Give memory that a finished task held back to the system: workers are reused, and stages differ in what they need."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches with a text column into pieces of about max_bytes, one row at least."""
    for b in batches:
        k = b.schema.get_field_index("text")
        if b.num_rows and b.column(k).nbytes > max_bytes:
            step = max(1, int(b.num_rows * max_bytes / b.column(k).nbytes))
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)
        elif b.num_rows:
            yield b
    trim()


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def bitmap(hashes: DataFrame, bits: int = 26) -> np.ndarray:
    """A bitmap over the top bits of 64-bit hashes (h): 2**bits bits, whatever the number of hashes.

    A hash in the table always finds its bit set; others do now and then, so what passes is
    always checked again. At most 2**(bits - 6) words reach the driver.
    """
    x = hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("x"))
    words = x.groupBy(F.shiftright("x", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(x & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def in_bitmap(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) find their bit set."""
    x = h >> np.uint64(64 - (len(table) * 64).bit_length() + 1)
    return (table[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)
