"""Token counts per document through the compiled transducers of transducer.py.

Null and empty texts have no bytes and no tokens. Rows are counted one by one, so ties,
repeated rows and repeated ids need no rule; an empty table gives an empty result. A very
long text, one unbroken run included, is read byte by byte in bounded memory. Other columns
are not read, so their names can't clash.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, slices
from .transducer import merger


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; path names a byte-level BPE vocabulary file."""

    def run(batches):
        machine = merger(path)
        for b in slices(batches, 4 << 20):
            text = b.column("text")
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(machine.counts(text.to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
