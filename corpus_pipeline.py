"""A corpus pipeline: quality, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its
result is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.decontaminate import decontaminate
from lodestar.llm.line_dedup import line_dedup
from lodestar.llm.pieces import encode
from lodestar.llm.quality import quality
from lodestar.llm.shared import Scratch, table
from lodestar.llm.simhash import near_dedup


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    Null and empty texts are scored like any other, very long ones whole; repeated rows are
    scored each and get equal scores; a tie at the threshold is kept. Without labels of both
    classes all rows stay. An empty table gives an empty one.
    """
    return quality(docs, table(spark, sf_dir, "labels")).where("keep").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from all but their first document; n_chars follows.

    Null texts stay null, and n_chars of rows that lose nothing stays what it was. No row goes;
    of repeated rows and of ties the one read first keeps its lines. An empty table gives an
    empty one.
    """
    counted = next(c for k in range(len(docs.columns) + 1) if (c := f"removed_lines_{k}") not in docs.columns)
    found = line_dedup(docs, counted=counted)
    if "n_chars" not in docs.columns:
        return found.select(*docs.columns)
    n = F.when(F.col(counted) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The row with the smallest doc_id stays (nulls last, then the order of reading), one of
    repeated rows, one of all texts without words. Rows are told apart by a key of their own,
    so a repeated doc_id takes no other text with it. An empty table gives an empty one.
    """
    return near_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts stay. Rows of one doc_id, and rows without one, are judged by their
    own texts; repeated rows alike. An empty table, or an empty benchmark, changes nothing.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and SentencePiece ids.

    Null and empty texts have none; every row is encoded, repeated ones too, very long texts
    whole. An empty table gives an empty one.
    """
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_leaks),
    ("pieces", encode_pieces),
]

#: Fitted classifiers, rolling hashes and merges have no SQL; the tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    mine = len(Scratch.made)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        Scratch.clear(mine)  # the stage is written; what it needed on the way is not read again
    return docs
