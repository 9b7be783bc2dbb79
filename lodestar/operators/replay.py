"""Recovery as a query, and automatic ids for bulk writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def replay(log: DataFrame, snapshot: DataFrame | None = None, after: int = -1) -> DataFrame:
    """Live records (id, vector, metadata, pos) of an operation log over a snapshot.

    The last operation of an id decides; operations up to `after` are in the snapshot
    already. pos is the sequence number of the first put since the id's last delete, or
    the snapshot's pos where the log has no delete of it. Replaying a log twice changes
    nothing. See merge() for what moves.
    """
    if snapshot is not None:
        return merge(log, snapshot, after).select("id", "vector", "metadata", "pos")
    puts = _puts(_last(log, after)).join(_began(log, after), "id")
    return puts.select("id", "vector", "metadata", F.col("began").alias("pos"))


def _ops(log: DataFrame, after: int) -> DataFrame:
    return log.where((F.col("seq") > after) & F.col("op").isin("put", "delete"))


def _last(log: DataFrame, after: int) -> DataFrame:
    """id, last: one aggregation with map-side partials, so a hot id is no hot task."""
    return _ops(log, after).groupBy("id").agg(F.max_by(F.struct("op", "vector", "metadata"), "seq").alias("last"))


def _puts(last: DataFrame) -> DataFrame:
    return last.where("last.op = 'put'").select("id", "last.vector", "last.metadata")


def _began(log: DataFrame, after: int) -> DataFrame:
    """id, began, anew: the first put since the last delete, and whether there was a delete. Only numbers are joined."""
    ops = _ops(log, after).select("id", "op", "seq")
    gone = ops.where("op = 'delete'").groupBy("id").agg(F.max("seq").alias("gone"))
    since = ops.where("op = 'put'").join(gone, "id", "left").where("gone is null or seq > gone")
    return since.groupBy("id").agg(F.min("seq").alias("began"), F.max(F.col("gone").isNotNull()).alias("anew"))


def merge(log: DataFrame, snapshot: DataFrame, after: int, small: bool = False, pos: bool = True) -> DataFrame:
    """Rows of the snapshot that the log does not name, and the live puts of the log (with nulls in other columns).

    Only the log is aggregated; the snapshot is filtered by the ids in the log. small: the
    log is known to be small, so that its ids go to the tasks that scan the snapshot and no
    vector of the snapshot moves. Without pos the snapshot is read once.
    """
    last = _last(log, after)
    ids = last.select("id")
    old = snapshot.join(F.broadcast(ids) if small else ids, "id", "left_anti")
    puts = _puts(last)
    if pos:
        began = _began(log, after)
        named = snapshot.select("id", F.col("pos").alias("held")).join(F.broadcast(ids) if small else ids, "id", "left_semi")
        puts = puts.join(began, "id").join(named, "id", "left")
        puts = puts.select("id", "vector", "metadata", F.when(F.col("anew"), F.col("began")).otherwise(F.coalesce("held", "began")).alias("pos"))
    else:
        old = old.drop("pos")
    return old.unionByName(puts, allowMissingColumns=True)


def assign_ids(rows: DataFrame, next_id: int, block: int = 1_000_000) -> DataFrame:
    """Fill null ids of a batch (ordinal, id, ...) as one write after another would.

    A given id e lifts the counter to e + 1; a missing one takes the counter. With a = the
    number of missing ids before a row, its id is a + max(next_id, e + 1 - a') over the
    given ids before it, a' counted at each of them. Both run within blocks of ordinals; a
    row per block carries what went before into it.
    """
    ahead = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    inside, blocks = ahead(W.partitionBy("block_").orderBy("ordinal")), ahead(W.orderBy("block_"))
    missing = F.col("id").isNull().cast("long")
    local = rows.withColumn("block_", F.floor(F.col("ordinal") / block)).withColumn("a_", F.coalesce(F.sum(missing).over(inside), F.lit(0)))
    lifted = F.col("id") + 1 - F.col("a_")
    sums = local.groupBy("block_").agg(F.sum(missing).alias("k"), F.max(lifted).alias("top"))
    before = sums.select("block_", "top", F.coalesce(F.sum("k").over(blocks), F.lit(0)).alias("before_"))  # a row per block
    before = before.select("block_", "before_", F.max(F.col("top") - F.col("before_")).over(blocks).alias("floor_"))
    met = local.join(before, "block_")
    here = F.max(F.col("id") + 1 - F.col("a_")).over(inside) - F.col("before_")
    counter = F.greatest(F.lit(next_id), F.col("floor_"), here)  # nulls don't count
    return met.withColumn("id", F.coalesce("id", F.col("before_") + F.col("a_") + counter)).drop("block_", "a_", "before_", "floor_")


def last_of_each(rows: DataFrame) -> DataFrame:
    """Of rows with one id, the one with the highest ordinal."""
    rest = [c for c in rows.columns if c not in ("id", "ordinal")]
    best = rows.groupBy("id").agg(F.max_by(F.struct(*rest), "ordinal").alias("r"), F.max("ordinal").alias("ordinal"))
    return best.select("ordinal", "id", *[F.col(f"r.{c}").alias(c) for c in rest])
