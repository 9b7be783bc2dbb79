"""The database: named collections under one folder, one writer."""

from __future__ import annotations

import os
import socket
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DbConfig, SyncMode
from .errors import CollectionExists, CollectionNotFound, ConflictError, DimMismatch, EmptyVector, ParseError
from .functions.checks import check_id, check_vector, dump_json, validate_name
from .operators.replay import assign_ids
from .operators.search import Query
from .sources.collection import StoredCollection
from .sources.objects import LocalStorage

#: Lock files of the databases that this process has open.
_OPEN: set[str] = set()
RECORD = "ordinal long, id long, vector array<float>, metadata string"


class Database:
    """Use as a context manager; leaving it checkpoints every collection."""

    def __init__(self, spark: SparkSession, config: DbConfig | str):
        self.spark = spark
        self.config = DbConfig(config) if isinstance(config, str) else config
        self.store = LocalStorage(self.config.data_dir)
        self._lock = Path(self.store.root, ".writer")
        self._acquire()
        self._open: dict[str, StoredCollection] = {}
        try:
            for name in self.store.names():
                if found := StoredCollection.open(spark, self.store, name, self.config.retain_seconds):
                    self._open[name] = found
        except BaseException:
            self._release()
            raise

    def _acquire(self) -> None:
        me = f"{socket.gethostname()} {os.getpid()}"
        for _ in range(2):
            try:
                fd = os.open(self._lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(fd, me.encode())
                os.close(fd)
                _OPEN.add(str(self._lock))
                return
            except FileExistsError:
                host, _, pid = self._lock.read_text().rpartition(" ")
                # only of this host it is known which processes live; in this one, which databases are open
                here = host in ("", socket.gethostname())
                lives = str(self._lock) in _OPEN if pid == str(os.getpid()) else Path("/proc", pid or "0").exists()
                if not here or lives:
                    raise ConflictError(f"{self.store.root} is open in process {pid} of {host or 'this host'}") from None
                self._lock.unlink(missing_ok=True)  # its writer is gone
        raise ConflictError(f"{self.store.root} is being opened")

    def _release(self) -> None:
        _OPEN.discard(str(self._lock))
        self._lock.unlink(missing_ok=True)

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _get(self, name: str) -> StoredCollection:
        try:
            return self._open[name]
        except KeyError:
            raise CollectionNotFound(name) from None

    # collections

    def list_collections(self) -> list[str]:
        return sorted(self._open)

    def create_collection(self, name: str, dim: int) -> None:
        validate_name(name)
        if name in self._open:
            raise CollectionExists(name)
        if dim == 0:
            raise EmptyVector
        if not isinstance(dim, int) or not 0 < dim < 1 << 31:
            raise ParseError(f"invalid dimension: {dim!r}")
        self._open[name] = StoredCollection.create(self.spark, self.store, name, dim, self.config.retain_seconds)

    def drop_collection(self, name: str) -> None:
        self._get(name).drop()
        del self._open[name]

    def dim(self, name: str) -> int:
        return self._get(name).manifest.dim

    def stats(self, name: str) -> dict[str, Any]:
        c = self._get(name)
        pending = c.manifest.next_seq - 1 - c.manifest.watermark
        records = c.live(pos=False).count() if pending else c.manifest.records
        return {"name": name, "dim": c.manifest.dim, "records": records, "next_id": c.manifest.next_id, "wal_frames": pending, "ops_since_snapshot": pending}

    # writing

    def insert(self, name: str, id: int, vector: Sequence[float], metadata: Any = None) -> None:
        c = self._get(name)
        check_vector(vector, c.manifest.dim)
        check_id(id)
        c.append("put", id, [float(x) for x in vector], dump_json({} if metadata is None else metadata))
        c.manifest.next_id = max(c.manifest.next_id, id + 1)
        self._after(c)

    def add(self, name: str, vector: Sequence[float], metadata: Any = None) -> int:
        c = self._get(name)
        check_vector(vector, c.manifest.dim)
        id = check_id(c.manifest.next_id)
        self.insert(name, id, vector, metadata)
        return id

    def delete(self, name: str, id: int) -> bool:
        """A missing record is no operation. Costs one lookup, unless the buffer knows the id."""
        c = self._get(name)
        if not 0 <= id < 1 << 63 or c.find(id) is None:
            return False
        c.append("delete", id, None, None)
        self._after(c)
        return True

    def upsert_many(self, name: str, records: Iterable[Mapping[str, Any]], max_batch: int = 1000) -> list[int]:
        """Validate all, then write all as one commit; missing ids are given in order, the last of equal ids wins."""
        c = self._get(name)
        rows = list(records)
        if not 1 <= len(rows) <= max_batch:
            raise ParseError(f"a batch has 1 to {max_batch} records, not {len(rows)}")
        for r in rows:
            if len(r["vector"]) != c.manifest.dim:
                raise DimMismatch(c.manifest.dim, len(r["vector"]))
            if r.get("id") is not None:
                check_id(r["id"])
        held, ids, next_id = [], [], c.manifest.next_id
        for r in rows:
            id = next_id if r.get("id") is None else r["id"]
            next_id = max(next_id, id + 1)
            metadata = {} if r.get("metadata") is None else r["metadata"]
            held.append((check_id(id), [float(x) for x in r["vector"]], dump_json(metadata)))
            ids.append(id)
        for id, vector, metadata in held:
            c.append("put", id, vector, metadata)
        c.manifest.next_id = next_id
        self._after(c, batch=len(held))
        return ids

    def upsert_df(self, name: str, rows: DataFrame) -> None:
        """Bulk upsert of (vector, metadata, and optionally id and ordinal) as one commit.

        Rows without an id need an ordinal, which gives the order of writing; it must run from 0
        without gaps. Given ids for all rows, an ordinal is made in the order of ids. All rows
        are checked before any is written: one bad row refuses the whole.
        """
        self.write_ops(name, rows)

    def write_ops(self, name: str, rows: DataFrame) -> None:
        """upsert_df, where a column op may say "put" or "delete"; a delete needs an id and nothing else."""
        c = self._get(name)
        self.spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        put = F.col("op").eqNullSafe("put") if "op" in rows.columns else F.lit(True)
        shaped = rows.withColumn("metadata", F.coalesce("metadata", F.when(put, "{}")))
        if "id" not in rows.columns:
            shaped = shaped.withColumn("id", F.lit(None).cast("long"))
        size = F.coalesce(F.size("vector"), F.lit(0))
        ordinal = "ordinal" in rows.columns
        found = shaped.agg(
            F.count(F.lit(1)).alias("n"),
            F.first(F.when(put & (size != c.manifest.dim), size), ignorenulls=True).alias("length"),
            F.first(F.when(put & F.exists("vector", lambda x: x.isNull()), "a vector holds a null"), ignorenulls=True).alias("hole"),
            F.first(F.when(put & F.try_parse_json("metadata").isNull(), F.concat(F.lit("metadata is not JSON: "), F.substring("metadata", 1, 80))), ignorenulls=True).alias("json"),
            F.first(F.when(F.col("id") < 0, F.concat(F.lit("negative id: "), F.col("id").cast("string"))), ignorenulls=True).alias("id"),
            F.first(F.when(~put & (F.col("id").isNull() | ~F.col("op").eqNullSafe("delete")), "an operation is neither a put nor a delete of an id"), ignorenulls=True).alias("op")
            if "op" in rows.columns
            else F.lit(None).alias("op"),
            F.count(F.when(F.col("id").isNull(), 1)).alias("nameless"),
            *([F.count_distinct("ordinal").alias("ordinals"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high")] if ordinal else [F.count_distinct("id").alias("ids")]),
        ).first()
        if not (n := found["n"]):
            return
        if found["length"] is not None:
            raise DimMismatch(c.manifest.dim, found["length"])
        for problem in (found["hole"], found["json"], found["id"], found["op"]):
            if problem:
                raise ParseError(problem)
        if ordinal:
            if (found["ordinals"], found["low"], found["high"]) != (n, 0, n - 1):
                raise ParseError(f"ordinals of {n} rows must run from 0 to {n - 1} without gaps")
            if found["nameless"] == n:
                shaped = shaped.withColumn("id", F.col("ordinal") + c.manifest.next_id)
            elif found["nameless"]:
                shaped = assign_ids(shaped, c.manifest.next_id)
        else:
            if found["nameless"]:
                raise ParseError("rows without an id need an ordinal")
            if found["ids"] != n:
                raise ParseError("rows with equal ids need an ordinal")
            shaped = _numbered(shaped, n)
        top = shaped.where(put).agg(F.max("id")).first()[0]
        more = ["op"] if "op" in rows.columns else []
        c.append_frame(shaped.select("ordinal", F.col("id").cast("long").alias("id"), "vector", "metadata", *more), n, (-1 if top is None else top) + 1)
        self._after(c, batch=0)

    def _after(self, c: StoredCollection, batch: int = 1) -> None:
        mode = self.config.sync_mode
        if mode is SyncMode.EVERY or mode is SyncMode.BATCH and len(c.buffer) >= self.config.batch:
            c.flush()
        if c.manifest.next_seq - 1 - c.manifest.watermark >= self.config.auto_snapshot_after:
            c.checkpoint()

    def checkpoint(self, name: str) -> None:
        self._get(name).checkpoint()

    def checkpoint_all(self) -> list[str]:
        for name in self.list_collections():
            self._open[name].checkpoint()
        return self.list_collections()

    def close(self) -> None:
        try:
            self.checkpoint_all()
        finally:
            self._release()

    # reading

    def records(self, name: str, pos: bool = True) -> DataFrame:
        """Live records as a lazy DataFrame; pos (the order of storage) costs a second look at the snapshot where there is a log."""
        return self._get(name).live(pos)

    def all_records(self, name: str, pos: bool = False) -> DataFrame:
        """All records in the order of storage; pos: with their places in it."""
        return self.records(name).orderBy("pos").select("id", "vector", "metadata", *(["pos"] if pos else []))

    def get(self, name: str, id: int) -> dict[str, Any] | None:
        found = self._get(name).find(id) if 0 <= id < 1 << 63 else None
        return {"id": id, "vector": found[0], "metadata": found[1]} if found else None

    def query(self, query: Query) -> DataFrame:
        return query.run(self)

    def pin(self, name: str) -> DataFrame:
        """The records, kept in memory by Spark until unpersist(); never done unasked."""
        return self.records(name).persist()


def _numbered(rows: DataFrame, n: int, block: int = 1_000_000) -> DataFrame:
    """Dense ordinals in the order of ids: approximate quantiles cut the ids into blocks, which are numbered one by one."""
    from pyspark.sql import Window as W

    parts = -(-n // block)
    cuts = rows.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    # blocks go by the id itself, so that both sides of the join agree on them
    bounds = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    keyed = rows.withColumn("block_", F.size(F.filter(bounds, lambda c: c <= F.col("id"))))
    sizes = keyed.groupBy("block_").count()
    base = sizes.select("block_", (F.sum("count").over(W.orderBy("block_")) - F.col("count")).alias("base_"))  # a row per block
    within = F.row_number().over(W.partitionBy("block_").orderBy("id")) - 1
    return keyed.join(base, "block_").withColumn("ordinal", (F.col("base_") + within).cast("long")).drop("block_", "base_")
