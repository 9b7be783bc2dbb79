"""A stored collection: Parquet snapshot generations, operation files and a manifest.

    <root>/<name>/manifest.json           the commit point, replaced conditionally
    <root>/<name>/snapshots/gen=<n>/      a full live state, immutable, sorted by id
    <root>/<name>/oplog/<first>-<uuid>    operations with seq from <first>: a file or a folder

A file that the manifest does not list was never committed and is removed at open. A listed
file that is missing or damaged is corruption and raises: files of single operations have a
CRC-32, folders the number of their rows. What a checkpoint replaces is kept for a while, so
that readers that began before can finish. Reading is a query: the snapshot without the ids
that the log names, and the log's own records.
"""

from __future__ import annotations

import io
import json
import shutil
import time
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorruptError
from ..functions.checks import crc32
from ..functions.vector import l2_norm
from ..operators.replay import merge, replay
from .objects import LocalStorage

FORMAT = 1
#: A log of at most so many operations is folded and its ids are sent to the tasks that scan the snapshot.
SMALL_LOG = 100_000
#: Files of single operations that are merged into one.
COMPACT = 64
VECTOR = T.ArrayType(T.FloatType(), True)
OPLOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("id", T.LongType()), T.StructField("vector", VECTOR), T.StructField("metadata", T.StringType())])
SNAPSHOT = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", VECTOR), T.StructField("norm", T.FloatType()), T.StructField("metadata", T.StringType()), T.StructField("v", T.VariantType()), T.StructField("pos", T.LongType())])
_OPLOG = pa.schema([("seq", pa.int64()), ("op", pa.string()), ("id", pa.int64()), ("vector", pa.list_(pa.float32())), ("metadata", pa.string())])


@dataclass
class Manifest:
    dim: int
    format: int = FORMAT
    version: int = 0
    next_id: int = 1
    next_seq: int = 0
    generation: int | None = None
    records: int = 0
    watermark: int = -1
    dropped: bool = False
    log: list[dict[str, Any]] = field(default_factory=list)
    retired: list[dict[str, Any]] = field(default_factory=list)

    def dump(self) -> bytes:
        return json.dumps(asdict(self), indent=1).encode()

    @classmethod
    def load(cls, data: bytes) -> Manifest:
        try:
            found = cls(**json.loads(data))
        except (ValueError, TypeError) as e:
            raise CorruptError(f"manifest: {e}") from None
        if found.format != FORMAT or found.dim < 1:
            raise CorruptError(f"manifest: format {found.format}, dim {found.dim}")
        if found.log and any(b["first"] != a["last"] + 1 for a, b in zip(found.log, found.log[1:])):
            raise CorruptError("manifest: operations are not contiguous")
        return found


class StoredCollection:
    """One collection on disk and the operations that are not yet files."""

    def __init__(self, spark: SparkSession, store: LocalStorage, name: str, manifest: Manifest, version: str | None, retain: float = 600.0):
        self.retain = retain
        self.spark, self.store, self.name = spark, store, name
        self.manifest, self.version = manifest, version
        self.buffer: list[tuple] = []

    @classmethod
    def create(cls, spark: SparkSession, store: LocalStorage, name: str, dim: int, retain: float = 600.0) -> StoredCollection:
        before = store.get(f"{name}/manifest.json")
        made = cls(spark, store, name, Manifest(dim), before and before[1], retain)
        if before:  # a dropped collection leaves its tombstone
            made.manifest.version = Manifest.load(before[0]).version + 1
        made.commit()
        return made

    @classmethod
    def open(cls, spark: SparkSession, store: LocalStorage, name: str, retain: float = 600.0) -> StoredCollection | None:
        found = store.get(f"{name}/manifest.json")
        if found is None:
            return None
        got = cls(spark, store, name, Manifest.load(found[0]), found[1], retain)
        if got.manifest.dropped:
            return None
        now = time.time()
        got.manifest.retired = [r for r in got.manifest.retired if now - r["at"] < retain]
        got.sweep()
        got.verify()
        return got

    def commit(self) -> None:
        self.manifest.version += 1
        self.version = self.store.put_if_version(f"{self.name}/manifest.json", self.manifest.dump(), self.version)

    def path(self, *parts: str) -> str:
        """For Spark: with its scheme, so that data and manifest are on one file system whatever the default is."""
        return "/".join([f"file://{self.store.root}", self.name, *parts])

    def sweep(self) -> None:
        """Remove what no manifest names: the remains of writes that were not committed, and what was retired long ago."""
        kept = self.manifest.retired
        listed = {x["file"] for x in self.manifest.log} | {f for r in kept for f in r["files"]}
        generations = {self._generation(n) for n in (self.manifest.generation, *(r["generation"] for r in kept))}
        logs, snaps = self.store.root / self.name / "oplog", self.store.root / self.name / "snapshots"
        for p in logs.iterdir() if logs.exists() else ():
            if p.name not in listed:
                shutil.rmtree(p) if p.is_dir() else p.unlink()
        for p in snaps.iterdir() if snaps.exists() else ():
            if p.name not in generations:
                shutil.rmtree(p)

    def verify(self) -> None:
        """Every listed file is there, and every small one has its checksum."""
        for x in self.manifest.log:
            p = self.store.root / self.name / "oplog" / x["file"]
            if not p.exists():
                raise CorruptError(f"{self.name}: {x['file']} is missing")
            if x["crc32"] is None:
                self._check_rows(p, x["rows"])
            elif crc32(p.read_bytes()) != x["crc32"]:
                raise CorruptError(f"{self.name}: {x['file']} fails its checksum")
        if (g := self.manifest.generation) is not None:
            self._check_rows(self.store.root / self.name / "snapshots" / self._generation(g), self.manifest.records)

    def _check_rows(self, folder: Path, rows: int) -> None:
        """A finished folder of Parquet files holds so many rows, by the files' footers."""
        try:
            found = sum(pq.read_metadata(p).num_rows for p in folder.glob("*.parquet"))
        except (OSError, pa.ArrowException) as e:
            raise CorruptError(f"{self.name}: {folder.name}: {e}") from None
        if found != rows or not (folder / "_SUCCESS").exists():
            raise CorruptError(f"{self.name}: {folder.name} has {found} rows; the manifest says {rows}")

    @staticmethod
    def _generation(n: int | None) -> str:
        return f"gen={n or 0:08d}" if n is not None else ""

    # writing

    def append(self, op: str, id: int, vector: list[float] | None, metadata: str | None) -> None:
        self.buffer.append((self.manifest.next_seq, op, id, vector, metadata))
        self.manifest.next_seq += 1

    def flush(self) -> None:
        """Write the buffered operations as one file and commit it; many small files become one."""
        if not self.buffer:
            return
        rows, old = self.buffer, []
        table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _OPLOG.types)], schema=_OPLOG)
        tail = self.manifest.log[-COMPACT:]
        if len(tail) == COMPACT and all(x["crc32"] is not None and x["rows"] < COMPACT for x in tail):
            old = tail
            table = pa.concat_tables([*(pq.read_table(self.store.root / self.name / "oplog" / x["file"], schema=_OPLOG) for x in old), table])
        out = io.BytesIO()
        pq.write_table(table, out)
        first, last = (old[0] if old else {"first": rows[0][0]})["first"], rows[-1][0]
        file = f"{first:020d}-{uuid.uuid4().hex}.parquet"
        self.store.put(f"{self.name}/oplog/{file}", out.getvalue())
        log = self.manifest.log[: len(self.manifest.log) - len(old)]
        self.manifest.log = [*log, {"file": file, "first": first, "last": last, "rows": table.num_rows, "crc32": crc32(out.getvalue())}]
        if old:
            self.retire(None, [x["file"] for x in old])
        self.commit()
        self.buffer = []

    def append_frame(self, rows: DataFrame, n: int, next_id: int) -> None:
        """Write a bulk of operations (ordinal from 0 without gaps, id, vector, metadata, perhaps op) as one committed folder."""
        self.flush()
        first = self.manifest.next_seq
        file = f"{first:020d}-{uuid.uuid4().hex}"
        op = F.col("op") if "op" in rows.columns else F.lit("put")
        out = rows.select((F.col("ordinal") + first).cast("long").alias("seq"), op.alias("op"), "id", F.col("vector").cast(VECTOR).alias("vector"), "metadata")
        out.write.parquet(self.path("oplog", file))
        self._check_rows(self.store.root / self.name / "oplog" / file, n)
        self.manifest.log.append({"file": file, "first": first, "last": first + n - 1, "rows": n, "crc32": None})
        self.manifest.next_seq, self.manifest.next_id = first + n, max(self.manifest.next_id, next_id)
        self.commit()

    def retire(self, generation: int | None, files: list[str]) -> None:
        """Keep replaced files until readers that may still use them are done."""
        now = time.time()
        self.manifest.retired = [r for r in self.manifest.retired if now - r["at"] < self.retain]
        if self.retain > 0:
            self.manifest.retired.append({"generation": generation, "files": files, "at": now})

    def checkpoint(self) -> None:
        """Write a new snapshot generation and retire the log that it holds and the generation before."""
        self.flush()
        if self.manifest.watermark == self.manifest.next_seq - 1 and (self.manifest.generation is not None or self.manifest.next_seq == 0):
            return
        m = self.manifest
        generation = max([m.generation or 0, *(r["generation"] or 0 for r in m.retired)]) + 1
        state = self.live().repartitionByRange("id").sortWithinPartitions("id")
        path = self.path("snapshots", self._generation(generation))
        state.write.mode("overwrite").parquet(path)
        records = self.spark.read.schema(SNAPSHOT).parquet(path).count()
        self.retire(m.generation, [x["file"] for x in m.log])
        m.records, m.generation, m.watermark, m.log = records, generation, m.next_seq - 1, []
        self.commit()
        self.sweep()

    def drop(self) -> None:
        """Tombstone first: a crash half-way leaves a dropped collection."""
        self.manifest.dropped, self.manifest.log, self.manifest.retired, self.manifest.generation = True, [], [], None
        self.buffer = []
        self.commit()
        for kind in ("snapshots", "oplog"):
            shutil.rmtree(self.store.root / self.name / kind, ignore_errors=True)

    # reading

    def snapshot(self) -> DataFrame | None:
        if self.manifest.generation is None:
            return None
        return self.spark.read.schema(SNAPSHOT).parquet(self.path("snapshots", self._generation(self.manifest.generation)))

    def log(self) -> DataFrame | None:
        parts = [self.path("oplog", x["file"]) for x in self.manifest.log]
        found = self.spark.read.schema(OPLOG).parquet(*parts) if parts else None
        if self.buffer:  # read your own writes
            own = self.spark.createDataFrame(self.buffer, OPLOG)
            found = own if found is None else found.unionByName(own)
        return found

    def live(self, pos: bool = True) -> DataFrame:
        """Live records: id, vector, norm, metadata, v, and pos where it is asked for. Without a log tail this is the bare snapshot scan."""
        snapshot, log = self.snapshot(), self.log()
        if log is None:
            found = snapshot if snapshot is not None else self.spark.createDataFrame([], SNAPSHOT)
            return found if pos else found.drop("pos")
        self.spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        if snapshot is None:
            state = replay(log, None, self.manifest.watermark).withColumns({"norm": F.lit(None).cast("float"), "v": F.lit(None).cast("variant")})
            state = state if pos else state.drop("pos")
        else:
            state = merge(log, snapshot, self.manifest.watermark, self.manifest.next_seq - 1 - self.manifest.watermark <= SMALL_LOG, pos)
        # stored norms and variants stay; only the log's records get theirs here
        norm, v = F.coalesce("norm", l2_norm(F.col("vector"))), F.coalesce("v", F.parse_json("metadata"))
        return state.select("id", "vector", norm.alias("norm"), "metadata", v.alias("v"), *(["pos"] if pos else []))

    def find(self, id: int) -> tuple[list[float], str] | None:
        """Vector and metadata of one record: from the buffer, else from the log, else from the files of the snapshot that may hold it."""
        for _, op, i, vector, metadata in reversed(self.buffer):
            if i == id:
                return (np.array(vector, np.float32).tolist(), metadata) if op == "put" else None
        same = F.col("id") == F.lit(id)
        if self.manifest.log:
            log = self.spark.read.schema(OPLOG).parquet(*[self.path("oplog", x["file"]) for x in self.manifest.log])
            last = log.where(same & (F.col("seq") > self.manifest.watermark)).agg(F.max_by(F.struct("op", "vector", "metadata"), "seq").alias("last")).first()["last"]
            if last is not None:
                return (last["vector"], last["metadata"]) if last["op"] == "put" else None
        snapshot = self.snapshot()
        row = snapshot.where(same).select("vector", "metadata").head() if snapshot is not None else None
        return (row["vector"], row["metadata"]) if row else None

    def check_snapshot(self) -> None:
        """Deep validation of the snapshot: count, vector lengths, unique ids."""
        snap = self.snapshot()
        if snap is None:
            return
        r = snap.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count(F.when(F.size("vector") != self.manifest.dim, 1)).alias("bad")).first()
        if r["n"] != self.manifest.records or r["ids"] != r["n"] or r["bad"]:
            raise CorruptError(f"{self.name}: snapshot has {r['n']} rows, {r['ids']} ids, {r['bad']} vectors of another length; the manifest says {self.manifest.records}")


