"""Command line: lodestar --db DIR COMMAND ...; JSON on stdout, errors on stderr."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .config import DbConfig, SyncMode
from .database import Database
from .errors import LodestarError
from .functions.checks import load_json, parse_metadata, parse_vector
from .operators.search import DEFAULT_TOP_K, Query


def record(row: Any) -> dict[str, Any]:
    return {"id": row["id"], "vector": list(row["vector"]), "metadata": load_json(row["metadata"])}


def create(db: Database, a: argparse.Namespace) -> dict[str, Any]:
    db.create_collection(a.name, a.dim)
    return {"ok": True, "collection": a.name, "dim": a.dim}


def drop(db: Database, a: argparse.Namespace) -> dict[str, Any]:
    db.drop_collection(a.name)
    return {"ok": True, "dropped": a.name}


def list_(db: Database, a: argparse.Namespace) -> dict[str, Any]:
    keys = ("name", "dim", "records", "wal_frames", "ops_since_snapshot")
    return {"collections": [{k: s[k] for k in keys} for s in map(db.stats, db.list_collections())]}


def info(db: Database, a: argparse.Namespace) -> dict[str, Any]:
    return db.stats(a.name)


def insert(db: Database, a: argparse.Namespace) -> dict[str, Any]:
    vector, metadata, id = parse_vector(a.vector), parse_metadata(a.metadata), a.id
    if id is None:
        id = db.add(a.name, vector, metadata)
    else:
        db.insert(a.name, id, vector, metadata)
    return {"ok": True, "collection": a.name, "id": id}


def get(db: Database, a: argparse.Namespace) -> dict[str, Any]:
    found = db.get(a.name, a.id)
    return {"ok": True, "record": record(found)} if found else {"ok": False, "reason": "not found"}


def delete(db: Database, a: argparse.Namespace) -> dict[str, Any]:
    return {"ok": True, "deleted": db.delete(a.name, a.id)}


def records(db: Database, a: argparse.Namespace) -> dict[str, Any]:
    return {"records": [record(r) for r in db.all_records(a.name).toLocalIterator()]}


def hits(found: DataFrame) -> list[dict[str, Any]]:
    return [{"id": r["id"], "score": r["score"], "record": record(r)} for r in found.collect()]


def query(db: Database, a: argparse.Namespace) -> dict[str, Any]:
    q = Query(a.name, parse_vector(a.vector)).top_k(a.top_k)
    found = hits(db.query(q.filter(a.filter) if a.filter else q))
    return {"collection": a.name, "hits": found, "count": len(found)}


def checkpoint(db: Database, a: argparse.Namespace) -> dict[str, Any]:
    if a.name is None:
        return {"ok": True, "snapshotted": db.checkpoint_all()}
    db.checkpoint(a.name)
    return {"ok": True, "snapshotted": [a.name]}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestar", description="Vector collections on Spark.")
    top.add_argument("--db", default="./lodestar-data")
    sync = top.add_mutually_exclusive_group()
    sync.add_argument("--no-sync", action="store_true", help="write operations at the end only")
    sync.add_argument("--batch", type=int, help="write operations in batches of this size")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *, named: bool | None = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        if named is not False:
            p.add_argument("name", nargs="?" if named is None else None)
        return p

    command("create", create).add_argument("--dim", type=int, required=True)
    command("drop", drop)
    command("list", list_, named=False)
    command("info", info)
    p = command("insert", insert)
    p.add_argument("--vector", required=True)
    p.add_argument("--metadata", default="")
    p.add_argument("--id", type=int)
    command("get", get).add_argument("id", type=int)
    command("delete", delete).add_argument("id", type=int)
    command("records", records)
    p = command("query", query)
    p.add_argument("--vector", required=True)
    p.add_argument("-t", "--top-k", type=int, default=DEFAULT_TOP_K)
    p.add_argument("--filter")
    command("checkpoint", checkpoint, named=None)
    return top


def config(a: argparse.Namespace) -> DbConfig:
    made = DbConfig(a.db)
    if a.no_sync:
        return made.with_sync_mode(SyncMode.NEVER)
    return made.with_sync_mode(SyncMode.BATCH, a.batch) if a.batch else made


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestar").config("spark.ui.enabled", "false").getOrCreate()
    try:
        with Database(spark, config(a)) as db:
            out = a.run(db, a)
        print(json.dumps(out, indent=2, ensure_ascii=False))
        return 0
    except (LodestarError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
