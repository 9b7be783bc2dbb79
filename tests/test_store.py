import json
import os
import random
import socket
import string
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.config import DbConfig, SyncMode
from lodestar.database import Database, _numbered
from lodestar.errors import CollectionExists, CollectionNotFound, ConflictError, CorruptError, DimMismatch, EmptyVector, EncodingError, ParseError
from lodestar.functions.checks import crc32, parse_metadata, parse_vector, validate_key, validate_name, version_of
from lodestar.operators.replay import assign_ids, replay
from lodestar.operators.search import Query
from lodestar.sources.collection import StoredCollection
from lodestar.sources.objects import LocalStorage, MemoryStorage


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "db")


def state(db, name="c"):
    return {r["id"]: (r["vector"], json.loads(r["metadata"])) for r in db.records(name).collect()}


def crash(db):
    """Leave without checkpoint, as a killed process would."""
    db._release()


def test_crud_and_reopen(spark, root):
    with Database(spark, root) as db:
        db.create_collection("c", 2)
        assert [db.add("c", v, {"cat": "x", "price": i}) for i, v in enumerate([(1, 0), (0.5, 0.5), (0, 1)])] == [1, 2, 3]
        assert db.get("c", 2)["id"] == 2 and db.get("c", 9) is None
        assert db.delete("c", 2) and not db.delete("c", 2)
        assert [r["id"] for r in db.all_records("c").collect()] == [1, 3]
        with pytest.raises(CollectionExists):
            db.create_collection("c", 2)
    with Database(spark, root) as db:
        assert sorted(state(db)) == [1, 3]
        s = db.stats("c")
        assert (s["records"], s["next_id"], s["wal_frames"]) == (2, 4, 0)
        assert [r["id"] for r in db.query(Query("c", [1.0, 0.0]).filter("price >= 0")).collect()] == [1, 3]
        db.drop_collection("c")
    with Database(spark, root) as db:
        assert db.list_collections() == []
        db.create_collection("c", 3)
        assert db.stats("c")["records"] == 0


def test_validation(spark, root):
    with Database(spark, root) as db:
        with pytest.raises(EmptyVector):
            db.create_collection("items", 0)
        db.create_collection("items", 2)
        for call in (lambda: db.add("items", []), lambda: db.query(Query("items", []))):
            with pytest.raises(EmptyVector):
                call()
        for call in (lambda: db.add("items", [1]), lambda: db.query(Query("items", [1.0, 2.0, 3.0])), lambda: db.upsert_many("items", [{"vector": []}])):
            with pytest.raises(DimMismatch):
                call()
        for call in (lambda: db.add("no", [1]), lambda: db.query(Query("no", [])), lambda: db.drop_collection("no"), lambda: db.stats("no")):
            with pytest.raises(CollectionNotFound):
                call()
        with pytest.raises(ParseError):
            db.insert("items", 1 << 63, [1, 2])
        with pytest.raises(EncodingError):
            db.insert("items", 1, [1, 2], {"x": float("nan")})
        with pytest.raises(ParseError):
            db.upsert_many("items", [])


ALLOWED = string.ascii_letters + string.digits + "_-"


@given(st.text(ALLOWED, min_size=1, max_size=64), st.characters().filter(lambda c: c not in ALLOWED), st.integers(0, 64))
@settings(max_examples=200, deadline=None)
def test_names(name, other, at):
    """Names on both sides of the rule: 1 to 64 of the allowed characters."""
    assert validate_name(name) == name
    for wrong in (name[:at] + other + name[at:], (name + name[0] * 64)[:65], name[:0]):
        with pytest.raises(ParseError):
            validate_name(wrong)


def test_names_are_checked(spark, root):
    with Database(spark, root) as db, pytest.raises(ParseError):
        db.create_collection("no/name", 2)


def test_upsert_and_ids(spark, root):
    with Database(spark, root) as db:
        db.create_collection("c", 2)
        db.insert("c", 42, [1, 0], {"v": 1})
        db.insert("c", 42, [0, 1], {"v": 2})
        assert db.add("c", [1, 1]) == 43
        assert state(db)[42] == ([0.0, 1.0], {"v": 2})
        assert db.upsert_many("c", [{"vector": [1, 1]}, {"id": 50, "vector": [2, 2]}, {"vector": [3, 3]}, {"id": 50, "vector": [4, 4], "metadata": {"z": 1}}]) == [44, 50, 51, 50]
        assert state(db)[50] == ([4.0, 4.0], {"z": 1})


@pytest.mark.parametrize("mode", list(SyncMode))
def test_crash_and_sync_modes(spark, root, mode):
    db = Database(spark, DbConfig(root).with_sync_mode(mode, 4))
    db.create_collection("c", 2)
    for i in range(6):
        db.add("c", [i, 1], {"i": i})
    assert len(state(db)) == 6  # own writes are read, flushed or not
    crash(db)
    with Database(spark, root) as db:
        assert len(state(db)) == {SyncMode.EVERY: 6, SyncMode.BATCH: 4, SyncMode.NEVER: 0}[mode]


def test_snapshot_and_log_and_auto_checkpoint(spark, root):
    db = Database(spark, DbConfig(root).with_auto_snapshot_after(5))
    db.create_collection("c", 2)
    for i in range(12):
        db.add("c", [i, 0], {"i": i})
    c = db._open["c"]
    assert c.manifest.generation == 2 and db.stats("c")["ops_since_snapshot"] == 2
    db.delete("c", 3)
    crash(db)
    with Database(spark, root) as db:
        assert sorted(state(db)) == [1, 2, *range(4, 13)]
        assert [r["id"] for r in db.all_records("c").collect()] == [1, 2, *range(4, 13)]
        db.checkpoint("c")
        db._open["c"].check_snapshot()
        plan = db.records("c")._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan  # a bare scan after a checkpoint


def test_uncommitted_files_are_swept_and_damage_is_loud(spark, root, tmp_path):
    db = Database(spark, root)
    db.create_collection("c", 2)
    db.add("c", [1, 0])
    log = tmp_path / "db" / "c" / "oplog"
    (log / "00000000000000000009-torn.parquet").write_bytes(b"PAR1")
    (tmp_path / "db" / "c" / "snapshots" / "gen=00000007").mkdir(parents=True)
    crash(db)
    with Database(spark, root) as db:
        assert len(state(db)) == 1
        db.add("c", [2, 0])
        crash(db)
    db = Database(spark, root)
    db.add("c", [3, 0])
    crash(db)
    file = log / json.loads((tmp_path / "db" / "c" / "manifest.json").read_text())["log"][-1]["file"]  # one that is in use
    data = bytearray(file.read_bytes())
    data[40] ^= 1
    file.write_bytes(data)
    with pytest.raises(CorruptError):
        Database(spark, root)
    file.unlink()
    with pytest.raises(CorruptError):
        Database(spark, root)
    (tmp_path / "db" / "c" / "manifest.json").write_text("garbage")
    with pytest.raises(CorruptError):
        Database(spark, root)


def test_crash_between_snapshot_and_commit(spark, root, monkeypatch):
    db = Database(spark, root)
    db.create_collection("c", 2)
    db.add("c", [1, 0])

    def fail(self):
        raise OSError("lost")

    monkeypatch.setattr(StoredCollection, "commit", fail)
    with pytest.raises(OSError):
        db.checkpoint("c")
    monkeypatch.undo()
    crash(db)
    with Database(spark, root) as db:
        assert len(state(db)) == 1


def test_one_writer(spark, root, tmp_path):
    db = Database(spark, root)
    (tmp_path / "db" / ".writer").write_text("1")  # a process that lives
    with pytest.raises(ConflictError):
        Database(spark, root)
    crash(db)


def test_one_writer_in_one_process(spark, root):
    """A second database of this process does not take the lock; a lock of this process's id that it does not hold is stale."""
    with Database(spark, root), pytest.raises(ConflictError):
        Database(spark, root)
    lock = Path(root, ".writer")
    lock.write_text(f"{socket.gethostname()} {os.getpid()}")
    with Database(spark, root):
        pass
    lock.write_text("another-host 1")
    with pytest.raises(ConflictError):
        Database(spark, root)


def test_searches_with_a_log_tail_move_no_vectors(spark, root):
    """The snapshot is filtered by the ids of the log where it is read; only hits move."""
    with Database(spark, root) as db:
        db.create_collection("c", 2)
        db.upsert_df("c", spark.createDataFrame([(i, [float(i), 1.0], "{}") for i in range(50)], "id long, vector array<float>, metadata string"))
        db.checkpoint("c")
        db.delete("c", 49)
        db.insert("c", 3, [100.0, 0.0], {"new": 1})
        found = db.query(Query("c", [1.0, 0.0]).top_k(3))
        rows = [r["id"] for r in found.collect()]
        assert rows == [3, 48, 47] and db.stats("c")["records"] == 49
        plan = found._jdf.queryExecution().executedPlan().toString()
        final = plan.partition("== Initial Plan ==")[0]
        assert "SortMergeJoin" not in final and "LeftAnti" in final and "BroadcastHashJoin" in final
        assert "ReadSchema" in plan and "pos:bigint" not in plan
        assert [r["id"] for r in db.all_records("c").collect()] == list(range(49))  # a put over a record keeps its place


def test_get_and_delete_through_buffer_log_and_snapshot(spark, root):
    db = Database(spark, DbConfig(root).with_sync_mode(SyncMode.BATCH, 3))
    db.create_collection("c", 1)
    db.upsert_many("c", [{"vector": [0.1], "metadata": {"i": i}} for i in range(3)])
    db.checkpoint("c")
    db.insert("c", 2, [9.0])
    db.delete("c", 3)
    db.insert("c", 7, [7.0])  # flushed: three operations
    db.insert("c", 8, [0.1])  # buffered
    got = {i: db.get("c", i) for i in (1, 2, 3, 7, 8, 99)}
    assert got[1]["vector"] == got[8]["vector"] == [np.float32(0.1)] and json.loads(got[1]["metadata"]) == {"i": 0}
    assert got[2]["vector"] == [9.0] and got[7]["vector"] == [7.0] and got[3] is got[99] is None
    assert not db.delete("c", 3) and not db.delete("c", 99) and db.delete("c", 8) and not db.delete("c", 8)
    for id in (-1, 1 << 63, 10**30):
        assert db.get("c", id) is None and not db.delete("c", id)
    db.close()


def test_many_small_files_become_one(spark, root, monkeypatch):
    monkeypatch.setattr("lodestar.sources.collection.COMPACT", 4)
    db = Database(spark, root)
    db.create_collection("c", 1)
    for i in range(11):
        db.add("c", [i])
    assert len(db._open["c"].manifest.log) <= 5
    crash(db)
    with Database(spark, root) as db:
        assert sorted(state(db)) == list(range(1, 12))


def test_bad_bulk_rows_refuse_the_whole(spark, root):
    """Nothing of a refused batch is written, and the collection works on."""
    shape = "ordinal long, id long, vector array<float>, metadata string"
    good = (0, 1, [1.0, 2.0], "{}")
    with Database(spark, root) as db:
        db.create_collection("c", 2)
        for bad in ([good, (1, -5, [1.0, 2.0], "{}")], [(0, 5, [1.0, 2.0], "{bad")], [(0, 5, [1.0, None], "{}")], [good, (2, 3, [1.0, 2.0], "{}")], [good, (0, 3, [1.0, 2.0], "{}")]):
            with pytest.raises(ParseError):
                db.upsert_df("c", spark.createDataFrame(bad, shape))
        with pytest.raises(DimMismatch):
            db.upsert_df("c", spark.createDataFrame([(0, 5, None, "{}")], shape))
        assert db.stats("c")["ops_since_snapshot"] == 0
        db.upsert_df("c", spark.createDataFrame([good, (1, None, [3.0, 4.0], None)], shape))
        assert [r["id"] for r in db.query(Query("c", [1.0, 0.0]).filter("x = 1")).collect()] == []
        assert state(db) == {1: ([1.0, 2.0], {}), 2: ([3.0, 4.0], {})}


def test_bulk_deletes_are_one_commit(spark, root):
    with Database(spark, root) as db:
        db.create_collection("c", 1)
        db.upsert_df("c", spark.createDataFrame([(i, [1.0], "{}") for i in range(6)], "id long, vector array<float>, metadata string"))
        db.checkpoint("c")
        ops = [(0, "delete", 1, None, None), (1, "put", 9, [5.0], None), (2, "delete", 2, None, None), (3, "put", 2, [2.0], '{"back":1}')]
        db.write_ops("c", spark.createDataFrame(ops, "ordinal long, op string, id long, vector array<float>, metadata string"))
        assert sorted(state(db)) == [0, 2, 3, 4, 5, 9] and state(db)[2] == ([2.0], {"back": 1})
        assert [r["id"] for r in db.all_records("c").collect()] == [0, 3, 4, 5, 9, 2]
        for wrong in ((0, "delete", None, None, None), (0, "drop", 1, None, None), (0, None, 1, None, None)):
            with pytest.raises(ParseError):
                db.write_ops("c", spark.createDataFrame([wrong], "ordinal long, op string, id long, vector array<float>, metadata string"))
        assert db.add("c", [1.0]) == 10


def test_readers_outlive_a_checkpoint(spark, root):
    """A search made before a checkpoint still runs after it; with no time to stay, replaced files go at once."""
    with Database(spark, root) as db:
        db.create_collection("c", 1)
        db.add("c", [1.0])
        db.checkpoint("c")
        db.add("c", [2.0])
        before = db.query(Query("c", [1.0]))
        db.checkpoint("c")
        assert len(before.collect()) == 2
        assert len(list(Path(root, "c", "snapshots").iterdir())) == 2
    with Database(spark, DbConfig(root, retain_seconds=0)) as db:
        assert [p.name for p in Path(root, "c", "snapshots").iterdir()] == ["gen=00000002"]
        db.add("c", [3.0])
        db.checkpoint("c")
        assert [p.name for p in Path(root, "c", "snapshots").iterdir()] == ["gen=00000003"] and not list(Path(root, "c", "oplog").glob("0*"))


@pytest.mark.parametrize("where", ["oplog", "snapshots"])
def test_a_lost_part_is_loud(spark, root, where):
    db = Database(spark, root)
    db.create_collection("c", 1)
    db.upsert_df("c", spark.createDataFrame([(i, [1.0], "{}") for i in range(40)], "id long, vector array<float>, metadata string").repartition(4))
    if where == "snapshots":
        db.checkpoint("c")
    crash(db)
    part = max(Path(root, "c", where).glob("*/part-*"), key=lambda p: p.stat().st_size)
    data = part.read_bytes()
    part.unlink()
    with pytest.raises(CorruptError):
        Database(spark, root)
    part.write_bytes(data[:100])
    with pytest.raises(CorruptError):
        Database(spark, root)
    part.write_bytes(data)
    with Database(spark, root) as db:
        assert len(state(db)) == 40


def test_upsert_df(spark, root):
    with Database(spark, root) as db:
        db.create_collection("c", 2)
        rows = spark.createDataFrame([(i, [float(i), 1.0], '{"i":%d}' % i) for i in range(100)], "id long, vector array<float>, metadata string")
        db.upsert_df("c", rows)
        assert db.add("c", [1, 1]) == 100 and db.stats("c")["records"] == 101
        mixed = spark.createDataFrame([(0, None, [9.0, 9.0], None), (1, 5, [8.0, 8.0], None), (2, 5, [7.0, 7.0], "{}")], "ordinal long, id long, vector array<float>, metadata string")
        db.upsert_df("c", mixed)
        assert state(db)[101] == ([9.0, 9.0], {}) and state(db)[5][0] == [7.0, 7.0]
        with pytest.raises(DimMismatch):
            db.upsert_df("c", rows.selectExpr("id", "array(1f) as vector", "metadata"))
        with pytest.raises(ParseError):
            db.upsert_df("c", rows.drop("id"))


@pytest.mark.parametrize("block", [1_000_000, 100, 7])
def test_ordinals_are_dense_and_in_order(spark, block):
    """Whatever the blocks and partitions are, no row is lost or numbered twice."""
    rnd = random.Random(block)
    ids = rnd.sample(range(10**6), 500) + list(range(2 * 10**6, 2 * 10**6 + 200))
    rnd.shuffle(ids)
    rows = spark.createDataFrame([(i, f"m{i}") for i in ids], "id long, metadata string").repartition(6)
    got = _numbered(rows, len(ids), block).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["id"], r["metadata"]) for r in got] == [(k, i, f"m{i}") for k, i in enumerate(sorted(ids))]


def test_bulk_writes_of_many_partitions(spark, root):
    """Partitions that adaptive execution merges keep all their rows."""
    with Database(spark, root) as db:
        db.create_collection("c", 2)
        rows = spark.range(0, 20_000, 1, 12).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"), F.lit("{}").alias("metadata"))
        db.upsert_df("c", rows)
        assert db.stats("c")["records"] == 20_000


def model(ops):
    live, pos = {}, {}
    for seq, (op, id) in enumerate(ops):
        if op == "put":
            pos.setdefault(id, seq)
            live[id] = seq
        else:
            live.pop(id, None)
            pos.pop(id, None)
    return {i: (f'{{"s":{s}}}', pos[i]) for i, s in live.items()}


def test_replay_against_model(spark):
    rnd = random.Random(7)
    for _ in range(4):
        ops = [(rnd.choice(["put", "put", "delete"]), rnd.randint(0, 8)) for _ in range(60)]
        log = spark.createDataFrame([(s, op, i, [1.0] if op == "put" else None, f'{{"s":{s}}}' if op == "put" else None) for s, (op, i) in enumerate(ops)], "seq long, op string, id long, vector array<float>, metadata string")
        got = lambda df: {r["id"]: (r["metadata"], r["pos"]) for r in df.collect()}
        want = model(ops)
        assert got(replay(log)) == want
        cut = rnd.randint(0, 59)
        assert got(replay(log, replay(log.where(f"seq <= {cut}")), cut)) == want
        assert got(replay(log.union(log))) == want


@given(st.lists(st.one_of(st.none(), st.integers(0, 30)), max_size=20), st.integers(1, 10))
@settings(max_examples=8, deadline=None)
def test_bulk_ids_against_loop(spark, given_ids, start):
    rows = spark.createDataFrame(list(enumerate(given_ids)), "ordinal long, id long")
    got = [r["id"] for r in assign_ids(rows, start, block=1 + start % 5).orderBy("ordinal").collect()]
    nxt, want = start, []
    for i in given_ids:
        want.append(nxt if i is None else i)
        nxt = max(nxt, want[-1] + 1)
    assert got == want


@pytest.mark.parametrize("kind", ["local", "memory"])
def test_object_store_contract(kind, tmp_path):
    store = LocalStorage(str(tmp_path)) if kind == "local" else MemoryStorage()
    assert store.get("db/manifest.json") is None
    v1 = store.put_if_version("db/manifest.json", b"one", None)
    with pytest.raises(ConflictError):
        store.put_if_version("db/manifest.json", b"two", None)
    v2 = store.put_if_version("db/manifest.json", b"two", v1)
    assert store.get("db/manifest.json") == (b"two", v2) and v2 == version_of(b"two")
    store.put("db/wal/1.log", b"x")
    assert store.list("db/wal") == ["db/wal/1.log"] and len(store.list()) == 2 and store.names() == ["db"]
    store.delete("db/wal/1.log")
    store.delete("db/wal/1.log")
    for bad in ("../secret", "", "/abs", "a/../b"):
        with pytest.raises(ParseError):
            store.put(bad, b"")


def test_helpers():
    assert crc32(b"123456789") == 0xCBF43926
    assert parse_vector("[1, 2,,3]") == [1.0, 2.0, 3.0] and parse_vector("1,-2.5") == [1.0, -2.5]
    for bad in ("", "[]", " , "):
        with pytest.raises(EmptyVector):
            parse_vector(bad)
    with pytest.raises(ParseError):
        parse_vector("1,x")
    assert parse_metadata("  ") == {} and parse_metadata("[1]") == [1]
    for bad in ("{", "NaN", "1e400"):
        with pytest.raises(ParseError):
            parse_metadata(bad)
    assert validate_key("a/b") == "a/b"
