"""Command line, HTTP, streaming ingest, entry module."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from lodestar.cli import main
from lodestar.database import Database
from lodestar.server import Api, serve


def test_cli(spark, tmp_path, capsys):
    def run(*args, code=0):
        assert main(["--db", str(tmp_path / "d"), *args], spark) == code
        out = capsys.readouterr()
        return json.loads(out.out) if code == 0 else out.err

    assert run("create", "items", "--dim", "2") == {"ok": True, "collection": "items", "dim": 2}
    assert run("insert", "items", "--vector", "1,0", "--metadata", '{"price": 5}')["id"] == 1
    assert run("insert", "items", "--vector", "[0,1]", "--id", "9")["id"] == 9
    assert run("get", "items", "1")["record"] == {"id": 1, "vector": [1.0, 0.0], "metadata": {"price": 5}}
    assert run("get", "items", "2") == {"ok": False, "reason": "not found"}
    hits = run("query", "items", "--vector", "1,0", "-t", "1", "--filter", "price < 6")
    assert hits["count"] == 1 and hits["hits"][0]["id"] == 1 and hits["hits"][0]["score"] == 1.0
    assert [r["id"] for r in run("records", "items")["records"]] == [1, 9]
    assert run("delete", "items", "9")["deleted"] is True
    assert run("info", "items")["next_id"] == 10
    assert run("list")["collections"] == [{"name": "items", "dim": 2, "records": 1, "wal_frames": 0, "ops_since_snapshot": 0}]
    assert run("checkpoint") == {"ok": True, "snapshotted": ["items"]}
    assert run("checkpoint", "items")["ok"]
    assert "not found" in run("info", "none", code=1)
    assert "position" in run("query", "items", "--vector", "1,0", "--filter", "price <", code=1)
    assert run("drop", "items") == {"ok": True, "dropped": "items"}
    with pytest.raises(SystemExit):
        main(["--no-sync", "--batch", "3", "list"], spark)


def test_http(spark, tmp_path):
    with Database(spark, str(tmp_path / "d")) as db:
        api = Api(db, "secret", "main", max_batch=3)
        server = serve(api, 0, 10_000)
        threading.Thread(target=server.serve_forever, daemon=True).start()

        def call(method, path, body=None, key="secret"):
            req = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", method=method, data=None if body is None else json.dumps(body).encode())
            if key:
                req.add_header("Authorization", f"Bearer {key}")
            try:
                with urllib.request.urlopen(req) as r:
                    assert r.headers["x-request-id"].startswith("lodestar-")
                    return r.status, json.loads(r.read() or b"null")
            except urllib.error.HTTPError as e:
                return e.code, json.loads(e.read())["error"]["code"]

        base = "/v1/databases/main/collections"
        assert call("GET", "/health", key=None) == (200, {"status": "ok"})
        assert call("GET", "/ready", key="wrong")[0] == 401
        assert call("GET", "/ready") == (200, {"status": "ready", "collections": 0})
        assert call("GET", "/v1/info")[1]["distance_metric"] == "cosine"
        assert call("GET", "/v1/databases") == (200, {"databases": ["main"]})
        assert call("POST", "/v1/databases", {}) == (409, "single_database")
        assert call("POST", base, {"name": "c", "dimension": 2})[0] == 201
        assert call("POST", base, {"name": "c", "dimension": 2}) == (409, "conflict")
        assert call("POST", base, {"name": "a b", "dimension": 2}) == (400, "invalid_request")
        assert call("POST", f"{base}/c/vectors", {"vectors": [{"vector": [1, 0], "metadata": {"x": 1}}, {"id": 7, "vector": [0, 1]}]}) == (200, {"ids": [1, 7], "count": 2})
        assert call("POST", f"{base}/c/vectors", {"vectors": [{"vector": [1]}]}) == (400, "invalid_request")
        assert call("POST", f"{base}/c/vectors", {"vectors": [{"vector": [1, 0]}] * 4}) == (400, "invalid_request")
        assert call("PUT", f"{base}/c/vectors/9", {"id": 1, "vector": [1, 1]}) == (200, {"id": 9})
        assert call("GET", base)[1] == {"collections": [{"name": "c", "dimension": 2, "vectors": 3}]}
        status, found = call("POST", f"{base}/c/query", {"vector": [1, 0], "top_k": 2})
        assert (status, [h["id"] for h in found["hits"]], found["count"]) == (200, [1, 9], 2)
        assert [h["id"] for h in call("POST", f"{base}/c/query", {"vector": [1, 0], "filter": "x = 1"})[1]["hits"]] == [1]
        assert call("POST", f"{base}/none/query", {"vector": [1], "filter": "bad"}) == (400, "invalid_request")
        assert call("POST", f"{base}/none/query", {"vector": [1]}) == (404, "not_found")
        assert call("DELETE", f"{base}/c/vectors/9")[0] == 204
        assert call("DELETE", f"{base}/c/vectors/9") == (404, "not_found")
        assert call("DELETE", f"{base}/c/vectors/{10**20}") == (404, "not_found")
        assert call("PUT", f"{base}/c/vectors/{10**20}", {"vector": [1, 1]}) == (400, "invalid_request")
        assert call("POST", f"{base}/c/query", {"vector": [10**400, 1]}) == (400, "invalid_request")
        assert call("POST", f"{base}/c/query", {"vector": [0] * 9000})[0] == 413
        assert call("GET", "/v1/databases/other/collections") == (404, "not_found")
        assert call("GET", "/nowhere") == (404, "not_found")
        assert call("DELETE", f"{base}/c")[0] == 204
        api.db = None  # whatever goes wrong, the client gets a reply
        assert call("GET", base) == (500, "internal_error")
        server.shutdown()
        server.server_close()


def test_streaming_ingest(spark, tmp_path):
    from lodestar.streaming.ingest import ingest, watch

    schema = "ordinal long, op string, id long, vector array<float>, metadata string"
    rows = [(0, "put", 1, [1.0, 0.0], "{}"), (1, "put", 2, [0.0, 1.0], "{}"), (2, "put", 1, [5.0, 5.0], "{}"), (3, "delete", 2, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    with Database(spark, str(tmp_path / "d")) as db:
        db.create_collection("c", 2)
        db.add("c", [9, 9])
        query = ingest(watch(spark, str(tmp_path / "in"), schema), db, "c", str(tmp_path / "ck"))
        query.awaitTermination(120)
        assert {r["id"]: r["vector"] for r in db.records("c").collect()} == {1: [5.0, 5.0]}


def test_entry_module(spark):
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 30
    assert len(entry.entry(spark).collect()) == 10
