"""HTTP front end on the standard library; one database, one writer.

Environment: LODESTAR_API_KEY (required), LODESTAR_DATA_DIR, LODESTAR_DATABASE, PORT,
LODESTAR_MAX_BODY_BYTES, LODESTAR_MAX_BATCH_SIZE. All but /health ask for the key as a
bearer token. Writes take turns; searches run side by side as Spark jobs.
"""

from __future__ import annotations

import hmac
import itertools
import json
import os
import re
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession

from . import __version__
from .database import Database
from .errors import LodestarError
from .functions.checks import load_json
from .operators.search import DEFAULT_TOP_K, Query
from .plans.filters import Filter


class HttpError(Exception):
    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.status, self.code = status, code


class Api:
    """Requests as plain calls: handle(method, path, headers, body) gives status, value."""

    def __init__(self, db: Database, key: str, name: str = "default", max_batch: int = 1000):
        self.db, self.key, self.name, self.max_batch = db, key, name, max_batch
        self.mutex = threading.Lock()
        base = r"/v1/databases/(?P<db>[^/]+)/collections"
        one = base + r"/(?P<c>[^/]+)"
        self.routes = [
            ("GET", r"/ready", self.ready),
            ("GET", r"/v1/info", self.info),
            ("GET", r"/v1/databases", self.databases),
            ("POST", r"/v1/databases", self.no_database),
            ("GET", base, self.collections),
            ("POST", base, self.create),
            ("DELETE", one, self.drop),
            ("POST", one + r"/vectors", self.upsert),
            ("PUT", one + r"/vectors/(?P<id>\d+)", self.put),
            ("DELETE", one + r"/vectors/(?P<id>\d+)", self.delete),
            ("POST", one + r"/query", self.query),
        ]

    def handle(self, method: str, path: str, authorization: str | None, body: bytes) -> tuple[int, Any]:
        try:
            if (method, path) == ("GET", "/health"):
                return 200, {"status": "ok"}
            if not hmac.compare_digest((authorization or "").encode(), f"Bearer {self.key}".encode()):
                raise HttpError(401, "unauthorized", "missing or wrong API key")
            known = False
            for verb, pattern, run in self.routes:
                if m := re.fullmatch(pattern, path):
                    known = True
                    if verb == method:
                        found = m.groupdict()
                        if found.get("db", self.name) != self.name:
                            raise HttpError(404, "not_found", f"no database {found['db']!r}")
                        return run(found, body)
            raise HttpError(405 if known else 404, "method_not_allowed" if known else "not_found", f"no route for {method} {path}")
        except HttpError as e:
            return e.status, {"error": {"code": e.code, "message": str(e)}}
        except LodestarError as e:
            return e.status, {"error": {"code": e.code, "message": str(e)}}
        except Exception as e:  # the client gets a reply, whatever happens
            return 500, {"error": {"code": "internal_error", "message": f"{type(e).__name__}: {str(e)[:500]}"}}

    @staticmethod
    def _body(body: bytes, required: dict[str, type], optional: dict[str, type] | None = None) -> dict[str, Any]:
        try:
            value = load_json(body.decode())
        except ValueError as e:
            raise HttpError(400, "invalid_request", f"invalid JSON: {e}") from None
        if not isinstance(value, dict):
            raise HttpError(400, "invalid_request", "the body must be an object")
        for k, kind in {**required, **(optional or {})}.items():
            v = value.get(k)
            if v is None and k not in required:
                continue
            if not isinstance(v, kind) or kind is int and isinstance(v, bool):
                raise HttpError(400, "invalid_request", f"{k} must be {kind.__name__}")
        return value

    @staticmethod
    def _vector(v: list[Any]) -> list[float]:
        if not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
            raise HttpError(400, "invalid_request", "a vector holds numbers")
        try:
            return [float(x) for x in v]
        except OverflowError:
            raise HttpError(400, "invalid_request", "a number of the vector is out of range") from None

    def ready(self, at, body):
        return 200, {"status": "ready", "collections": len(self.db.list_collections())}

    def info(self, at, body):
        return 200, {"name": "lodestar", "version": __version__, "database": self.name, "distance_metric": "cosine", "mode": "single-writer"}

    def databases(self, at, body):
        return 200, {"databases": [self.name]}

    def no_database(self, at, body):
        raise HttpError(409, "single_database", "this server has one database")

    def collections(self, at, body):
        stats = map(self.db.stats, self.db.list_collections())
        return 200, {"collections": [{"name": s["name"], "dimension": s["dim"], "vectors": s["records"]} for s in stats]}

    def create(self, at, body):
        v = self._body(body, {"name": str, "dimension": int})
        with self.mutex:
            self.db.create_collection(v["name"], v["dimension"])
        return 201, {"name": v["name"], "dimension": v["dimension"]}

    def drop(self, at, body):
        with self.mutex:
            self.db.drop_collection(at["c"])
        return 204, None

    def upsert(self, at, body):
        v = self._body(body, {"vectors": list})
        for r in v["vectors"]:
            if not isinstance(r, dict) or not isinstance(r.get("vector"), list):
                raise HttpError(400, "invalid_request", "each record needs a vector")
            r["vector"] = self._vector(r["vector"])
        with self.mutex:
            ids = self.db.upsert_many(at["c"], v["vectors"], self.max_batch)
        return 200, {"ids": ids, "count": len(ids)}

    def put(self, at, body):
        v = self._body(body, {"vector": list})
        with self.mutex:
            self.db.insert(at["c"], int(at["id"]), self._vector(v["vector"]), v.get("metadata"))
        return 200, {"id": int(at["id"])}

    def delete(self, at, body):
        with self.mutex:
            if not self.db.delete(at["c"], int(at["id"])):
                raise HttpError(404, "not_found", f"no record {at['id']}")
        return 204, None

    def query(self, at, body):
        v = self._body(body, {"vector": list}, {"top_k": int, "filter": str})
        q = Query(at["c"], self._vector(v["vector"])).top_k(v.get("top_k", DEFAULT_TOP_K))
        if v.get("filter") is not None:
            q.filter(Filter.parse(v["filter"]))
        hits = [{"id": r["id"], "score": r["score"], "vector": list(r["vector"]), "metadata": load_json(r["metadata"])} for r in self.db.query(q).collect()]
        return 200, {"hits": hits, "count": len(hits)}


def serve(api: Api, port: int, max_body: int) -> ThreadingHTTPServer:
    numbers = itertools.count(1)

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > max_body:
                status, value = 413, {"error": {"code": "too_large", "message": f"the body is over {max_body} bytes"}}
            else:
                status, value = api.handle(self.command, self.path.partition("?")[0], self.headers.get("Authorization"), self.rfile.read(size))
            data = b"" if value is None else json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            if status < 400:
                self.send_header("x-request-id", f"lodestar-{next(numbers)}")
            if data:
                self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _do

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer(("", port), Handler)


def main() -> int:
    env = os.environ
    if not env.get("LODESTAR_API_KEY"):
        print("error: LODESTAR_API_KEY is not set", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("lodestar").config("spark.ui.enabled", "false").getOrCreate()
    with Database(spark, env.get("LODESTAR_DATA_DIR", "./lodestar-data")) as db:
        api = Api(db, env["LODESTAR_API_KEY"], env.get("LODESTAR_DATABASE", "default"), int(env.get("LODESTAR_MAX_BATCH_SIZE", "1000")))
        server = serve(api, int(env.get("PORT", "8080")), int(env.get("LODESTAR_MAX_BODY_BYTES", str(4 << 20))))
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            pass
        finally:
            server.server_close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
