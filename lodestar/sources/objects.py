"""Object stores with conditional writes; manifests and small log files go through one."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager
from pathlib import Path
from typing import Protocol

from ..errors import ConflictError, ParseError
from ..functions.checks import validate_key, version_of


def work_folder(spark, name: str) -> str:
    """A new folder for a database of a query, removed when the JVM ends: in the shared folder of the cluster, or a temporary one where all runs in one process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None and spark.sparkContext.master.startswith("local"):
        return _passing(spark, tempfile.mkdtemp(prefix=f"lodestar-{name}-"))
    if shared is None or not (shared.startswith("file:") or shared.startswith("/")):
        raise ParseError("a database needs a file system that driver and executors share, named by spark.checkpoint.dir")
    return _passing(spark, f"{re.sub('^file:/*', '/', shared).rstrip('/')}/lodestar-{name}-{uuid.uuid4().hex}")


def _passing(spark, path: str) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{path}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


class ObjectStore(Protocol):
    def get(self, key: str) -> tuple[bytes, str] | None: ...
    def put(self, key: str, data: bytes) -> str: ...
    def put_if_version(self, key: str, data: bytes, expected: str | None) -> str: ...
    def list(self, prefix: str = "") -> list[str]: ...
    def names(self) -> list[str]: ...
    def delete(self, key: str) -> None: ...


class LocalStorage:
    """Files under a root; a put appears whole or not at all, a conditional put holds a lock file."""

    def __init__(self, root: str):
        self.root = Path(re.sub("^file:/*", "/", root)).absolute()
        self.root.mkdir(parents=True, exist_ok=True)
        self._mutex = threading.Lock()

    def _path(self, key: str) -> Path:
        return self.root / validate_key(key)

    def get(self, key: str) -> tuple[bytes, str] | None:
        try:
            data = self._path(key).read_bytes()
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None
        return data, version_of(data)

    def put(self, key: str, data: bytes) -> str:
        path = self._path(key)
        path.parent.mkdir(parents=True, exist_ok=True)
        temporary = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        with temporary.open("wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
        return version_of(data)

    @contextmanager
    def _locked(self, path: Path):
        path.parent.mkdir(parents=True, exist_ok=True)
        lock = path.with_name(f".{path.name}.lock")
        with self._mutex:
            try:
                os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                raise ConflictError(f"{path.name} is being written") from None
            try:
                yield
            finally:
                lock.unlink()

    def put_if_version(self, key: str, data: bytes, expected: str | None) -> str:
        with self._locked(self._path(key)):
            now = self.get(key)
            if (now and now[1]) != expected:
                raise ConflictError(f"{key}: expected version {expected}, found {now and now[1]}")
            return self.put(key, data)

    def list(self, prefix: str = "") -> list[str]:
        found = (p.relative_to(self.root).as_posix() for p in self.root.rglob("*") if p.is_file() and not p.name.startswith("."))
        return sorted(k for k in found if k.startswith(prefix))

    def names(self) -> list[str]:
        """First parts of keys, without a look at what is below."""
        return sorted(p.name for p in self.root.iterdir() if p.is_dir())

    def delete(self, key: str) -> None:
        self._path(key).unlink(missing_ok=True)


class MemoryStorage:
    """The same contract in memory, for tests."""

    def __init__(self):
        self._objects: dict[str, bytes] = {}
        self._mutex = threading.Lock()

    def get(self, key: str) -> tuple[bytes, str] | None:
        data = self._objects.get(validate_key(key))
        return None if data is None else (data, version_of(data))

    def put(self, key: str, data: bytes) -> str:
        self._objects[validate_key(key)] = data
        return version_of(data)

    def put_if_version(self, key: str, data: bytes, expected: str | None) -> str:
        with self._mutex:
            now = self.get(key)
            if (now and now[1]) != expected:
                raise ConflictError(f"{key}: expected version {expected}, found {now and now[1]}")
            return self.put(key, data)

    def list(self, prefix: str = "") -> list[str]:
        return sorted(k for k in self._objects if k.startswith(prefix))

    def names(self) -> list[str]:
        return sorted({k.partition("/")[0] for k in self._objects if "/" in k})

    def delete(self, key: str) -> None:
        self._objects.pop(validate_key(key), None)
