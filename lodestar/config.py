"""Configuration of a database."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum


class SyncMode(Enum):
    """When buffered operations become files: at each one, at every n-th, or at checkpoint and close."""

    EVERY = "every"
    BATCH = "batch"
    NEVER = "never"


@dataclass(frozen=True)
class DbConfig:
    data_dir: str
    sync_mode: SyncMode = SyncMode.EVERY
    batch: int = 1
    auto_snapshot_after: int = 10_000
    #: Seconds for which files that a checkpoint replaced stay, so that readers can finish.
    retain_seconds: float = 600.0

    def with_sync_mode(self, mode: SyncMode, batch: int = 1) -> DbConfig:
        return replace(self, sync_mode=mode, batch=max(1, batch))

    def with_auto_snapshot_after(self, n: int) -> DbConfig:
        return replace(self, auto_snapshot_after=n)
