"""Checkpoints of ingestion, one for each file and run, kept in the state of a warehouse."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.store import Warehouse

IN_PROGRESS, COMPLETED, FAILED = "IN_PROGRESS", "COMPLETED", "FAILED"


class AmbiguousCheckpoint(RuntimeError):
    """More than one run of a file is in progress."""


class Checkpoint(NamedTuple):
    fingerprint: str
    id_run: str
    status: str
    processed_rows: int
    updated_at: str
    error: str = ""


def state_of(point: Checkpoint) -> dict:
    """A checkpoint as a change of the store's state."""
    return {"checkpoints": {f"{point.fingerprint}_{point.id_run}": list(point)}}


def save(store: Warehouse, point: Checkpoint) -> None:
    store.commit(state=state_of(point))


def all_of(store: Warehouse, fingerprint: str) -> list[Checkpoint]:
    return [p for p in (Checkpoint(*v) for v in store.state.get("checkpoints", {}).values()) if p.fingerprint == fingerprint]


def active(store: Warehouse, fingerprint: str) -> Checkpoint | None:
    """The run to resume: the one in progress, else the newest failed one; finished runs do not count."""
    points = all_of(store, fingerprint)
    running = [p for p in points if p.status == IN_PROGRESS]
    if len(running) > 1:
        raise AmbiguousCheckpoint(", ".join(sorted(p.id_run for p in running)))
    failed = sorted((p for p in points if p.status == FAILED), key=lambda p: p.updated_at)
    return running[0] if running else failed[-1] if failed else None


def remaining(raw: DataFrame, point: Checkpoint | None) -> DataFrame:
    """The rows that a resumed run has still to process."""
    return raw if point is None else raw.where(F.col("number_row_source") > point.processed_rows)
