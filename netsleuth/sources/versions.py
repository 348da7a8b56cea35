"""Versioned folders behind a pointer (K6, state tables, processed ledger).

A version is written whole into a folder of its own, then published by one
small file in ``<path>/_pointers``, which appears at once or not at all.  A
reader takes the newest pointer, so it sees the old version or the new one.  A
version that was never published is written over by the next attempt.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTERS = "_pointers"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def published(spark: SparkSession, path: str) -> list[int]:
    """Published versions in order."""
    fs, p = _fs(spark, f"{path}/{POINTERS}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit())


def current(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The newest published version (before version ``below`` if given)."""
    found = [v for v in published(spark, path) if below is None or v < below]
    return found[-1] if found else None


def folder(path: str, version: int) -> str:
    return f"{path}/version={version}"


def publish(spark: SparkSession, path: str, version: int, write: Callable[[str], None]) -> str:
    """Write version ``version`` with ``write(folder)`` and point to it; one
    that is published already stays as it is."""
    target = folder(path, version)
    if version not in published(spark, path):
        write(target)
        point(spark, path, version)
    return target


def point(spark: SparkSession, path: str, version: int) -> None:
    """Publish a version whose files are complete."""
    fs, draft = _fs(spark, f"{path}/{POINTERS}/.draft-{uuid.uuid4().hex}")
    fs.mkdirs(draft.getParent())
    fs.create(draft, True).close()
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTERS}/{version:018d}")
    if not fs.rename(draft, final):
        fs.delete(draft, False)
        if not fs.exists(final):
            raise OSError(f"cannot publish version {version} of {path}")


def day_marks(spark: SparkSession, path: str, column: str = "event_date") -> dict[str, str]:
    """Per partition folder ``column=value`` of a table, a mark that changes
    whenever a file is added or removed: read from the file system, no data."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return {}
    marks = {}
    for day in fs.listStatus(p):
        name = day.getPath().getName()
        if day.isDirectory() and name.startswith(f"{column}="):
            files = [(f.getPath().getName(), f.getLen()) for f in fs.listStatus(day.getPath()) if f.getPath().getName()[:1] not in "._"]
            if files:
                marks[name.split("=", 1)[1]] = f"{len(files)}-{sum(n for _, n in files)}-{max(n for n, _ in files)}"
    return marks
