"""Where tables and files go that one stage writes and another reads."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used so far, below the folder that the cluster names in ``spark.checkpoint.dir``.

    Local mode without it gets a temporary folder; a cluster without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="rasterlines-")
        root = _own[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes that go to a Python worker at a time, in Arrow; a longer row goes alone.
BATCH_BYTES = 4 << 20


def limit_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, where it has the usual limit (64 MB): rows vary too much to be counted."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower() in ("-1", "64mb", "67108864b"):
        spark.conf.set(key, f"{BATCH_BYTES}b")


def in_groups(items: Iterable[tuple], most: int = BATCH_BYTES, count: int = 1 << 12) -> Iterator[list[tuple]]:
    """Items whose last member is bytes or null, in lists of at most ``count`` that end with the item that makes ``most`` bytes."""
    group, size = [], 0
    for item in items:
        group.append(item)
        size += len(item[-1] or b"")
        if size >= most or len(group) >= count:
            yield group
            group, size = [], 0
    if group:
        yield group
