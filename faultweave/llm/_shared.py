"""What the llm operators share: tables, the separator of words, and the library's saved tables and components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from faultweave.operators.components import MAX_BROADCAST, Saved, components, shared_dir, without

__all__ = ["MAX_BROADCAST", "SPACE", "Saved", "components", "kept", "shared_dir", "shuffle_partitions", "table", "trim", "without"]

#: ASCII white space that separates words in every word-based operator.
SPACE = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


T = TypeVar("T")
_kept: dict[str, object] = {}


def trim() -> None:
    """Gives memory that this process has freed back to the machine: a worker that waits should hold no more than it keeps."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library on Linux
    if free is not None:
        free(0)


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """What a Python worker keeps between its tasks: one thing at a time, so an operator's tables make room for the next one's."""
    if _kept.get("key") != key:
        _kept.clear()
        trim()
        _kept.update(key=key, value=make())
    return _kept["value"]  # type: ignore[return-value]
