"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import drop_tables, saved, shared_dir, tables_dir  # noqa: F401 - for the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(col, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release() -> None:
    """Give freed memory back to the system, as Python workers live on beyond a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def slices(batches, rows: int = 256):
    """The columns of record batches as lists, a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield [c.to_pylist() for c in batch.slice(at, rows).columns]
