"""What several operators of this subpackage share: reading tables, cutting lineage, sizing partitions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import discard, saved, shared_dir

__all__ = ["crc_class", "discard", "free", "give_back", "lists", "memory_stays", "one_core_each", "parts", "saved", "shared_dir", "table", "tidy", "whole"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame, column: str, mb: int = 16) -> int:
    """A number of partitions in proportion to the bytes of a text column, at least the session's setting."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // (mb << 20) + 1)


def lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def whole(batches) -> pa.Table | None:
    """All batches of a partition as one table, or None."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def crc_class(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def one_core_each(spark: SparkSession) -> None:
    """From now on Python workers do matrix products on one core: a task has no more, and idle threads would spin."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        spark.sparkContext.environment[name] = "1"


def memory_stays(spark: SparkSession) -> None:
    """From now on Python workers keep up to 64 MB that arrays gave back, rather than fetch it anew for each product."""
    spark.sparkContext.environment.update({"MALLOC_MMAP_THRESHOLD_": str(32 << 20), "MALLOC_TRIM_THRESHOLD_": str(64 << 20)})


def give_back() -> None:
    """What this process freed goes back to the system: an executor's workers live on and share one limit with its JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def tidy(f: Callable) -> Callable:
    """f for mapInArrow, after whose last batch the worker gives back what it freed."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run


def free(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has none of the names that an operator is about to add (whatever their case); otherwise a ValueError."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"columns exist already: {', '.join(sorted(taken))}")
    return df
