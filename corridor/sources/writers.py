"""Sinks and the stage store."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..schema import narrowed


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a session whose executors are this machine's threads; on a cluster that
    would lose rows, so it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return where.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextlib.contextmanager
def shuffles_go(spark: SparkSession):
    """Shuffles of what is run inside are removed as soon as it ends."""
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, True)
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def saved(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df written below the shared folder and read back, which cuts its lineage and survives lost executors.

    Its shuffles, which nothing reads again, go at once; results are lazy and may read the folder at any time, so that goes
    when the driver ends.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/part-{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.option("compression", codec).parquet(path)
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what ``saved`` wrote for df; nothing may read it afterwards."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p, fs = _hadoop_path(df.sparkSession, path)
        fs.delete(p, True)


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", partition_by: Sequence[str] = (), as_floats: bool = False, drop: Sequence[str] = ()) -> None:
    """Parquet; optionally doubles as floats and without columns whose names contain one of ``drop``."""
    out = narrowed(df, drop) if as_floats or drop else df
    writer = out.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _inputs(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int, int]]:
    """Name, size and time of every file that the paths (files, folders or globs) stand for."""
    out = []
    for path in paths:
        p, fs = _hadoop_path(spark, path)
        todo = list(fs.globStatus(p) or [])
        while todo:
            x = todo.pop()
            if x.isDirectory():
                todo += list(fs.listStatus(x.getPath()))
            else:
                out.append((x.getPath().toString(), int(x.getLen()), int(x.getModificationTime())))
    return sorted(out)


class StageStore:
    """Results of stages as Parquet below a folder that all executors share.

    A stage is found again only if its name, its configuration and the files of ``inputs`` (names, sizes and times) are
    the same.
    """

    def __init__(self, spark: SparkSession, folder: str, enabled: bool = True):
        self.spark, self.folder, self.enabled = spark, folder.rstrip("/"), enabled

    def path(self, name: str, config: Mapping, inputs: Sequence[str] = ()) -> str:
        own = [dict(config), _inputs(self.spark, inputs)]
        mark = hashlib.sha256(json.dumps(own, sort_keys=True, default=str).encode()).hexdigest()[:16]
        return f"{self.folder}/{name}-{mark}.parquet"

    def get_or_compute(self, name: str, config: Mapping, stage: Callable[[], DataFrame], inputs: Sequence[str] = ()) -> DataFrame:
        if not self.enabled:
            return stage()
        path = self.path(name, config, inputs)
        p, fs = _hadoop_path(self.spark, f"{path}/_SUCCESS")
        if not fs.exists(p):
            with shuffles_go(self.spark):
                stage().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
