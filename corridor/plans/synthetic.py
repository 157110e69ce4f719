"""A planted corridor: vehicles at known speeds on a straight road, seen by two sensors that overlap.

Everything follows from row numbers by hashes, so any executor builds the same rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANES = {"EBL1": np.array([[0.0, 0.0], [600.0, 0.0]]), "EBL2": np.array([[0.0, 3.6], [600.0, 3.6]])}


def noise(salt: int, *keys: str, scale: float = 1.0) -> Column:
    """Nearly normal numbers with the given deviation, from hashes of the keys."""
    u = [F.pmod(F.xxhash64(F.lit(salt + k), *keys), F.lit(1 << 20)) / float(1 << 20) for k in range(4)]
    return (u[0] + u[1] + u[2] + u[3] - 2.0) * float(scale * np.sqrt(3.0))


def corridor(spark: SparkSession, vehicles: int | DataFrame = 12, seconds: int = 25, gap_seconds: float = 6.0, jitter: float = 0.15) -> DataFrame:
    """Lane-mapped tracks of both sensors at 10 Hz: sensor 'a' sees s below 330 m, 'b' from 270 m on.

    ``vehicles`` is their number or a table whose first column has their ids.  Columns as the pipeline expects them, and truth_id and truth_s.
    """
    v = spark.range(vehicles) if isinstance(vehicles, int) else vehicles
    v = v.select(F.col(v.columns[0]).cast("long").alias("truth_id"))
    v = v.withColumn("speed", 18.0 + F.col("truth_id") % 3).withColumn("t0", F.col("truth_id") * gap_seconds)
    t = v.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(seconds * 10)))).withColumn("sec", F.col("step") / 10.0)
    t = t.withColumn("truth_s", 40.0 + F.col("speed") * F.col("sec"))
    seen = F.explode(F.array(F.when(F.col("truth_s") < 330, F.lit("a")), F.when(F.col("truth_s") > 270, F.lit("b"))))
    t = t.withColumn("ip", seen).where("ip IS NOT NULL AND truth_s < 560")
    keys = ("truth_id", "step", "ip")
    at = F.timestamp_add("MILLISECOND", (F.round((F.col("t0") + F.col("sec")) * 10) * 100).cast("long"), F.expr("TIMESTAMP_NTZ'2024-03-13 12:00:00'"))
    return t.select(
        F.xxhash64("truth_id", "ip").alias("object_id"), at.alias("epoch_time"), F.lit("EBL1").alias("lane"),
        (F.col("truth_s") + noise(1, *keys, scale=jitter)).alias("s"), noise(11, *keys, scale=jitter).alias("d"),
        F.lit(0.0).alias("heading_utm"), F.lit(0.0).alias("heading_lane"), (F.col("speed") + noise(21, *keys, scale=0.1)).alias("f32_velocityInDir_mps"),
        F.lit(2.3).alias("f32_distanceToFront_m"), F.lit(-2.2).alias("f32_distanceToBack_m"), F.lit(4.5).alias("f32_length_m"),
        F.abs(F.col("truth_s") - F.when(F.col("ip") == "a", 300.0).otherwise(560.0)).alias("dist"), F.lit(True).alias("approaching"),
        "truth_id", "truth_s", "ip",
    )
