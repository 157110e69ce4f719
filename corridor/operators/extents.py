"""Fronts and backs of vehicles along a lane, and the projection of measurements onto it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import wrap
from ..schema import over
from .timeseries import Names, _list, interpolated


def mean_length(df: DataFrame, length: str = "length_s", dist: str = "dist") -> DataFrame:
    """One row: the mean length seen from 10 to 50 m, __mean."""
    return df.where(F.col(dist).between(10, 50)).agg(F.avg(length).alias("__mean"))


def lifted_length(mean: Column, length: str = "length_s", dist: str = "dist") -> Column:
    return F.when((F.col(dist) >= 50) & (F.col(length) < mean), mean).otherwise(F.col(length))


def sides(rows: pd.DataFrame, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """front_s and back_s as mode 'mean' of ``front_back`` has them, from lengths that are lifted already."""
    ap = rows["approaching"].fillna(False).to_numpy(bool)
    front, back, length = (rows[c].to_numpy(float) for c in ("front_off", "back_off", "length_s"))
    return np.where(ap, s + front, s + back + length), np.where(ap, s + front - length, s + back)


def front_back(df: DataFrame, mode: str, s: str = "s", front: str = "front_off", back: str = "back_off", length: str = "length_s", dist: str = "dist", approaching: str = "approaching", keys: Names = (), order: Names = ()) -> DataFrame:
    """front_s and back_s of each row.

    'mean': beyond 50 m a shorter length than the mean one (seen from 10 to 50 m) is lifted to it; approaching
    vehicles show their front, others their back.  'nearest': the length seen nearest to the sensor.  'front': s is
    the front.  'centre': s is the reference point.  Backs have negative offsets.
    """
    c = F.col
    if mode in ("mean", "nearest"):
        if mode == "mean":
            df = df.crossJoin(F.broadcast(mean_length(df, length, dist)))
            own = lifted_length(c("__mean"), length, dist)
        else:
            df = df.withColumn("__mean", F.min_by(length, F.struct(dist, *_list(order))).over(over(_list(keys))))
            own = c("__mean")
        front_s = F.when(c(approaching), c(s) + c(front)).otherwise(c(s) + c(back) + own)
        back_s = F.when(c(approaching), c(s) + c(front) - own).otherwise(c(s) + c(back))
        return df.withColumn("front_s", front_s).withColumn("back_s", back_s).drop("__mean")
    if mode == "front":
        centre = c(s) - c(front)
        return df.withColumn("__s", centre).withColumn("front_s", c(s)).withColumn("back_s", c(s) - F.greatest(c(front), c(front) - c(back))).withColumn("centroid_s", c("__s")).drop("__s")
    if mode == "centre":
        return df.withColumn("front_s", c(s) + c(front)).withColumn("back_s", c(s) + c(back))
    raise ValueError(f"no such mode: {mode}")


def along_lane(df: DataFrame, keys: Names, order: Names, heading: str, lane_heading: str, speed: str, lengths: Names, limit_degrees: float = 30.0) -> DataFrame:
    """Speeds and lengths projected onto the lane.

    Angles beyond the limit are replaced by straight lines between their neighbours; rows without one go.
    """
    angle = wrap(F.col(heading) - F.col(lane_heading))
    out = df.withColumn("angle_diff", F.when(F.abs(angle) <= F.radians(F.lit(limit_degrees)), angle))
    out = interpolated(out, keys, order, "angle_diff").where(F.col("angle_diff").isNotNull())
    out = out.withColumn("s_velocity", F.col(speed) * F.cos("angle_diff")).withColumn("d_velocity", F.col(speed) * F.sin("angle_diff"))
    return out.withColumns({f"{c}_s": F.col(c) * F.cos("angle_diff") for c in _list(lengths)})
