"""Cleaning chains from raw sensor rows to lane-mapped tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import geo, timeseries
from ..schema import require

RAW = ["ui32_objectID", "ip", "epoch_time", "f32_positionX_m", "f32_positionY_m", "f32_directionX", "f32_directionY", "f32_velocityInDir_mps", "ui16_predictionCount"]


def filtered(df: DataFrame, condition: Column | None = None) -> DataFrame:
    return df if condition is None else df.where(condition)


def small_subset(df: DataFrame, ts: str = "epoch_time", day: int = 13, hour: int = 12) -> DataFrame:
    """One hour of one day of the month."""
    return df.where((F.dayofmonth(ts) == day) & (F.hour(ts) == hour))


def range_limited(df: DataFrame, sensors: Sequence[str], month: int = 10, limit: float = 275.0) -> DataFrame:
    """Some sensors see less far in one month."""
    return df.where(C.only_if(F.col("ip").isin(*sensors) & (F.month("epoch_time") == month), F.col("dist") < limit))


def georeferenced(df: DataFrame, calibration: DataFrame) -> DataFrame:
    """Headings and positions in UTM by each sensor's angle and origin (a row a sensor, broadcast)."""
    out = df.join(F.broadcast(calibration), "ip")
    out = out.withColumn("heading", C.heading("f32_directionX", "f32_directionY"))
    x, y = C.rotated("f32_positionX_m", "f32_positionY_m", F.col("angle"))
    out = out.withColumn("rotated_x", x).withColumn("rotated_y", y).withColumn("heading_utm", F.col("angle") + F.col("heading"))
    return out.withColumn("utm_x", F.col("rotated_x") + F.col("origin_x")).withColumn("utm_y", F.col("rotated_y") + F.col("origin_y")).drop("angle", "origin_x", "origin_y")


def cleaned(df: DataFrame, calibration: DataFrame, width: str = "100 milliseconds", least_distance: float = 2.0, least_seconds: int = 1, condition: Column | None = None, view_degrees: float | None = None, radius: float | None = None) -> DataFrame:
    """Raw rows -> resampled, georeferenced tracks with range and direction of travel."""
    require(df, RAW)
    out = filtered(df, condition)
    if radius is not None:
        out = out.where(C.within_radius("f32_positionX_m", "f32_positionY_m", radius))
    if view_degrees is not None:
        out = out.where(C.within_view("f32_positionX_m", "f32_positionY_m", view_degrees))
    out = out.withColumn("object_id", C.object_key("ui32_objectID", "ip", "epoch_time"))
    out = timeseries.tail_trimmed(out, "object_id", "epoch_time", F.col("ui16_predictionCount") > 0)
    # Rotation and shift keep distances, so sensor coordinates serve as well.
    out = timeseries.short_tracks_removed(out, "object_id", "epoch_time", "epoch_time", "f32_positionX_m", "f32_positionY_m", least_distance, least_seconds)
    out = timeseries.resample(out, "object_id", "epoch_time", width, "epoch_time").withColumnRenamed("bucket", "epoch_time").drop("n")
    out = georeferenced(out, calibration).withColumn("dist", C.distance("f32_positionX_m", "f32_positionY_m"))
    return timeseries.approaching(out, "object_id", "epoch_time", "dist")


def on_lanes(df: DataFrame, lanes: DataFrame, bound: float = geo.SNAP_BOUND) -> DataFrame:
    return geo.map_to_lane(df, lanes, ["object_id", "epoch_time"], "utm_x", "utm_y", bound).where("lane is not null")
