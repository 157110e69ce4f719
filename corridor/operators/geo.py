"""Road-aligned (Frenet) coordinates: lane tables, mapping points to lanes and back.

Lanes are small configuration: their tables are built by the driver, with one row for each step of arc length, and
joined by grid cells or by the index that a position implies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import crossing, lonlat_columns, respaced, shrink_free, smoothed_corners, utm_columns
from .joins import asof_nearest, nearest_on_grid

#: Half a lane on either side of two lanes of 3.55 m, and 0.5 m more.
LANE_WIDTH, SNAP_BOUND = 3.55, 5.825


def lane_points(xy: np.ndarray, step: float, corner_rounds: int = 5, taubin: bool = False, backward: bool = False) -> pd.DataFrame:
    """Rows lane_pt, x_lane, y_lane, s, angle.  The first point has s = step; the last vertex is dropped.

    With ``backward`` an angle looks back from its point instead of ahead.
    """
    xy = respaced(smoothed_corners(shrink_free(xy) if taubin else xy, corner_rounds), step)
    d = np.diff(xy, axis=0)
    angle = np.arctan2(d[:, 1], d[:, 0])
    if backward:
        angle = np.concatenate([angle[:1], angle[:-1]])
    n = len(d)
    return pd.DataFrame({"lane_pt": np.arange(n), "x_lane": xy[:-1, 0], "y_lane": xy[:-1, 1], "s": np.cumsum(np.hypot(d[:, 0], d[:, 1])), "angle": angle})


def network(spark: SparkSession, lanes: Mapping[str, np.ndarray], step: float = 1.0, **how) -> DataFrame:
    """Lane table of several named polylines, with a running index."""
    if not lanes:
        return spark.createDataFrame([], "lane string, lane_pt long, x_lane double, y_lane double, s double, angle double, lane_row long")
    got = pd.concat([lane_points(np.asarray(xy, float), step, **how).assign(lane=name) for name, xy in lanes.items()], ignore_index=True)
    got["lane_row"] = np.arange(len(got))
    return spark.createDataFrame(got[["lane", "lane_pt", "x_lane", "y_lane", "s", "angle", "lane_row"]])


def map_to_lane(points: DataFrame, lanes: DataFrame, ident: Sequence[str], x: str, y: str, bound: float = SNAP_BOUND, gate: Column | None = None) -> DataFrame:
    """Nearest lane point within the bound: lane, s, heading_lane, x_lane, y_lane and signed offset d (left is positive).

    Points off the network get nulls in all of them.
    """
    t = lanes.select("lane", F.col("s").alias("s"), F.col("angle").alias("heading_lane"), "x_lane", "y_lane")
    out = nearest_on_grid(points, t, ident, x, y, "x_lane", "y_lane", bound, ["lane", "s", "heading_lane"], gate)
    side = (F.col(y) - F.col("y_lane")) * F.cos("heading_lane") - (F.col(x) - F.col("x_lane")) * F.sin("heading_lane")  # exact on a straight lane, unlike a difference of angles
    return out.withColumn("d", F.when(side > 0, F.col("distance")).otherwise(-F.col("distance"))).drop("distance")


def frenet_to_xy(df: DataFrame, lanes: DataFrame, s: str, d: str, lane: str = "lane", step: float = 1.0, into: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Positions of (lane, s, d), linear between lane points; null outside a lane or of an unknown one.

    Lane points are evenly spaced, so a position names the two rows that it lies between: an equality join.
    Headings are interpolated through their sine and cosine.
    """
    p = lanes.select(F.col("lane").alias("__l"), (F.col("lane_pt") + 1).alias("__i"), F.struct("s", "x_lane", "y_lane", "angle").alias("__p"))
    w = lanes.select(F.col("lane").alias("__l"), F.col("lane_pt").alias("__i"), F.struct("s", "x_lane", "y_lane", "angle").alias("__q"))
    sizes = lanes.groupBy(F.col("lane").alias("__l")).agg(F.min("s").alias("__first"), F.max("s").alias("__last"), (F.max("lane_pt") + 1).alias("__n"))
    both = p.join(w, ["__l", "__i"], "full")  # a row for each interval and one beyond either end
    out = df.join(F.broadcast(sizes), F.col(lane) == F.col("__l"), "left").drop("__l")  # a row a lane
    unit = F.col("__last") / F.col("__n")
    inside = (F.col(s) >= F.col("__first")) & (F.col(s) <= F.col("__last"))
    at = F.when(inside, F.least(F.floor(F.col(s) / unit).cast("long"), F.col("__n") - 1))
    out = out.withColumn("__at", at).join(both.withColumnRenamed("__i", "__j"), (F.col(lane) == F.col("__l")) & (F.col("__at") == F.col("__j")), "left")
    t = F.when(F.col("__q.s").isNull(), F.lit(0.0)).otherwise((F.col(s) - F.col("__p.s")) / (F.col("__q.s") - F.col("__p.s")))
    lerp = lambda f: f("__p") + t * (F.coalesce(f("__q"), f("__p")) - f("__p"))
    x, y = lerp(lambda c: F.col(f"{c}.x_lane")), lerp(lambda c: F.col(f"{c}.y_lane"))
    sin, cos = lerp(lambda c: F.sin(f"{c}.angle")), lerp(lambda c: F.cos(f"{c}.angle"))
    norm = F.sqrt(sin * sin + cos * cos)
    out = out.withColumn(into[0], x - F.col(d) * sin / norm).withColumn(into[1], y + F.col(d) * cos / norm)
    return out.drop("__first", "__last", "__n", "__at", "__l", "__j", "__p", "__q")


def many_to_xy(df: DataFrame, lanes: DataFrame, ident: Sequence[str], places: Mapping[str, tuple[str, str]], lane: str = "lane", step: float = 1.0) -> DataFrame:
    """Several (s, d) of each row in one pass: name -> columns name_x, name_y."""
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(s).cast("double").alias("s"), F.col(d).cast("double").alias("d")) for k, (s, d) in places.items()]))
    long = df.select(*ident, lane, stack.alias("__v")).select(*ident, lane, F.col("__v.k").alias("__k"), F.col("__v.s").alias("__s"), F.col("__v.d").alias("__d"))
    xy = frenet_to_xy(long, lanes, "__s", "__d", lane, step, ("__x", "__y"))
    aggs = [F.max(F.when(F.col("__k") == k, F.col(f"__{c}"))).alias(f"{k}_{c}") for k in places for c in "xy"]
    return df.join(xy.groupBy(*ident).agg(*aggs), list(ident), "left")


def second_lane_offsets(lanes: DataFrame, bound: float = 10.0, suffix: str = "2") -> DataFrame:
    """Along each main lane, the distance to the nearest point of a lane whose name ends in ``suffix``: lane, s, d_other."""
    main = lanes.where(~F.col("lane").endswith(suffix))
    other = lanes.where(F.col("lane").endswith(suffix)).select(F.col("x_lane").alias("ox"), F.col("y_lane").alias("oy"), F.col("lane").alias("other"))
    out = nearest_on_grid(main.select("lane", "s", "x_lane", "y_lane"), other, ["lane", "s"], "x_lane", "y_lane", "ox", "oy", bound, ["other"])
    return out.where("distance is not null").select("lane", "s", F.col("distance").alias("d_other"))


def label_lanes(df: DataFrame, offsets: DataFrame, ident: Sequence[str], s: str, d: str, step: float, width: float = LANE_WIDTH) -> DataFrame:
    """lane_index 0 or 1 by the offset half-way to the second lane, null beyond either."""
    o = offsets.select("lane", F.col("s").alias("s_lane"), "d_other")
    out = asof_nearest(df, o, ["lane"], s, "s_lane", ["d_other"], 2 * step, ident).withColumn("d_cutoff", F.col("d_other") / 2)
    half = width / 2
    cut = F.coalesce("d_cutoff", F.lit(half))
    index = F.when((F.col(d) > -half) & (F.col(d) < cut), 0).when((F.col(d) >= cut) & (F.col(d) < half + F.col("d_other")), 1)
    return out.withColumn("lane_index", index)


def lane_crossings(lines: Mapping[str, np.ndarray], lanes: Mapping[str, np.ndarray], step: float) -> list[tuple[str, str, float]]:
    """(line, lane, s) where each line crosses each lane; for detector lines, of which there are few."""
    out = []
    for name, line in lines.items():
        for lane, xy in lanes.items():
            pts = lane_points(np.asarray(xy, float), step)
            hit = crossing(np.asarray(line, float), np.asarray(xy, float))
            if hit is not None:
                k = int(np.hypot(pts["x_lane"] - hit[0], pts["y_lane"] - hit[1]).argmin())
                out.append((name, lane, float(pts["s"][k])))
    return out


def exploded_lines(df: DataFrame, lines: str, ident: Sequence[str]) -> DataFrame:
    """Arrays of coordinate pairs as one row a vertex: vertex, x, y."""
    out = df.select(*ident, F.posexplode(lines).alias("vertex", "__p"))
    return out.select(*ident, "vertex", F.col("__p")[0].alias("x"), F.col("__p")[1].alias("y"))


def with_lonlat(df: DataFrame, x: str, y: str, zone: int) -> DataFrame:
    """lon and lat of UTM positions; nulls stay null.  No row index and no join back."""
    lon, lat = lonlat_columns(F.col(x), F.col(y), zone)
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.withColumns({"lon": F.when(known, lon), "lat": F.when(known, lat)})


def with_utm(df: DataFrame, lon: str, lat: str, zone: int) -> DataFrame:
    """x and y in UTM metres; nulls stay null."""
    px, py = utm_columns(F.col(lon), F.col(lat), zone)
    known = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    return df.withColumns({"x": F.when(known, px), "y": F.when(known, py)})
