"""Ground truth from a GPS probe, sensor calibration against it, and low-pass filtering."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import seconds_between
from ..schema import over
from ..sources.writers import saved
from .geo import label_lanes, map_to_lane, second_lane_offsets, with_utm
from .kalman import by_track
from .timeseries import Names, _list, changes

FRONT_OFFSET, BACK_OFFSET = 2.91, 1.99
LENGTH = FRONT_OFFSET + BACK_OFFSET


def probe_track(df: DataFrame, keys: Names, ts: str, lon: str, lat: str, zone: int = 16, front: float = FRONT_OFFSET, back: float = BACK_OFFSET) -> DataFrame:
    """Positions, headings, driven distance, speeds by centred differences, and both ends of the vehicle."""
    keys = _list(keys)
    w = over(keys, ts)
    out = with_utm(df, lon, lat, zone)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    out = out.withColumn("dx", F.coalesce(dx, F.lead("x").over(w) - F.col("x"))).withColumn("dy", F.coalesce(dy, F.lead("y").over(w) - F.col("y")))
    out = out.withColumn("heading", F.atan2("dy", "dx")).withColumn("dist", F.when(F.lag("x").over(w).isNull(), 0.0).otherwise(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))))
    out = out.withColumn("cum_dist", F.sum("dist").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ex, ey = F.lead("x").over(w) - F.lag("x").over(w), F.lead("y").over(w) - F.lag("y").over(w)
    out = out.withColumn("speed", F.sqrt(ex * ex + ey * ey) / seconds_between(F.lead(ts).over(w), F.lag(ts).over(w)))
    for name, off in (("front", front), ("back", -back)):
        out = out.withColumn(f"{name}_x", F.col("x") + off * F.cos("heading")).withColumn(f"{name}_y", F.col("y") + off * F.sin("heading"))
    return out


def on_lane(df: DataFrame, lanes: DataFrame, ident: Sequence[str], x: str = "x", y: str = "y", trim: float = 150.0) -> DataFrame:
    """Probe rows on a lane, without both ends of it."""
    out = map_to_lane(df, lanes, ident, x, y).where("lane is not null")
    ends = lanes.groupBy(F.col("lane").alias("__l")).agg(F.max("s").alias("__m"))
    return out.join(F.broadcast(ends), F.col("lane") == F.col("__l")).where((F.col("s") > trim) & (F.col("s") < F.col("__m") - trim)).drop("__l", "__m")


def along_lane(df: DataFrame, front: float = FRONT_OFFSET, back: float = BACK_OFFSET) -> DataFrame:
    """Rows on a lane with angle_diff, speeds along and across it, both ends and the length along it."""
    turn = F.col("heading") - F.col("heading_lane")
    out = df.withColumn("angle_diff", F.atan2(F.sin(turn), F.cos(turn)))
    along, across = F.cos("angle_diff"), F.sin("angle_diff")
    return out.withColumns({
        "s_velocity": F.col("speed") * along, "d_velocity": F.col("speed") * across,
        "front_s": F.col("s") + front * along, "back_s": F.col("s") - back * along, "length_s": (front + back) * along,
    })


def snapped(df: DataFrame, main: DataFrame, full: DataFrame, ident: Sequence[str], step: float, trim: float = 150.0) -> DataFrame:
    """Probe rows on the main lanes (s, d, speeds along and across, both ends) with the index of the lane they drive on."""
    out = along_lane(on_lane(df, main, ident, trim=trim))
    return label_lanes(out, second_lane_offsets(full), ident, "s", "d", step)


def continuous_segments(df: DataFrame, keys: Names, ts: str, lane: str, gap_seconds: float = 10.0) -> DataFrame:
    """A new sequence after a long gap or on another lane; rows without a lane go."""
    w = over(_list(keys), ts)
    gap = seconds_between(F.col(ts), F.lag(ts).over(w)) > gap_seconds
    return changes(df.where(F.col(lane).isNotNull()), keys, ts, lane, "sequence", extra=gap)


def calibrate(points: DataFrame, lanes: DataFrame, sensor: str, ident: Sequence[str], x: str, y: str, heading: str, angles: Sequence[float], shifts: Sequence[tuple[float, float]], angle_gate: float = 10.0, bound: float = 5.0) -> DataFrame:
    """Best small rotation (radians) and shift of each sensor: the mean distance to lanes that run the same way plus the
    share of points without one is least.  All candidates are tried in one pass over the points."""
    grid = [(float(a), float(dx), float(dy)) for a in angles for dx, dy in shifts]
    loss = losses(points, lambda _: grid, lanes, sensor, x, y, heading, angle_gate, bound)
    return loss.groupBy(sensor).agg(F.min(F.struct("loss", "k", "a", "dx", "dy")).alias("b")).select(sensor, F.col("b.a").alias("angle"), "b.dx", "b.dy", "b.loss")


def solved(points: DataFrame, lanes: DataFrame, sensor: str, ident: Sequence[str], x: str, y: str, heading: str, turn: float = 5.0, shift: float = 3.0, rounds: int = 7, angle_gate: float = 10.0, bound: float = 6.0) -> DataFrame:
    """Rotation (radians) and shift of each sensor with the least loss within +-turn degrees and +-shift metres.

    Each round tries a grid of 5 x 3 x 3 candidates around every sensor's best one so far, in one pass over all points, and
    halves its width; one row a sensor reaches the driver.  The loss is that of ``calibrate``, whose least value so far is
    among the candidates of every round, so it never grows.
    """
    points, near = saved(weighed(points.where(F.col(sensor).isNotNull()), sensor, x, y, heading)), near_lanes(lanes, bound)
    best = [(r[0], 0.0, 0.0, 0.0, None) for r in points.select(sensor).distinct().collect()]  # a row a sensor
    wide, far, spark = float(np.radians(turn)), shift, points.sparkSession
    inside = lambda v, limit: max(min(v, limit), -limit)
    for n in range(rounds):
        a, d = wide / 2**n, far / 2**n
        cells = [(i * a / 2, j * d, m * d) for i in (-2, -1, 0, 1, 2) for j in (-1, 0, 1) for m in (-1, 0, 1)]
        tried = {s: sorted({(inside(a0 + p, wide), inside(x0 + q, far), inside(y0 + r, far)) for p, q, r in cells}) for s, a0, x0, y0, _ in best}
        loss = losses(points, tried.__getitem__, near, sensor, x, y, heading, angle_gate, bound)
        least = F.min(F.struct("loss", F.abs(F.col("a")).alias("t"), "a", "dx", "dy")).alias("b")
        best = [tuple(r) for r in loss.groupBy(sensor).agg(least).select(sensor, "b.a", "b.dx", "b.dy", "b.loss").collect()]
    return spark.createDataFrame(best, f"{sensor} {points.schema[sensor].dataType.simpleString()}, angle double, dx double, dy double, loss double")


def weighed(points: DataFrame, sensor: str, x: str, y: str, heading: str) -> DataFrame:
    """Different points of each sensor with the number of their rows, __n."""
    xyh = [F.col(c).cast("double").alias(c) for c in (x, y, heading)]
    return points.select(sensor, *xyh).groupBy(sensor, x, y, heading).agg(F.count("*").alias("__n"))


class Near:
    """Lane points that can be the nearest one within the bound, for every square of a fine grid.

    Of lane points of one heading those go that are farther from all of a square than another one is from any of it, so
    whatever headings a gate allows, the nearest of those is among the rest.  Points that follow each other evenly on a line
    under one heading need no squares: a projection tells which of them is the nearest.
    """

    STRAIGHT, LEAST = 8, 32  # so many lines at most, with so many points at least

    def __init__(self, x: np.ndarray, y: np.ndarray, angle: np.ndarray, bound: float, cuts: int = 8):
        self.x, self.y, self.angle, self.bound, self.width = x, y, angle, bound, bound / cuts
        self.lines = self._lines()
        rest = np.ones(len(x), bool)
        for a, b in self.lines:
            rest[a:b] = False
        rest = np.flatnonzero(rest)
        w, reach = self.width, np.arange(-cuts - 1, cuts + 2)
        keys, pts = [], []
        for k in range(0, len(rest), 4096):
            i, gx, gy = (v.ravel() for v in np.meshgrid(rest[k : k + 4096], reach, reach, indexing="ij"))
            gx, gy = gx + np.floor(x[i] / w), gy + np.floor(y[i] / w)
            near = self._apart(i, gx, gy)[0] <= bound * (1 + 1e-9)
            keys.append(np.stack([gx[near], gy[near]], axis=1))
            pts.append(i[near])
        cell = np.concatenate(keys) if keys else np.zeros((0, 2))
        i = np.concatenate(pts) if pts else np.zeros(0, int)
        self.low = cell.min(axis=0) if len(cell) else np.zeros(2)
        self.size = cell.max(axis=0) - self.low + 1 if len(cell) else np.zeros(2)
        at = self._key(cell[:, 0], cell[:, 1])
        least, most = self._apart(i, cell[:, 0], cell[:, 1])
        group = np.unique(np.stack([at, np.unique(angle, return_inverse=True)[1][i]]), axis=1, return_inverse=True)[1].ravel()
        bar = np.full(group.max(initial=-1) + 1, np.inf)
        np.minimum.at(bar, group, most)
        kept = least <= bar[group] * (1 + 1e-9)
        at, i = at[kept], i[kept]
        order = np.argsort(at, kind="stable")
        self.points = i[order]
        self.keys, self.first, self.count = np.unique(at[order], return_index=True, return_counts=True)

    def _lines(self) -> list[tuple[int, int]]:
        """First and last index of the longest stretches of even steps and one heading; none where there are too many."""
        if len(self.x) < self.LEAST:
            return []
        dx, dy = np.diff(self.x), np.diff(self.y)
        scale = 1e-9 * (1 + np.abs(self.x).max() + np.abs(self.y).max()) / max(len(self.x), 1)
        turn = (np.abs(np.diff(dx)) > scale) | (np.abs(np.diff(dy)) > scale) | (self.angle[1:-1] != self.angle[:-2])
        out, edge = [], [0, *(np.flatnonzero(turn) + 1).tolist(), len(self.x) - 1]
        for a, b in zip(edge[:-1], edge[1:], strict=True):  # steps a to b - 1 are even
            b += self.angle[b] == self.angle[a]  # the last point of a stretch may have the next one's heading
            a = max(a, out[-1][1]) if out else a
            if b - a >= self.LEAST and np.hypot(dx[a], dy[a]) > 1e-6 and (self.angle[a:b] == self.angle[a]).all():
                out.append((a, int(b)))
        return out if len(out) <= self.STRAIGHT else []

    def _apart(self, i, gx, gy) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of lane points from squares."""
        dx, dy = np.abs(self.x[i] / self.width - gx - 0.5), np.abs(self.y[i] / self.width - gy - 0.5)
        return self.width * np.hypot(np.maximum(dx - 0.5, 0), np.maximum(dy - 0.5, 0)), self.width * np.hypot(dx + 0.5, dy + 0.5)

    def _key(self, gx, gy):
        return ((gx - self.low[0]) * self.size[1] + gy - self.low[1]).astype(np.int64)

    def distance(self, x: np.ndarray, y: np.ndarray, heading: np.ndarray, gate: float) -> np.ndarray:
        """Distance of each place to the nearest lane point of a heading within the gate (radians); infinite beyond the bound."""
        out = np.full(len(x), np.inf)
        for a, b in self.lines:
            sx, sy = (self.x[b - 1] - self.x[a]) / (b - 1 - a), (self.y[b - 1] - self.y[a]) / (b - 1 - a)
            at = np.rint(((x - self.x[a]) * sx + (y - self.y[a]) * sy) / (sx * sx + sy * sy))
            at = a + np.where(np.isfinite(at), np.clip(at, 0, b - 1 - a), 0).astype(np.int64)
            off = heading - self.angle[a]
            d2 = (x - self.x[at]) ** 2 + (y - self.y[at]) ** 2
            ok = (np.abs(off - 2 * np.pi * np.round(off / (2 * np.pi))) <= gate) & (d2 <= self.bound * self.bound)
            out = np.minimum(out, np.sqrt(np.where(ok, d2, np.inf)))
        if not len(self.keys):
            return out
        gx, gy = np.floor(x / self.width), np.floor(y / self.width)
        on = np.flatnonzero((gx >= self.low[0]) & (gx < self.low[0] + self.size[0]) & (gy >= self.low[1]) & (gy < self.low[1] + self.size[1]))
        key = self._key(gx[on], gy[on])
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        there = self.keys[at] == key if len(self.keys) else np.zeros(len(on), bool)
        on, at = on[there], at[there]
        if not len(on):
            return out
        count = self.count[at]
        start = np.cumsum(count) - count
        row = np.repeat(on, count)
        lane = self.points[np.repeat(self.first[at] - start, count) + np.arange(len(row))]
        off = heading[row] - self.angle[lane]
        d2 = (x[row] - self.x[lane]) ** 2 + (y[row] - self.y[lane]) ** 2
        d2[~((np.abs(off - 2 * np.pi * np.round(off / (2 * np.pi))) <= gate) & (d2 <= self.bound * self.bound))] = np.inf
        out[on] = np.minimum(out[on], np.sqrt(np.minimum.reduceat(d2, start)))
        return out


def near_lanes(lanes: DataFrame, bound: float) -> Near:
    """Lanes are configuration: their points reach the driver once and go along with the tasks."""
    return Near(*lanes.select("x_lane", "y_lane", "angle").toPandas().to_numpy(float).T, bound)


def losses(points: DataFrame, tried: Callable[[object], Sequence[tuple[float, float, float]]], lanes: DataFrame | Near, sensor: str, x: str, y: str, heading: str, angle_gate: float, bound: float) -> DataFrame:
    """(sensor, k, a, dx, dy, loss) for the candidates (a, dx, dy) that ``tried`` has for a sensor: the mean distance plus the
    share of points without a lane.

    Candidates meet the points in Arrow batches, and a task gives one row for each sensor and candidate, so nothing is
    multiplied by their number.  Equal points count at once.
    """
    if "__n" not in points.columns:
        points = weighed(points, sensor, x, y, heading)
    shared = points.sparkSession.sparkContext.broadcast(lanes if isinstance(lanes, Near) else near_lanes(lanes, bound))
    gate, block = float(np.radians(angle_gate)), 200_000

    def run(batches):
        near, got = shared.value, {}
        for batch in batches:
            pdf = batch.to_pandas()
            for name, own in pdf.groupby(sensor, dropna=False, sort=False):
                name = None if pd.isna(name) else name
                px, py, h, n = (own[c].to_numpy(float) for c in (x, y, heading, "__n"))
                sums = got.setdefault(name, np.zeros((len(tried(name)), 3)))
                for k, (a, dx, dy) in enumerate(tried(name)):
                    for i in range(0, len(px), block):
                        u, v, t, m = (z[i : i + block] for z in (px, py, h, n))
                        dist = near.distance(u * np.cos(a) - v * np.sin(a) + dx, u * np.sin(a) + v * np.cos(a) + dy, t + a, gate)
                        hit = np.isfinite(dist)
                        sums[k] += m.sum(), m[hit].sum(), (m[hit] * dist[hit]).sum()
        rows = [(name, k, *map(float, tried(name)[k]), *map(float, sums[k])) for name, sums in got.items() for k in range(len(sums))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    schema = T.StructType([T.StructField(sensor, points.schema[sensor].dataType)]).add("k", "long")
    for c in ("a", "dx", "dy", "all", "hit", "far"):
        schema = schema.add(c, "double")
    kinds = to_arrow_schema(schema)
    spark = points.sparkSession  # a number of its own, since adaptive execution would put points of few bytes into one task
    points = points.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    total = points.mapInArrow(run, schema).groupBy(sensor, "k", "a", "dx", "dy").agg(*[F.sum(c).alias(c) for c in ("all", "hit", "far")])
    loss = (F.col("all") - F.col("hit")) / F.col("all") + F.when(F.col("hit") > 0, F.col("far") / F.col("hit")).otherwise(F.lit(float(bound)))
    return total.select(sensor, "k", "a", "dx", "dy", loss.alias("loss"))


def butterworth(order: int = 5, cutoff: float = 0.25, rate: float = 10.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a digital Butterworth low-pass by the bilinear transform."""
    warped = 2 * rate * np.tan(np.pi * cutoff / rate)
    out = []
    for k in range((order + 1) // 2):
        theta = np.pi * (2 * k + order + 1) / (2 * order)
        p = warped * np.exp(1j * theta)
        if order % 2 and k == order // 2:
            den = np.array([2 * rate + warped, warped - 2 * rate, 0.0])
            num = np.array([warped, warped, 0.0])
        else:
            a1, a0, c = -2 * p.real, abs(p) ** 2, 2 * rate
            den = np.array([c * c + a1 * c + a0, 2 * a0 - 2 * c * c, c * c - a1 * c + a0])
            num = a0 * np.array([1.0, 2.0, 1.0])
        out.append((num / den[0], den / den[0]))
    return out


def zero_phase(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]], pad: int = 18) -> np.ndarray:
    """Forward and backward filtering with odd reflection at both ends; short input comes back unchanged."""
    return zero_phases(x, np.array([len(x)]), sections, pad) if len(x) > pad else x


def zero_phases(x: np.ndarray, sizes: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]], pad: int = 18) -> np.ndarray:
    """The same for tracks of the given sizes laid end to end; tracks of one length step through time together."""
    out, first = x.copy(), np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > pad]):
        for tracks in np.array_split(np.flatnonzero(sizes == n), -(-int((sizes == n).sum()) * int(n) // 2_000_000)):
            at = first[tracks][None, :] + np.arange(n)[:, None]
            v = x[at]
            y = np.concatenate([2 * v[:1] - v[pad:0:-1], v, 2 * v[-1:] - v[-2 : -pad - 2 : -1]])
            for _ in range(2):
                for b, a in sections:
                    z1 = (b[1] + b[2] - (a[1] + a[2]) * b.sum() / a.sum()) * y[0]  # steady state of the first value
                    z2 = (b[2] - a[2] * b.sum() / a.sum()) * y[0]
                    done = np.empty_like(y)
                    for i, row in enumerate(y):
                        done[i] = b[0] * row + z1
                        z1, z2 = b[1] * row - a[1] * done[i] + z2, b[2] * row - a[2] * done[i]
                    y = done
                y = y[::-1]
            out[at] = y[pad:-pad]
    return out


def low_passed(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], cutoff: float = 0.25, rate: float = 10.0, degree: int = 5, groups: int | None = None) -> DataFrame:
    """Columns filtered along each track without a phase shift."""
    sections = butterworth(degree, cutoff, rate)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pd.factorize(pdf[key], use_na_sentinel=False)[0]
        return pdf.assign(**{c: zero_phases(pdf[c].to_numpy(float), np.bincount(code), sections) for c in columns})

    schema = ", ".join(f"`{f.name}` {'double' if f.name in columns else f.dataType.simpleString()}" for f in df.schema)
    return by_track(df, key, order, run, schema, groups)
