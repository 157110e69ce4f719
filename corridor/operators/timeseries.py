"""Operators on tracks: rows of one key in the order of time.

Spark keeps no row order, so every operator takes the keys and the complete order (time and a tie-breaker).
Equal windows share one shuffle; no operator here needs Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, millis, plus_millis, seconds_between
from ..schema import floats, over, require

Names = str | Sequence[str]


def _list(x: Names) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def resample(df: DataFrame, keys: Names, ts: str, width: str, order: Names, means: Sequence[str] | None = None, firsts: Sequence[str] | None = None) -> DataFrame:
    """One row for each key and time bucket: means of floats, the first of all other columns."""
    keys, order = _list(keys), _list(order)
    require(df, [*keys, ts, *order])
    rest = [c for c in df.columns if c not in (*keys, ts)]
    means = [c for c in rest if c in floats(df)] if means is None else list(means)
    firsts = [c for c in rest if c not in means] if firsts is None else list(firsts)
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    aggs = [F.avg(c).alias(c) for c in means] + [F.min_by(c, at).alias(c) for c in firsts]
    return df.groupBy(*keys, F.window(ts, width).start.alias("bucket")).agg(*aggs, F.count("*").alias("n"))


def short_tracks_removed(df: DataFrame, keys: Names, ts: str, order: Names, x: str, y: str, least_distance: float, least_seconds: int) -> DataFrame:
    """Tracks whose first and last positions are ``least_distance`` apart or more and whose whole seconds reach the least."""
    w = over(_list(keys), _list(order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [(F.first(c).over(w), F.last(c).over(w)) for c in (x, y, ts)]
    (x0, x1), (y0, y1), (t0, t1) = ends
    marked = df.withColumn("__d", F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))).withColumn("__t", F.floor(seconds_between(t1, t0)))
    return marked.where((F.col("__d") >= least_distance) & (F.col("__t") >= least_seconds)).drop("__d", "__t")


def short_spans_removed(df: DataFrame, keys: Names, ts: str, s: str, least_distance: float, least_seconds: float) -> DataFrame:
    """Tracks that extend over more than both limits (exclusive) in time and along s; null spans fail."""
    w = over(_list(keys))
    t = seconds_between(F.max(ts).over(w), F.min(ts).over(w))
    d = F.max(s).over(w) - F.min(s).over(w)
    return df.withColumn("__k", (t > least_seconds) & (d > least_distance)).where("__k").drop("__k")


def tail_trimmed(df: DataFrame, keys: Names, order: Names, predicted: Column) -> DataFrame:
    """Without the rows behind a track's last one that is not predicted."""
    w = over(_list(keys), _list(order)).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("__k", F.max(F.coalesce(~predicted, F.lit(False))).over(w)).where("__k").drop("__k")


def changes(df: DataFrame, keys: Names, order: Names, columns: Names, into: str, null_changes: bool = False, extra: Column | None = None) -> DataFrame:
    """Running number, from 0, of the stretches in which ``columns`` keep their values (and ``extra`` is false).

    With ``null_changes`` a null after a null begins a stretch as well.
    """
    w = over(_list(keys), _list(order))
    first = F.row_number().over(w) == 1
    flag = F.lit(False)
    for c in _list(columns):
        before = F.lag(c).over(w)
        same = (F.col(c) == before) if null_changes else F.col(c).eqNullSafe(before)
        flag = flag | ~F.coalesce(same, F.lit(False))
    if extra is not None:
        flag = flag | F.coalesce(extra, F.lit(False))
    marked = df.withColumn("__c", F.when(first, 0).otherwise(flag.cast("int")))
    return marked.withColumn(into, F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def time_delta(df: DataFrame, keys: Names, ts: str, order: Names, into: str = "time_diff") -> DataFrame:
    """Seconds since the row before; the first row takes the second one's value."""
    w = over(_list(keys), _list(order))
    step = seconds_between(F.col(ts), F.lag(ts).over(w))
    return df.withColumn(into, F.coalesce(step, seconds_between(F.lead(ts).over(w), F.col(ts))))


def approaching(df: DataFrame, keys: Names, order: Names, dist: str, into: str = "approaching") -> DataFrame:
    """Whether the distance shrinks; the first row looks forward."""
    w = over(_list(keys), _list(order))
    d = F.coalesce(F.col(dist) - F.lag(dist).over(w), F.lead(dist).over(w) - F.col(dist))
    return df.withColumn(into, d < 0)


def sessions(df: DataFrame, keys: Names, ts: str, order: Names, gap_seconds: float, split_seconds: float | None = None, into: str = "session") -> DataFrame:
    """A new session after a gap beyond the limit; with ``split_seconds`` also a part for each stretch of that length."""
    keys = _list(keys)
    w = over(keys, _list(order))
    gap = seconds_between(F.col(ts), F.lag(ts).over(w)) > gap_seconds
    out = df.withColumn("__g", F.coalesce(gap, F.lit(False)).cast("int"))
    out = out.withColumn(into, F.sum("__g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__g")
    if split_seconds is not None:
        start = F.min(ts).over(over([*keys, into]))
        out = out.withColumn(f"{into}_part", F.floor(seconds_between(F.col(ts), start) / split_seconds))
    return out


def forward_filled(df: DataFrame, keys: Names, order: Names, columns: Names) -> DataFrame:
    w = over(_list(keys), _list(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in _list(columns)})


def next_filled(df: DataFrame, keys: Names, order: Names, columns: Names) -> DataFrame:
    """Nulls take the next row's value (one row at most)."""
    w = over(_list(keys), _list(order))
    return df.withColumns({c: F.coalesce(F.col(c), F.lead(c).over(w)) for c in _list(columns)})


def interpolated(df: DataFrame, keys: Names, order: Names, columns: Names) -> DataFrame:
    """Inner nulls by straight lines over row positions; nulls at either end stay."""
    w = over(_list(keys), _list(order))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = df.withColumn("__i", F.row_number().over(w))
    for c in _list(columns):
        known = F.when(F.col(c).isNotNull(), F.col("__i"))
        v0, i0 = F.last(c, ignorenulls=True).over(back), F.last(known, ignorenulls=True).over(back)
        v1, i1 = F.first(c, ignorenulls=True).over(ahead), F.first(known, ignorenulls=True).over(ahead)
        out = out.withColumn(c, F.coalesce(F.col(c), v0 + (v1 - v0) * (F.col("__i") - i0) / (i1 - i0)))
    return out.drop("__i")


def rolling_mean(df: DataFrame, keys: Names, order: Names, column: str, before: int, after: int, into: str, full: bool = False) -> DataFrame:
    """Mean of the rows from ``before`` back to ``after`` ahead; with ``full`` only where all of them exist."""
    w = over(_list(keys), _list(order)).rowsBetween(-before, after)
    mean = F.avg(column).over(w)
    return df.withColumn(into, F.when(F.count(F.lit(1)).over(w) == before + after + 1, mean) if full else mean)


def densified(df: DataFrame, keys: Names, ts: str, step_ms: int, extend_ms: int, columns: Sequence[str], include_start: bool = False, within: Names = ()) -> DataFrame:
    """Every key on a regular grid from its first (or first plus a step) to its last time plus an extension.

    Observed rows are matched by rounding their time to the step; ``predicted`` marks grid times beyond the last one,
    ``missing`` times without a row.  Leading gaps go, inner ones are filled forward.  Each observed time makes the rows up to
    the next one, so observations are dealt out once.  ``within`` names columns that are the same on all rows of a key; rows
    dealt by them stay where they are.
    """
    own = [*_list(within), *_list(keys)]
    at = F.floor((millis(ts) + F.lit(step_ms / 2)) / F.lit(step_ms)).cast("long")
    seen = df.dropna(subset=_list(keys)).withColumn("__g", at).where("__g IS NOT NULL").groupBy(*own, "__g").agg(*[F.min_by(c, F.col(ts)).alias(c) for c in columns])
    seen = seen.withColumn("__a", F.min("__g").over(over(own)) + (0 if include_start else 1)).withColumn("__b", F.max("__g").over(over(own)))
    stop = F.col("__b") + int(extend_ms // step_ms)
    seen = seen.where((F.col("__g") >= F.col("__a")) & (F.col("__g") <= stop))
    w = over(own, "__g")
    last = F.least(F.coalesce(F.lead("__g").over(w) - 1, stop), stop)
    filled = {c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}
    out = seen.withColumns({**filled, "__z": last}).withColumn("__t", F.explode(F.sequence("__g", "__z")))
    time = plus_millis(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("__t") * step_ms).alias(ts)
    return out.select(*own, time, *columns, (F.col("__t") > F.col("__b")).alias("predicted"), (F.col("__t") != F.col("__g")).alias("missing"))


def standing_still(df: DataFrame, keys: Names, order: Names, speed: str, columns: Names, limit: float = 0.01) -> DataFrame:
    """While this and the last speed lie below the limit, ``columns`` keep the last moving row's values."""
    w = over(_list(keys), _list(order))
    still = (F.col(speed) < limit) & (F.lag(speed).over(w) < limit)
    out = df.withColumn("__s", F.coalesce(still, F.lit(False)))
    out = out.withColumns({c: F.when(~F.col("__s"), F.col(c)) for c in _list(columns)})
    return forward_filled(out, keys, order, columns).drop("__s")


def repeated_frames_removed(df: DataFrame, keys: Names, order: Names, counter: str, drop_first: bool = False) -> DataFrame:
    """Without rows whose counter equals the row before's."""
    w = over(_list(keys), _list(order))
    moved = F.col(counter) != F.lag(counter).over(w)
    return df.withColumn("__m", F.coalesce(moved, F.lit(not drop_first))).where("__m").drop("__m")


def next_as_end(df: DataFrame, keys: Names, ts: str, order: Names, into: str) -> DataFrame:
    """Each row's interval ends where the next row of its key begins."""
    return df.withColumn(into, F.lead(ts).over(over(_list(keys), _list(order))))


def differences(df: DataFrame, keys: Names, order: Names, column: str, into: str, centred: bool = False) -> DataFrame:
    w = over(_list(keys), _list(order))
    return df.withColumn(into, F.lead(column).over(w) - F.lag(column).over(w) if centred else F.col(column) - F.lag(column).over(w))


def positions(df: DataFrame, keys: Names, order: Names, into: str = "position") -> DataFrame:
    """Row index of each key, from 0."""
    return df.withColumn(into, F.row_number().over(over(_list(keys), _list(order))) - 1)


def time_positions(df: DataFrame, keys: Names, ts: str, into: str = "time_index") -> DataFrame:
    """Index of the different times of each key, from 0."""
    return df.withColumn(into, F.dense_rank().over(over(_list(keys), ts)) - 1)


def running_sum(df: DataFrame, keys: Names, order: Names, column: str, into: str) -> DataFrame:
    return df.withColumn(into, F.sum(column).over(over(_list(keys), _list(order)).rowsBetween(Window.unboundedPreceding, 0)))


def whole_track(df: DataFrame, keys: Names, **aggs: Column) -> DataFrame:
    """Aggregates of a whole track on each of its rows."""
    w = over(_list(keys))
    return df.withColumns({k: v.over(w) for k, v in aggs.items()})


def filtered_path(df: DataFrame, keys: Names, order: Names, column: str, condition: Column, into: str) -> DataFrame:
    """Sum of the steps of ``column`` between the rows that meet the condition, on every row of the key."""
    w = over(_list(keys), _list(order)).rowsBetween(Window.unboundedPreceding, -1)
    value = F.when(condition, F.col(column))
    step = F.when(condition, F.col(column) - F.last(value, ignorenulls=True).over(w))
    return df.withColumn("__s", step).withColumn(into, F.coalesce(F.sum("__s").over(over(_list(keys))), F.lit(0.0))).drop("__s")


def first_per_key(df: DataFrame, keys: Names, order: Names, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("__n", F.row_number().over(over(_list(keys), _list(order)))).where(F.col("__n") <= n).drop("__n")


def every_nth(df: DataFrame, keys: Names, order: Names, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(over(_list(keys), _list(order)))).where((F.col("__n") - 1) % n == 0).drop("__n")


def filter_input(df: DataFrame, keys: Names, ts: str, order: Names, measurement: Sequence[str], least_steps: int = 10, drop_longest: bool = False) -> DataFrame:
    """Rows for a recursive filter: a measurement array, a time index, and only tracks with more than ``least_steps``."""
    out = positions(time_delta(df, keys, ts, order), keys, order, "time_ind")
    out = out.withColumn("measurement", F.array(*[col(c).cast("double") for c in measurement]))
    out = whole_track(out, keys, max_time=F.max("time_ind")).where(F.col("max_time") > least_steps)
    if drop_longest:
        out = out.crossJoin(F.broadcast(out.agg(F.max("max_time").alias("__m")))).where("max_time < __m").drop("__m")
    return out
