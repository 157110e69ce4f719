"""Analytical queries on finished trajectories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, millis, seconds_between
from ..schema import floats, matching, over
from .timeseries import Names, _list


def duration_hours(df: DataFrame, ts: str) -> DataFrame:
    return df.agg((seconds_between(F.max(ts), F.min(ts)) / 3600).alias("hours"))


def trip_summary(df: DataFrame, keys: Names, ts: str, order: Names, x: str, y: str | None, speed: str, drop_nan: bool = True) -> DataFrame:
    """Path length, duration, speeds and rows of each vehicle; a null path counts as 0."""
    keys = _list(keys)
    w = over(keys, _list(order))
    dx = F.col(x) - F.lag(x).over(w)
    step = F.abs(dx) if y is None else F.sqrt(dx * dx + (F.col(y) - F.lag(y).over(w)) * (F.col(y) - F.lag(y).over(w)))
    out = df.withColumn("__step", step)
    path = F.when(~F.isnan("__step"), F.col("__step")) if drop_nan else F.col("__step")
    return out.groupBy(*keys).agg(
        F.coalesce(F.sum(path), F.lit(0.0)).alias("path"),
        seconds_between(F.max(ts), F.min(ts)).alias("seconds"),
        F.min(speed).alias("least_speed"),
        F.max(speed).alias("greatest_speed"),
        F.avg(F.when(finite(speed), F.col(speed))).alias("mean_speed"),
        F.count("*").alias("n"),
    )


def sane_trips(trips: DataFrame, least_path: float, least_seconds: float, greatest_speed: float) -> DataFrame:
    return trips.where((F.col("path") > least_path) & (F.col("seconds") > least_seconds) & (F.col("greatest_speed") < greatest_speed))


def mean_path_by(trips: DataFrame, flag: Column, name: str) -> DataFrame:
    """Mean path of the vehicles where the flag holds and where it does not."""
    return trips.groupBy(flag.alias(name)).agg(F.avg("path").alias("mean_path"), F.count("*").alias("n"))


def shares(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Share and number of the rows that meet each condition, on one row."""
    return df.agg(*[x for k, c in conditions.items() for x in (F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(f"{k}_share"), F.count_if(c).alias(f"{k}_count"))])


def percentile_profile(df: DataFrame, columns: Sequence[str], at: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """A row a column: count, mean, deviation, extremes and exact percentiles, all of them from one count of values."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null")
    out = stacked.groupBy("column").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("deviation"), F.min("v").alias("least"), F.max("v").alias("greatest"),
        F.percentile("v", F.array(*[F.lit(p) for p in at])).alias("__p"),
    )
    return out.select("column", "n", "mean", "deviation", "least", "greatest", *[F.col("__p")[k].alias(f"p{round(p * 100)}") for k, p in enumerate(at)])


def classes_by_length(df: DataFrame, length: str, limit: float = 8.0) -> DataFrame:
    return df.groupBy((F.col(length) > limit).alias("long")).agg(F.count("*").alias("n"), F.avg(length).alias("mean_length"))


def headways(pairs: DataFrame, follower: str, leader: str, ts: str, order: Sequence[str], s: str, speed: str, window: int = 30) -> DataFrame:
    """Pairs with distance, time headway, centred mean speed and acceleration of the follower."""
    w = over([follower, leader], [ts, *order])
    mean = F.avg(speed).over(w.rowsBetween(-(window // 2), window - window // 2 - 1))
    out = pairs.withColumn("mean_speed", mean).withColumn("headway", F.when(F.col(speed) != 0, F.col("s_gap") / F.col(speed)))
    step = seconds_between(F.col(ts), F.lag(ts).over(w))
    out = out.withColumn("row_index", F.row_number().over(over(follower, [ts, *order])) - 1)
    return out.withColumn("accel", F.when(step != 0, (F.col("mean_speed") - F.lag("mean_speed").over(w)) / step))


def headway_episodes(pairs: DataFrame, follower: str, leader: str, ts: str, order: Sequence[str], speed: str, frame: Sequence[str] = (), far: float = 100.0, free_headway: float = 5.0, cruise_speed: float = 20.0) -> DataFrame:
    """One row for each stretch in which a follower keeps its leader.

    With the columns of ``headways`` and a row_index, also what they say: headways, accelerations, the greatest one when
    the road is free, tenths of seconds of cruising, and the first and last index.
    """
    from .pairs import episodes

    optional = []
    if "headway" in pairs.columns:
        optional = [
            F.avg("headway").alias("mean_headway"), F.min("headway").alias("least_headway"), F.max("headway").alias("greatest_headway"),
            F.min("accel").alias("least_accel"), F.max("accel").alias("greatest_accel"),
            F.max(F.when(F.col("headway") > free_headway, F.col("accel"))).alias("free_accel"),
            (F.count_if((F.col("headway") > free_headway) & (F.col(speed) > cruise_speed)) / 10).alias("cruising"),
            F.min("row_index").alias("first_index"), F.max("row_index").alias("last_index"),
        ]
    aggs = [
        F.min(ts).alias("since"), F.max(ts).alias("until"), F.count("*").alias("n"),
        F.avg("s_gap").alias("mean_gap"), F.min("s_gap").alias("least_gap"), F.max("s_gap").alias("greatest_gap"),
        F.avg(speed).alias("mean_speed"), F.min(speed).alias("least_speed"), F.max(speed).alias("greatest_speed"),
        F.max(F.when(F.col("s_gap") < far, F.col(speed))).alias("greatest_speed_near"),
        (F.count_if(F.col("s_gap") < far) / 10).alias("near_tenths"),
        F.stddev_samp("s_gap").alias("gap_deviation"),
        *optional,
    ]
    return episodes(pairs, follower, leader, ts, order, aggs, frame).withColumn("seconds", seconds_between(F.col("until"), F.col("since")))


def calibrateable(eps: DataFrame, least_seconds: float, least_speed_range: float, most_gap: float) -> DataFrame:
    long_ = seconds_between(F.col("until"), F.col("since")) >= least_seconds
    return eps.where(long_ & (F.col("greatest_speed") - F.col("least_speed") >= least_speed_range) & (F.col("mean_gap") <= most_gap))


def in_window(eps: DataFrame, since: str, until: str) -> DataFrame:
    """Episodes that lie within a span of time."""
    return eps.where((F.col("since") >= F.to_timestamp_ntz(F.lit(since))) & (F.col("until") <= F.to_timestamp_ntz(F.lit(until))))


def scored_episodes(eps: DataFrame, scores: DataFrame, ident: str, score: str, follower: str, leader: str) -> DataFrame:
    """Episodes with the scores of both sides."""
    a = scores.select(F.col(ident).alias(follower), F.col(score).alias(f"{score}_{follower}"))
    b = scores.select(F.col(ident).alias(leader), F.col(score).alias(f"{score}_{leader}"))
    return eps.join(a, follower, "left").join(b, leader, "left")


def rmse(df: DataFrame, keys: Names, errors: Sequence[str]) -> DataFrame:
    return df.groupBy(*_list(keys)).agg(*[F.sqrt(F.sum(F.col(c) * F.col(c)) / F.count(c)).alias(f"{c}_rmse") for c in errors], F.count("*").alias("n"))


def by_pattern(df: DataFrame, keys: Names) -> DataFrame:
    """Aggregates chosen by column names: *_se is averaged under a root, *_ae is averaged, *_id counts values, others first."""
    keys = _list(keys)
    aggs = [F.sqrt(F.avg(c)).alias(f"{c}_root") for c in matching(df, r"_se$")]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in matching(df, r"_ae$")]
    aggs += [F.count_distinct(c).alias(f"{c}_values") for c in matching(df, r"_id$") if c not in keys]
    return df.groupBy(*keys).agg(*aggs)


def mean_of_floats(df: DataFrame, keys: Names) -> DataFrame:
    keys = _list(keys)
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in floats(df) if c not in keys])


def offset_sweep(truth: DataFrame, measured: DataFrame, keys: Names, ts: str, value: str, offsets_ms: Sequence[int]) -> DataFrame:
    """Error of the measured values against the truth shifted by each offset: one pass, the offsets are exploded.

    Times are matched exactly after the shift; result: offset_ms, n, rmse.
    """
    keys = _list(keys)
    t = truth.select(*keys, millis(ts).alias("__t"), F.col(value).alias("__truth")).withColumn("offset_ms", F.explode(F.array(*[F.lit(int(o)) for o in offsets_ms])))
    t = t.withColumn("__t", F.col("__t") + F.col("offset_ms"))
    m = measured.select(*keys, millis(ts).alias("__t"), F.col(value).alias("__value"))
    e = F.col("__value") - F.col("__truth")
    return t.join(m, [*keys, "__t"]).groupBy("offset_ms").agg(F.count("*").alias("n"), F.sqrt(F.sum(e * e) / F.count("*")).alias("rmse"))


def best_offset(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.min_by("offset_ms", F.struct("rmse", "offset_ms")).alias("offset_ms"), F.min("rmse").alias("rmse"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("r"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"))


def element_errors(pairs: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Error, absolute and squared error of each (measured, true) pair of columns."""
    out = pairs
    for name, (a, b) in columns.items():
        e = F.col(a) - F.col(b)
        out = out.withColumn(f"{name}_e", e).withColumn(f"{name}_ae", F.abs(e)).withColumn(f"{name}_se", e * e)
    return out


def paired(truth: DataFrame, measured: DataFrame, keys: Names, suffix: str = "_true") -> DataFrame:
    keys = _list(keys)
    t = truth.select(*[F.col(c).alias(c if c in keys else f"{c}{suffix}") for c in truth.columns])
    return measured.join(t, keys)


def best_match(errors: DataFrame, keys: Names, ident: str, error: str) -> DataFrame:
    """For each key the candidate with the least root mean square error (the smaller id of a tie)."""
    keys = _list(keys)
    per = errors.groupBy(*keys, ident).agg(F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"), F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.min_by(ident, F.struct("rmse", ident)).alias(ident), F.min("rmse").alias("rmse"))


def share_by_window(df: DataFrame, keys: Names, order: Names, column: str) -> DataFrame:
    """Running share of each row in its key's total."""
    w = over(_list(keys), _list(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_share", F.sum(column).over(w) / F.sum(column).over(over(_list(keys))))


def totals(trips: DataFrame) -> DataFrame:
    """Hours and kilometres of all trips."""
    return trips.agg((F.sum("seconds") / 3600).alias("hours"), (F.sum("path") / 1000).alias("km"), F.count("*").alias("n"))


def local_span(df: DataFrame, ts: str, ident: str, zone: str = "US/Central") -> DataFrame:
    """First and last local time and the number of objects."""
    from ..functions.columns import local_time

    return df.agg(F.min(local_time(ts, zone)).alias("first_local"), F.max(local_time(ts, zone)).alias("last_local"), F.count_distinct(ident).alias("objects"))


def sampled(df: DataFrame, keys: Names, fraction: float, seed: int = 0) -> DataFrame:
    """Rows whose keys' hash falls below the fraction: the same rows wherever and however often it is computed.

    The hash is the first 28 bits of an MD5 sum, which other engines compute as well; a null key counts as empty.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in _list(keys)])
    return df.where(F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") < int(fraction * (1 << 28)))


def error_table(methods: Mapping[str, DataFrame], truth: DataFrame, keys: Names, columns: Mapping[str, tuple[str, str]], by: Names = ()) -> DataFrame:
    """Validation of several methods against the truth: error, root mean square and mean absolute errors of each.

    Every method's rows are paired with the truth on the keys; one aggregation serves all of them.
    """
    out = None
    for name, df in methods.items():
        e = element_errors(paired(truth, df, keys), columns).withColumn("method", F.lit(name))
        e = e.select("method", *_list(by), *[f"{c}_{k}" for c in columns for k in ("e", "ae", "se")])
        out = e if out is None else out.unionByName(e)
    if out is None:
        raise ValueError("no methods")
    aggs = [F.avg(f"{c}_e").alias(f"{c}_bias") for c in columns] + [F.avg(f"{c}_ae").alias(f"{c}_mae") for c in columns] + [F.sqrt(F.avg(f"{c}_se")).alias(f"{c}_rmse") for c in columns]
    return out.groupBy("method", *_list(by)).agg(*aggs, F.count("*").alias("n"))
