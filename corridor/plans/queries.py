"""Every operator as a registered query on the driver's tables, with the same query as SQL where SQL can say it.

``events`` plays the tracks: user_id is the object, ts the time, event_id the tie-breaker, value the position,
event_type the lane or class.  Doubles are rounded to six places; times are milliseconds; no hashes are returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import assoc, extents, fusion, joins, pairs, stats, timeseries
from ..schema import narrowed, over
from . import cleaning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ORDER = ["ts", "event_id"]
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


def whole_millis(sql: str) -> str:
    """epoch_ms(x) rounds in DuckDB; times here are cut to milliseconds."""
    while (a := sql.find("epoch_ms(")) >= 0:
        b, depth = a + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[b], 0)
            b += 1
        sql = f"{sql[:a]}(epoch_us({sql[a + 9 : b]} // 1000){sql[b:]}"
    return sql


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = whole_millis(sql)
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def r(c) -> F.Column:
    return F.round(C.col(c).cast("double"), 6)


def placed(df: DataFrame) -> DataFrame:
    """Events with plane coordinates, a speed and a heading that follow from their columns."""
    return df.withColumn("x", F.col("value") * F.cos(F.col("user_id").cast("double"))).withColumn("y", F.col("value") * F.sin(F.col("event_id").cast("double")))


PLACED = "(SELECT *, value * cos(user_id::DOUBLE) AS x, value * sin(event_id::DOUBLE) AS y FROM events)"

# ---------------------------------------------------------------- sessions, resampling, filling

_SESSIONS = f"""a AS (SELECT *, lag(ts) {W}) AS p FROM events),
s AS (SELECT * EXCLUDE (p), CAST(sum(CASE WHEN epoch_ms(ts) - epoch_ms(p) > 43200000 THEN 1 ELSE 0 END) {W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a)"""


@query(f"""WITH {_SESSIONS} SELECT user_id, event_id, session,
CAST(floor((epoch_ms(ts) - epoch_ms(min(ts) OVER (PARTITION BY user_id, session))) / 1000.0 / 36000) AS BIGINT) AS session_part FROM s""")
def sessionize_gap(spark, d):
    return timeseries.sessions(events(spark, d), "user_id", "ts", ORDER, 43200.0, 36000.0).select("user_id", "event_id", "session", "session_part")


@query(f"""WITH {_SESSIONS}, t AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id, session ORDER BY ts, event_id)) AS step FROM s)
SELECT user_id, session, round(coalesce(sum(step), 0), 6) AS path, (epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0 AS seconds,
round(min(value), 6) AS least_speed, round(max(value), 6) AS greatest_speed, round(avg(value), 6) AS mean_speed, count(*) AS n FROM t GROUP BY user_id, session""")
def session_summary(spark, d):
    s = timeseries.sessions(events(spark, d), "user_id", "ts", ORDER, 43200.0)
    t = stats.trip_summary(s, ["user_id", "session"], "ts", ORDER, "value", None, "value")
    return t.select("user_id", "session", r("path").alias("path"), "seconds", *[r(c).alias(c) for c in ("least_speed", "greatest_speed", "mean_speed")], "n")


@query(f"""WITH {_SESSIONS}, t AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id, session ORDER BY ts, event_id)) AS step FROM s),
g AS (SELECT user_id, session, coalesce(sum(step), 0) AS path, (epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0 AS seconds, max(value) AS top FROM t GROUP BY ALL)
SELECT user_id, session, round(path, 6) AS path, seconds FROM g WHERE path > 50 AND seconds > 3600 AND top < 480""")
def sane_trips(spark, d):
    s = timeseries.sessions(events(spark, d), "user_id", "ts", ORDER, 43200.0)
    t = stats.sane_trips(stats.trip_summary(s, ["user_id", "session"], "ts", ORDER, "value", None, "value"), 50, 3600, 480)
    return t.select("user_id", "session", r("path").alias("path"), "seconds")


@query("""SELECT user_id, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS bucket_ms, round(avg(value), 6) AS value, arg_min(event_type, (ts, event_id)) AS event_type, count(*) AS n
FROM events GROUP BY user_id, time_bucket(INTERVAL 1 HOUR, ts)""")
def resample_bucket(spark, d):
    out = timeseries.resample(events(spark, d), "user_id", "ts", "1 hour", ORDER, ["value"], ["event_type"])
    return out.select("user_id", C.millis("bucket").alias("bucket_ms"), r("value").alias("value"), "event_type", "n")


@query(f"""WITH p AS {PLACED}, w AS (SELECT *, first_value(x) OVER o AS x0, last_value(x) OVER o AS x1, first_value(y) OVER o AS y0, last_value(y) OVER o AS y1, first_value(ts) OVER o AS t0, last_value(ts) OVER o AS t1
FROM p WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id FROM w WHERE sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) >= 200 AND floor((epoch_ms(t1) - epoch_ms(t0)) / 1000.0) >= 86400""")
def short_track_filter(spark, d):
    return timeseries.short_tracks_removed(placed(events(spark, d)), "user_id", "ts", ORDER, "x", "y", 200.0, 86400).select("user_id", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, (epoch_ms(max(ts) OVER w) - epoch_ms(min(ts) OVER w)) / 1000.0 AS t, max(value) OVER w - min(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id, event_type)) WHERE t > 1000000 AND s > 200""")
def short_span_filter(spark, d):
    return timeseries.short_spans_removed(events(spark, d), ["user_id", "event_type"], "ts", "value", 200.0, 1000000.0).select("user_id", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN value > 120 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM events) WHERE k = 1""")
def trim_tail(spark, d):
    return timeseries.tail_trimmed(events(spark, d), "user_id", ORDER, F.col("value") > 120).select("user_id", "event_id")


@query(f"""SELECT user_id, event_id, coalesce((epoch_ms(ts) - epoch_ms(lag(ts) {W})) ) / 1000.0, (epoch_ms(lead(ts) {W})) - epoch_ms(ts)) / 1000.0) AS time_diff FROM events""")
def time_delta_backfill(spark, d):
    return timeseries.time_delta(events(spark, d), "user_id", "ts", ORDER).select("user_id", "event_id", "time_diff")


def _gaps(spark, d):
    return events(spark, d).withColumn("v", F.when(F.col("value") < 150, F.col("value")))


@query(f"""SELECT user_id, event_id, round(last_value(CASE WHEN value < 150 THEN value END IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING), 6) AS v FROM events""")
def forward_fill(spark, d):
    return timeseries.forward_filled(_gaps(spark, d), "user_id", ORDER, "v").select("user_id", "event_id", r("v").alias("v"))


@query(f"""SELECT user_id, event_id, round(coalesce(CASE WHEN value < 150 THEN value END, lead(CASE WHEN value < 150 THEN value END) {W})), 6) AS v FROM events""")
def backward_fill_one(spark, d):
    return timeseries.next_filled(_gaps(spark, d), "user_id", ORDER, "v").select("user_id", "event_id", r("v").alias("v"))


@query(f"""WITH a AS (SELECT *, CASE WHEN value < 150 THEN value END AS v, row_number() {W}) AS i FROM events),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER back AS v0, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER back AS i0,
first_value(v IGNORE NULLS) OVER ahead AS v1, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER ahead AS i1 FROM a
WINDOW back AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(coalesce(v, v0 + (v1 - v0) * (i - i0) / (i1 - i0)), 6) AS v FROM b""")
def interpolate_linear(spark, d):
    return timeseries.interpolated(_gaps(spark, d), "user_id", ORDER, "v").select("user_id", "event_id", r("v").alias("v"))


@query(f"SELECT user_id, event_id, round(avg(value) {W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS m FROM events")
def rolling_mean_trailing(spark, d):
    return timeseries.rolling_mean(events(spark, d), "user_id", ORDER, "value", 19, 0, "m").select("user_id", "event_id", r("m").alias("m"))


@query(f"SELECT user_id, event_id, round(avg(value) {W} ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), 6) AS m FROM events")
def rolling_mean_centered(spark, d):
    return timeseries.rolling_mean(events(spark, d), "user_id", ORDER, "value", 15, 14, "m").select("user_id", "event_id", r("m").alias("m"))


@query(f"SELECT user_id, event_id, round(CASE WHEN count(*) {W} ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) = 20 THEN avg(value) {W} ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END, 6) AS m FROM events")
def rolling_mean_reversed(spark, d):
    return timeseries.rolling_mean(events(spark, d), "user_id", ORDER, "value", 0, 19, "m", full=True).select("user_id", "event_id", r("m").alias("m"))


@query("""WITH g AS (SELECT user_id, CAST(floor((epoch_ms(ts) + 43200000) / 86400000) AS BIGINT) AS g, ts, value FROM events),
seen AS (SELECT user_id, g, arg_min(value, ts) AS value FROM g GROUP BY ALL),
span AS (SELECT user_id, min(g) AS a, max(g) AS b FROM g GROUP BY ALL),
slots AS (SELECT user_id, b, unnest(generate_series(a + 1, b + 2)) AS g FROM span),
j AS (SELECT s.user_id, s.g, s.g > b AS predicted, seen.user_id IS NULL AS missing, seen.value AS v FROM slots s LEFT JOIN seen ON seen.user_id = s.user_id AND seen.g = s.g),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS value, bool_or(NOT missing) OVER w AS any_ FROM j WINDOW w AS (PARTITION BY user_id ORDER BY g ROWS UNBOUNDED PRECEDING))
SELECT user_id, g * 86400000 AS ts_ms, round(value, 6) AS value, predicted, missing FROM f WHERE any_""")
def densify_grid(spark, d):
    out = timeseries.densified(events(spark, d), "user_id", "ts", 86_400_000, 2 * 86_400_000, ["value"])
    return out.select("user_id", C.millis("ts").alias("ts_ms"), r("value").alias("value"), "predicted", "missing")


@query(f"""WITH a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) {W}) AND row_number() {W}) > 1 THEN 1 ELSE 0 END AS c FROM events)
SELECT user_id, event_id, CAST(sum(c) {W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM a""")
def state_change_groups(spark, d):
    return timeseries.changes(events(spark, d), "user_id", ORDER, "event_type", "grp").select("user_id", "event_id", F.col("grp").cast("long").alias("grp"))


@query(f"""WITH a AS (SELECT *, CASE WHEN row_number() {W}) > 1 AND (event_type IS DISTINCT FROM lag(event_type) {W}) OR epoch_ms(ts) - epoch_ms(lag(ts) {W})) > 86400000) THEN 1 ELSE 0 END AS c FROM events WHERE event_type IS NOT NULL)
SELECT user_id, event_id, CAST(sum(c) {W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sequence FROM a""")
def continuous_segments(spark, d):
    from ..operators.probe import continuous_segments as op

    e = events(spark, d)
    return op(e, "user_id", "ts", "event_type", 86400.0).select("user_id", "event_id", F.col("sequence").cast("long").alias("sequence"))


@query("SELECT user_id, event_id, epoch_ms(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS until_ms FROM events")
def lead_interval(spark, d):
    return timeseries.next_as_end(events(spark, d), ["user_id", "event_type"], "ts", ORDER, "until").select("user_id", "event_id", C.millis("until").alias("until_ms"))


@query(f"SELECT user_id, event_id, coalesce(value - lag(value) {W}), lead(value) {W}) - value) < 0 AS approaching FROM events")
def approaching_flag(spark, d):
    return timeseries.approaching(events(spark, d), "user_id", ORDER, "value").select("user_id", "event_id", "approaching")


@query(f"""WITH a AS (SELECT *, coalesce(value < 60 AND lag(value) {W}) < 60, false) AS still FROM events)
SELECT user_id, event_id, last_value(CASE WHEN NOT still THEN event_type END IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS event_type FROM a""")
def standing_still(spark, d):
    return timeseries.standing_still(events(spark, d), "user_id", ORDER, "value", "event_type", 60.0).select("user_id", "event_id", "event_type")


@query(f"SELECT user_id, event_id FROM (SELECT *, lag(event_type) {W}) AS p FROM events) WHERE coalesce(event_type <> p, true)")
def repeated_frames(spark, d):
    return timeseries.repeated_frames_removed(events(spark, d), "user_id", ORDER, "event_type").select("user_id", "event_id")


@query("SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) - 1 AS time_index FROM events")
def dense_time_index(spark, d):
    out = timeseries.time_positions(events(spark, d).withColumn("day", F.date_trunc("day", "ts")), "user_id", "day")
    return out.select("user_id", "event_id", F.col("time_index").cast("long").alias("time_index"))


@query(f"SELECT user_id, event_id, row_number() {W}) - 1 AS position, round(sum(value) {W} ROWS UNBOUNDED PRECEDING), 6) AS total FROM events")
def running_sum(spark, d):
    out = timeseries.running_sum(timeseries.positions(events(spark, d), "user_id", ORDER), "user_id", ORDER, "value", "total")
    return out.select("user_id", "event_id", F.col("position").cast("long").alias("position"), r("total").alias("total"))


@query(f"SELECT user_id, event_id, round(lead(value) {W}) - lag(value) {W}), 6) AS diff FROM events")
def centred_difference(spark, d):
    return timeseries.differences(events(spark, d), "user_id", ORDER, "value", "diff", centred=True).select("user_id", "event_id", r("diff").alias("diff"))


@query("""WITH f AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events WHERE event_type = 'click')
SELECT e.user_id, e.event_id, round(coalesce(t, 0), 6) AS path FROM events e LEFT JOIN (SELECT user_id, sum(s) AS t FROM f GROUP BY 1) USING (user_id)""")
def filtered_path(spark, d):
    return timeseries.filtered_path(events(spark, d), "user_id", ORDER, "value", F.col("event_type") == "click", "path").select("user_id", "event_id", r("path").alias("path"))


@query(f"SELECT user_id, event_id FROM (SELECT *, row_number() {W}) AS n FROM events) WHERE (n - 1) % 7 = 0")
def every_nth_row(spark, d):
    return timeseries.every_nth(events(spark, d), "user_id", ORDER, 7).select("user_id", "event_id")


@query(f"""WITH a AS (SELECT *, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) {W})), epoch_ms(lead(ts) {W})) - epoch_ms(ts)) / 1000.0 AS time_diff, row_number() {W}) - 1 AS time_ind, count(*) OVER (PARTITION BY user_id) - 1 AS max_time FROM events)
SELECT user_id, event_id, time_diff, time_ind, max_time, round(value, 6) AS m0, round(value * 2, 6) AS m1 FROM a WHERE max_time > 60""")
def filter_input(spark, d):
    e = events(spark, d).withColumn("v1", F.round("value", 6)).withColumn("v2", F.round(F.col("value") * 2, 6))
    out = timeseries.filter_input(e, "user_id", "ts", ORDER, ["v1", "v2"], 60)
    return out.select("user_id", "event_id", "time_diff", F.col("time_ind").cast("long").alias("time_ind"), F.col("max_time").cast("long").alias("max_time"), F.col("measurement")[0].alias("m0"), F.col("measurement")[1].alias("m1"))


# ---------------------------------------------------------------- row-local operators


@query("""SELECT k, count(*) AS n FROM (SELECT concat_ws('/', user_id, event_type, strftime(ts, '%Y-%m-%d')) AS k FROM events) GROUP BY k""")
def object_key_per_day(spark, d):
    e = events(spark, d).withColumn("id", C.object_key("user_id", "event_type", "ts"))
    return e.groupBy("id").agg(F.min(F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd"))).alias("k"), F.count("*").alias("n")).select("k", "n")


@query(f"SELECT user_id, event_id FROM {PLACED} WHERE x * x + y * y <= 40000 AND abs(x) < y * tan(radians(110.0) / 2)")
def crop_sector(spark, d):
    return placed(events(spark, d)).where(C.in_sector("x", "y", 200.0, 110.0)).select("user_id", "event_id")


@query(f"""SELECT user_id, event_id, round(x * cos(0.3) - y * sin(0.3) + 100, 6) AS ux, round(x * sin(0.3) + y * cos(0.3) - 50, 6) AS uy, round(degrees(atan2(y, x)), 6) AS heading_deg, round(sqrt(x * x + y * y), 6) AS dist FROM {PLACED}""")
def rotate_translate(spark, d):
    p = placed(events(spark, d))
    x, y = C.rotated("x", "y", F.lit(0.3))
    return p.select("user_id", "event_id", r(x + 100).alias("ux"), r(y - 50).alias("uy"), r(F.degrees(C.heading("x", "y"))).alias("heading_deg"), r(C.distance("x", "y")).alias("dist"))


@query(f"""SELECT user_id, event_id, round(atan2(sin(value), cos(value)), 6) AS wrapped,
round(degrees((atan2(x, y) + 0.5 + pi()) - 2 * pi() * floor((atan2(x, y) + 0.5 + pi()) / (2 * pi()))), 6) AS compass FROM {PLACED}""")
def wrap_angle(spark, d):
    return placed(events(spark, d)).select("user_id", "event_id", r(C.wrap(F.col("value"))).alias("wrapped"), r(C.compass("x", "y", 0.5)).alias("compass"))


@query("SELECT user_id, event_id FROM events WHERE CASE WHEN event_type IN ('click', 'view') AND month(ts) = 1 THEN value < 75 ELSE true END")
def conditional_predicate(spark, d):
    e = events(spark, d).withColumnsRenamed({"event_type": "ip", "ts": "epoch_time", "value": "dist"})
    return cleaning.range_limited(e, ["click", "view"], 1, 75.0).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM events WHERE day(ts) = 13 AND hour(ts) = 12")
def small_subset(spark, d):
    return cleaning.small_subset(events(spark, d), "ts").select("user_id", "event_id")


_EXT = "(SELECT *, 2 + value / 100 AS front_off, -1 - value / 150 AS back_off, 3 + value / 60 AS length_s, value AS dist, event_id % 2 = 0 AS approaching, value * 3 AS s FROM events)"


def _ext(spark, d):
    v = F.col("value")
    return events(spark, d).select("*", (2 + v / 100).alias("front_off"), (-1 - v / 150).alias("back_off"), (3 + v / 60).alias("length_s"), v.alias("dist"), (F.col("event_id") % 2 == 0).alias("approaching"), (v * 3).alias("s"))


def _fb(df):
    return df.select("user_id", "event_id", r("front_s").alias("front_s"), r("back_s").alias("back_s"))


@query(f"""WITH e AS {_EXT}, m AS (SELECT avg(length_s) AS m FROM e WHERE dist BETWEEN 10 AND 50), l AS (SELECT e.*, CASE WHEN dist >= 50 AND length_s < m THEN m ELSE length_s END AS own FROM e, m)
SELECT user_id, event_id, round(CASE WHEN approaching THEN s + front_off ELSE s + back_off + own END, 6) AS front_s, round(CASE WHEN approaching THEN s + front_off - own ELSE s + back_off END, 6) AS back_s FROM l""")
def front_back_mean(spark, d):
    return _fb(extents.front_back(_ext(spark, d), "mean"))


@query(f"""WITH l AS (SELECT *, first_value(length_s) OVER (PARTITION BY user_id ORDER BY dist, event_id) AS own FROM {_EXT})
SELECT user_id, event_id, round(CASE WHEN approaching THEN s + front_off ELSE s + back_off + own END, 6) AS front_s, round(CASE WHEN approaching THEN s + front_off - own ELSE s + back_off END, 6) AS back_s FROM l""")
def front_back_nearest(spark, d):
    return _fb(extents.front_back(_ext(spark, d), "nearest", keys="user_id", order=["event_id"]))


@query(f"SELECT user_id, event_id, round(s, 6) AS front_s, round(s - greatest(front_off, front_off - back_off), 6) AS back_s FROM {_EXT}")
def front_back_front(spark, d):
    return _fb(extents.front_back(_ext(spark, d), "front"))


@query(f"SELECT user_id, event_id, round(s + front_off, 6) AS front_s, round(s + back_off, 6) AS back_s FROM {_EXT}")
def front_back_centre(spark, d):
    return _fb(extents.front_back(_ext(spark, d), "centre"))


@query("SELECT user_id, event_id, CASE WHEN value >= 40 AND value <= 80 THEN 0 WHEN value > 80 AND value <= 120 THEN 1 END AS lane_index FROM events")
def lane_band(spark, d):
    return events(spark, d).select("user_id", "event_id", C.lane_band("value", 60.0, 40.0).alias("lane_index"))


@query("SELECT least(l_partkey, l_suppkey) || '-' || greatest(l_partkey, l_suppkey) AS pair, count(*) AS n FROM lineitem GROUP BY 1")
def pair_key(spark, d):
    _, _, name = C.pair("l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(name.alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS value FROM events")
def narrowed_projection(spark, d):
    out = narrowed(events(spark, d).withColumn("f32_raw", F.col("value")), ["f32_", "ts"])
    return out.select("user_id", "event_id", "event_type", F.round(F.col("value").cast("double"), 3).alias("value"))


@query(f"""WITH a AS (SELECT *, atan2(sin(value - 1.0), cos(value - 1.0)) AS g, row_number() {W}) AS i FROM events), k AS (SELECT *, CASE WHEN abs(g) <= radians(30.0) THEN g END AS v FROM a),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER back AS v0, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER back AS i0,
first_value(v IGNORE NULLS) OVER ahead AS v1, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER ahead AS i1 FROM k
WINDOW back AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, coalesce(v, v0 + (v1 - v0) * (i - i0) / (i1 - i0)) AS angle FROM b)
SELECT user_id, event_id, round(angle, 6) AS angle_diff, round(value * cos(angle), 6) AS s_velocity, round(value * sin(angle), 6) AS d_velocity FROM c WHERE angle IS NOT NULL""")
def along_lane(spark, d):
    e = events(spark, d).withColumn("lane_heading", F.lit(1.0))
    out = extents.along_lane(e, "user_id", ORDER, "value", "lane_heading", "value", "value")
    return out.select("user_id", "event_id", r("angle_diff").alias("angle_diff"), r("s_velocity").alias("s_velocity"), r("d_velocity").alias("d_velocity"))


@query("""SELECT user_id, event_id, strftime(timezone('America/Chicago', timezone('UTC', ts)), '%Y-%m-%d %H:%M') AS local, strftime(timezone('America/Chicago', timezone('UTC', ts)) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS standard FROM events""")
def local_time(spark, d):
    """UTC read as local time of US/Central, and an hour less."""
    e = events(spark, d)
    local = C.local_time("ts")
    return e.select("user_id", "event_id", F.date_format(local, "yyyy-MM-dd HH:mm").alias("local"), F.date_format(C.standard_time(local), "yyyy-MM-dd HH:mm").alias("standard"))


# ---------------------------------------------------------------- pairs and joins


def _frames(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("lane"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("s"), F.col("o_custkey").alias("object"))


_FRAMES = "(SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS lane, o_orderkey AS id, o_totalprice AS s, o_custkey AS object FROM orders)"


@query(f"SELECT id, leader, round(s_gap, 6) AS s_gap FROM (SELECT id, lead(id) OVER w AS leader, lead(s) OVER w - s AS s_gap FROM {_FRAMES} WINDOW w AS (PARTITION BY day, lane ORDER BY s, id)) WHERE leader IS NOT NULL")
def leader_follower(spark, d):
    return pairs.leader_follower(_frames(spark, d), ["day", "lane"], "id", "s").select("id", "leader", r("s_gap").alias("s_gap"))


def _user_frames(spark, d):
    e = events(spark, d)
    return e.groupBy(F.date_trunc("day", "ts").alias("t"), F.col("event_type").alias("lane"), F.col("user_id").alias("id")).agg(F.min("value").alias("s"))


_UFRAMES = "(SELECT date_trunc('day', ts) AS t, event_type AS lane, user_id AS id, min(value) AS s FROM events GROUP BY ALL)"


@query(f"""WITH f AS MATERIALIZED {_UFRAMES}, n AS (SELECT id, lead(id) OVER w AS leader, lead(s) OVER w - s AS gap FROM f WINDOW w AS (PARTITION BY t, lane ORDER BY s, id)),
p AS (SELECT DISTINCT id, leader FROM n WHERE gap < 10)
SELECT epoch_ms(a.t) AS t_ms, a.lane, a.id, b.id AS id_leader, round(b.s - a.s, 6) AS s_gap FROM f a JOIN p USING (id) JOIN f b ON b.t = a.t AND b.lane = a.lane AND b.id = p.leader""")
def leader_follower_history(spark, d):
    out = pairs.leader_follower_history(_user_frames(spark, d), ["t", "lane"], "id", "s", 10.0)
    return out.select(C.millis("t").alias("t_ms"), "lane", "id", "id_leader", r("s_gap").alias("s_gap"))


@query(f"""WITH f AS {_FRAMES} SELECT a.id, b.id AS id_other, round(b.s - a.s, 6) AS s_gap FROM f a JOIN f b ON a.day = b.day AND a.lane = b.lane AND (b.s > a.s OR b.s = a.s AND b.id > a.id) AND b.s - a.s < 50000""")
def all_pairs_in_frame(spark, d):
    return pairs.all_pairs_in_frame(_frames(spark, d), ["day", "lane"], "id", "s", 50000.0).select("id", "id_other", r("s_gap").alias("s_gap"))


@query(f"""WITH f AS MATERIALIZED {_UFRAMES}, n AS (SELECT t, lane, id, lead(id) OVER w AS leader, lead(s) OVER w - s AS gap FROM f WINDOW w AS (PARTITION BY t, lane ORDER BY s, id)),
p AS (SELECT *, least(id, leader) || '-' || greatest(id, leader) AS pair FROM n WHERE leader IS NOT NULL),
m AS (SELECT *, avg(gap) OVER (PARTITION BY pair ORDER BY t, lane, id, leader ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS f FROM p)
SELECT pair, round(min(f), 6) AS least, epoch_ms(arg_min(t, (t, lane, id, leader)) FILTER (WHERE f <= 5)) AS join_ms, epoch_ms(min(t)) AS first_ms, epoch_ms(max(t)) AS last_ms, round(avg(f), 6) AS mean_filtered, count(*) AS n FROM m GROUP BY pair""")
def pair_gate(spark, d):
    lf = pairs.leader_follower(_user_frames(spark, d), ["t", "lane"], "id", "s")
    out = pairs.gate(lf, "id", "leader", "t", "s_gap", 5.0, 20, ["lane"])
    return out.select("pair", r("least").alias("least"), C.millis("join_time").alias("join_ms"), C.millis("first_time").alias("first_ms"), C.millis("last_time").alias("last_ms"), r("mean_filtered").alias("mean_filtered"), "n")


@query(f"""WITH f AS MATERIALIZED {_UFRAMES}, n AS (SELECT t, lane, id, lead(id) OVER w AS leader, lead(s) OVER w - s AS gap FROM f WINDOW w AS (PARTITION BY t, lane ORDER BY s, id)),
p AS (SELECT *, least(id, leader) AS lo, greatest(id, leader) AS hi FROM n WHERE leader IS NOT NULL),
m AS (SELECT *, avg(gap) OVER (PARTITION BY lo, hi ORDER BY t, lane, id, leader ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS f FROM p),
g AS (SELECT lo, hi, min(f) AS least FROM m GROUP BY ALL), e AS (SELECT user_id, max(ts) AS z FROM events GROUP BY 1)
SELECT lo, hi, round(least, 6) AS least, epoch_ms(a.z) AS end_lo, epoch_ms(b.z) AS end_hi FROM g JOIN e a ON a.user_id = lo JOIN e b ON b.user_id = hi WHERE least <= CASE WHEN (lo + hi) % 2 = 0 THEN 2 ELSE 4 END""")
def match_gate(spark, d):
    lf = pairs.leader_follower(_user_frames(spark, d), ["t", "lane"], "id", "s")
    g = pairs.gate(lf, "id", "leader", "t", "s_gap", 5.0, 20, ["lane"])
    ends = events(spark, d).groupBy("user_id").agg(F.max("ts").alias("z"))
    out = pairs.matches(g, ends, "user_id", "z", 4.0, 2.0, (F.col("lo") + F.col("hi")) % 2 == 0)
    return out.select("lo", "hi", r("least").alias("least"), C.millis("end_lo").alias("end_lo"), C.millis("end_hi").alias("end_hi"))


@query(f"""WITH {_SESSIONS}, i AS (SELECT user_id, session, date_trunc('day', min(ts)) AS day, min(ts) AS b, max(ts) AS e FROM s GROUP BY user_id, session)
SELECT a.user_id, a.session, c.user_id AS user_id_other, c.session AS session_other, epoch_ms(greatest(a.b, c.b)) AS begin_ms, epoch_ms(least(a.e, c.e)) AS end_ms
FROM i a JOIN i c ON a.day = c.day AND a.user_id < c.user_id AND least(a.e, c.e) > greatest(a.b, c.b)""")
def interval_overlap_pairs(spark, d):
    s = timeseries.sessions(events(spark, d), "user_id", "ts", ORDER, 43200.0)
    i = s.groupBy("user_id", "session").agg(F.date_trunc("day", F.min("ts")).alias("day"), F.min("ts").alias("b"), F.max("ts").alias("e"))
    out = pairs.overlapping(i, ["day"], "user_id", "b", "e")
    return out.select("user_id", "session", "user_id_other", "session_other", C.millis("overlap_begin").alias("begin_ms"), C.millis("overlap_end").alias("end_ms"))


@query("""SELECT a.user_id, a.event_id, round(b.value, 6) AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_backward(spark, d):
    e = events(spark, d)
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    return joins.asof_backward(left, right, ["user_id"], "ts", ["last_view"]).select("user_id", "event_id", r("last_view").alias("last_view"))


@query("""WITH l AS (SELECT user_id, event_id, epoch_ms(ts) / 3600000.0 AS h FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, epoch_ms(ts) / 3600000.0 AS rh, event_id AS other FROM events WHERE event_type = 'view')
SELECT l.user_id, l.event_id, arg_min(other, (abs(h - rh), rh, other)) AS other FROM l LEFT JOIN q ON l.user_id = q.user_id AND abs(h - rh) <= 24 GROUP BY l.user_id, l.event_id""")
def asof_nearest(spark, d):
    e = events(spark, d).withColumn("h", C.millis("ts") / 3600000.0)
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "h")
    right = e.where("event_type = 'view'").select("user_id", F.col("h").alias("rh"), F.col("event_id").alias("other"))
    return joins.asof_nearest(left, right, ["user_id"], "h", "rh", ["other"], 24.0, ["event_id"]).select("user_id", "event_id", "other")


@query("""WITH p AS (SELECT c_custkey, c_acctbal / 100 AS x, c_custkey % 50 AS y FROM customer), t AS (SELECT s_suppkey, s_acctbal / 100 AS tx, s_suppkey % 50 AS ty FROM supplier),
h AS (SELECT c_custkey, s_suppkey, (x - tx) * (x - tx) + (y - ty) * (y - ty) AS d2 FROM p JOIN t ON abs(x - tx) <= 5 AND abs(y - ty) <= 5)
SELECT c_custkey, s_suppkey, round(sqrt(d2), 6) AS distance FROM p LEFT JOIN (SELECT c_custkey, arg_min(s_suppkey, (d2, s_suppkey)) AS s_suppkey, min(d2) AS d2 FROM h WHERE d2 <= 25 GROUP BY 1) USING (c_custkey)""")
def nearest_point(spark, d):
    p = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 50).cast("double").alias("y"))
    t = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("tx"), (F.col("s_suppkey") % 50).cast("double").alias("ty"))
    return joins.nearest_point(p, t, ["c_custkey"], "x", "y", "tx", "ty", 5.0, ["s_suppkey"]).select("c_custkey", "s_suppkey", r("distance").alias("distance"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_in(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def anti_join_not_in(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("""SELECT c_custkey, coalesce(u.bal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, CASE WHEN max(o_totalprice) > 200000 THEN round(max(o_totalprice), 2) END AS bal FROM orders GROUP BY 1) u ON o_custkey = c_custkey""")
def update_join(spark, d):
    top = F.max("o_totalprice")
    u = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(top > 200000, F.round(top, 2)).alias("c_acctbal"))
    return joins.updated(table(spark, d, "customer").select("c_custkey", "c_acctbal"), u, ["c_custkey"], ["c_acctbal"])


@query("""WITH b AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY 1) SELECT event_id, event_type FROM events JOIN b USING (event_type) WHERE value BETWEEN lo AND hi""")
def within_bounds(spark, d):
    e = events(spark, d)
    b = e.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("p")).select("event_type", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    return joins.within_bounds(e, b, ["event_type"], "value", "lo", "hi").select("event_id", "event_type")


@query("""SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_and(o_totalprice > 1500))""")
def bad_pairs_removed(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_totalprice")
    return pairs.bad_pairs_removed(o.select("id").distinct(), o, "id", F.col("o_totalprice") > 1500)


@query("""SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'""")
def edge_difference(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag")
    return e.where("l_returnflag = 'R'").select("a", "b").distinct().exceptAll(e.where("l_returnflag = 'N'").select("a", "b").distinct())


# ---------------------------------------------------------------- aggregation and statistics


@query("""SELECT user_id, array_to_string(list_sort(list(event_id)), ',') AS tracks, count(*) AS n_tracks, bool_and(value > 1) AS prediction, round(coalesce(avg(value) FILTER (WHERE event_type = 'click'), avg(value)), 6) AS front_s,
round(coalesce(avg(value - 3) FILTER (WHERE event_type <> 'click'), avg(value - 3)), 6) AS back_s FROM events GROUP BY user_id""")
def augment_conditional_mean(spark, d):
    e = events(spark, d).select("user_id", "event_id", F.col("value").alias("front"), (F.col("value") - 3).alias("back"), (F.col("event_type") == "click").alias("ap"), (F.col("value") > 1).alias("pr"))
    out = fusion.augmented(e, ["user_id"], "event_id", "front", "back", "ap", "pr")
    return out.select("user_id", F.array_join(F.col("tracks").cast("array<string>"), ",").alias("tracks"), "n_tracks", "prediction", r("front_s").alias("front_s"), r("back_s").alias("back_s"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def cap_per_group(spark, d):
    return timeseries.first_per_key(table(spark, d, "lineitem"), "l_orderkey", ["-l_extendedprice", "l_linenumber"], 3).select("l_orderkey", "l_linenumber")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def dedupe_first(spark, d):
    return timeseries.first_per_key(events(spark, d), ["user_id", "event_type"], ORDER).select("user_id", "event_type", "event_id")


@query("SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS p_partkey, min(p_retailprice) AS least FROM part GROUP BY 1")
def argmin_group(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey"), F.min("p_retailprice").alias("least"))


@query("""SELECT method, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM (SELECT 'line' AS method, l_quantity AS a, l_discount AS b FROM lineitem UNION ALL SELECT 'order', o_totalprice, 0.5 FROM orders UNION ALL SELECT 'event', value, 1.5 FROM events) GROUP BY 1""")
def union_methods_mean(spark, d):
    one = table(spark, d, "lineitem").select(F.lit("line").alias("method"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    two = table(spark, d, "orders").select(F.lit("order").alias("method"), F.col("o_totalprice").alias("a"), F.lit(0.5).alias("b"))
    three = events(spark, d).select(F.lit("event").alias("method"), F.col("value").alias("a"), F.lit(1.5).alias("b"))
    return stats.mean_of_floats(one.unionByName(two).unionByName(three), "method").select("method", r("a").alias("a"), r("b").alias("b"))


_LF = f"f AS MATERIALIZED {_UFRAMES}, lf AS (SELECT *, lead(id) OVER w AS leader, lead(s) OVER w - s AS s_gap FROM f WINDOW w AS (PARTITION BY t, lane ORDER BY s, id)), p AS (SELECT * FROM lf WHERE leader IS NOT NULL)"
_EPISODES = f"""{_LF}, h AS (SELECT *, avg(s) OVER (PARTITION BY id, leader ORDER BY t, lane ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS mean_speed FROM p),
h2 AS (SELECT *, s_gap / nullif(s, 0) AS headway, (mean_speed - lag(mean_speed) OVER w) / nullif((epoch_ms(t) - epoch_ms(lag(t) OVER w)) / 1000.0, 0) AS accel, row_number() OVER (PARTITION BY id ORDER BY t, lane) - 1 AS row_index FROM h WINDOW w AS (PARTITION BY id, leader ORDER BY t, lane)),
c AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND leader IS DISTINCT FROM lag(leader) OVER w THEN 1 ELSE 0 END AS c FROM h2 WINDOW w AS (PARTITION BY lane, id ORDER BY t, leader)),
e AS (SELECT *, CAST(sum(c) OVER (PARTITION BY lane, id ORDER BY t, leader ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM c)"""


def _episodes(spark, d):
    lf = pairs.leader_follower(_user_frames(spark, d), ["t", "lane"], "id", "s")
    return stats.headway_episodes(stats.headways(lf, "id", "leader", "t", ["lane"], "s", "s"), "id", "leader", "t", ["leader"], "s", ["lane"])


@query(f"""WITH {_EPISODES} SELECT lane, id, leader, episode, epoch_ms(min(t)) AS since_ms, epoch_ms(max(t)) AS until_ms, count(*) AS n, round(avg(s_gap), 6) AS mean_gap, round(min(s_gap), 6) AS least_gap, round(max(s_gap), 6) AS greatest_gap,
round(avg(s), 6) AS mean_speed, round(max(s) FILTER (WHERE s_gap < 100), 6) AS greatest_speed_near, round(count(*) FILTER (WHERE s_gap < 100) / 10, 6) AS near_tenths, round(avg(headway), 6) AS mean_headway, round(min(headway), 6) AS least_headway, round(max(headway), 6) AS greatest_headway, round(min(accel), 6) AS least_accel, round(max(accel), 6) AS greatest_accel,
round(max(accel) FILTER (WHERE headway > 5), 6) AS free_accel, round(count(*) FILTER (WHERE headway > 5 AND s > 20) / 10, 6) AS cruising, min(row_index) AS first_index, max(row_index) AS last_index, round(min(s), 6) AS least_speed, round(max(s), 6) AS greatest_speed,
(epoch_ms(max(t)) - epoch_ms(min(t))) / 1000.0::DOUBLE AS seconds FROM e GROUP BY lane, id, leader, episode""")
def headway_episodes(spark, d):
    numbers = ("mean_gap", "least_gap", "greatest_gap", "mean_speed", "greatest_speed_near", "near_tenths", "mean_headway", "least_headway", "greatest_headway", "least_accel", "greatest_accel", "free_accel", "cruising", "least_speed", "greatest_speed", "seconds")
    index = [F.col(c).cast("long").alias(c) for c in ("first_index", "last_index")]
    return _episodes(spark, d).select("lane", "id", "leader", "episode", C.millis("since").alias("since_ms"), C.millis("until").alias("until_ms"), "n", *[r(c).alias(c) for c in numbers], *index)


@query(f"""WITH {_EPISODES}, g AS (SELECT lane, id, leader, episode, min(t) AS a, max(t) AS b, avg(s_gap) AS m, max(s) - min(s) AS sp FROM e GROUP BY lane, id, leader, episode)
SELECT lane, id, leader, episode, round(m, 6) AS mean_gap FROM g WHERE (epoch_ms(b) - epoch_ms(a)) / 1000.0 >= 0 AND sp >= 0 AND m <= 20 AND a >= TIMESTAMP '2024-01-05' AND b <= TIMESTAMP '2024-02-20'""")
def calibrateable_episodes(spark, d):
    e = stats.in_window(stats.calibrateable(_episodes(spark, d), 0.0, 0.0, 20.0), "2024-01-05 00:00:00", "2024-02-20 00:00:00")
    return e.select("lane", "id", "leader", "episode", r("mean_gap").alias("mean_gap"))


@query(f"""WITH {_EPISODES}, g AS (SELECT lane, id, leader, episode, count(*) AS n FROM e GROUP BY lane, id, leader, episode), sc AS (SELECT user_id, avg(value) AS score FROM events GROUP BY 1)
SELECT lane, id, leader, episode, n, round(a.score, 6) AS score_id, round(b.score, 6) AS score_leader FROM g LEFT JOIN sc a ON a.user_id = id LEFT JOIN sc b ON b.user_id = leader""")
def scored_episodes(spark, d):
    s = events(spark, d).groupBy("user_id").agg(F.avg("value").alias("score"))
    out = stats.scored_episodes(_episodes(spark, d), s, "user_id", "score", "id", "leader")
    return out.select("lane", "id", "leader", "episode", "n", r("score_id").alias("score_id"), r("score_leader").alias("score_leader"))


@query(f"""WITH {_LF}, h AS (SELECT *, avg(s) OVER (PARTITION BY id, leader ORDER BY t, lane ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS mean_speed FROM p)
SELECT epoch_ms(t) AS t_ms, lane, id, leader, round(mean_speed, 6) AS mean_speed, round(s_gap / nullif(s, 0), 6) AS headway,
round((mean_speed - lag(mean_speed) OVER w) / nullif((epoch_ms(t) - epoch_ms(lag(t) OVER w)) / 1000.0, 0), 6) AS accel FROM h WINDOW w AS (PARTITION BY id, leader ORDER BY t, lane)""")
def headways(spark, d):
    lf = pairs.leader_follower(_user_frames(spark, d), ["t", "lane"], "id", "s")
    out = stats.headways(lf, "id", "leader", "t", ["lane"], "s", "s")
    return out.select(C.millis("t").alias("t_ms"), "lane", "id", "leader", r("mean_speed").alias("mean_speed"), r("headway").alias("headway"), r("accel").alias("accel"))


@query("SELECT p_size > 25 AS long, count(*) AS n, round(avg(p_size), 6) AS mean_length FROM part GROUP BY 1")
def class_split(spark, d):
    return stats.classes_by_length(table(spark, d, "part"), "p_size", 25).select("long", "n", r("mean_length").alias("mean_length"))


@query("SELECT round(avg(CASE WHEN value < 10 THEN 1.0 ELSE 0.0 END), 6) AS stopping_share, count(*) FILTER (WHERE value < 10) AS stopping_count, round(avg(CASE WHEN value > 400 THEN 1.0 ELSE 0.0 END), 6) AS fast_share, count(*) FILTER (WHERE value > 400) AS fast_count FROM events")
def condition_shares(spark, d):
    out = stats.shares(events(spark, d), {"stopping": F.col("value") < 10, "fast": F.col("value") > 400})
    return out.select(r("stopping_share").alias("stopping_share"), "stopping_count", r("fast_share").alias("fast_share"), "fast_count")


@query(f"""WITH a AS (SELECT *, abs(value - lag(value) {W})) AS step, ts AS t FROM events), t AS (SELECT user_id, coalesce(sum(step), 0) AS path, count(*) AS n FROM a GROUP BY 1)
SELECT n > 65 AS busy, round(avg(path), 6) AS mean_path, count(*) AS n FROM t GROUP BY 1""")
def mean_path_by_flag(spark, d):
    t = stats.trip_summary(events(spark, d), "user_id", "ts", ORDER, "value", None, "value")
    return stats.mean_path_by(t, F.col("n") > 65, "busy").select("busy", r("mean_path").alias("mean_path"), "n")


@query("SELECT round((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0 / 3600, 6) AS hours FROM events")
def duration_hours(spark, d):
    return stats.duration_hours(events(spark, d), "ts").select(r("hours").alias("hours"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def exact_distinct(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT count(DISTINCT event_id) AS tracklets, true AS close FROM events")
def approx_distinct(spark, d):
    """Different tracklets in exploded lists: the exact number, and whether the approximate one is within three deviations."""
    lists = events(spark, d).groupBy("user_id").agg(F.collect_set("event_id").alias("tracks"))
    out = lists.select(F.explode("tracks").alias("t")).agg(F.approx_count_distinct("t", 0.05).alias("about"), F.count_distinct("t").alias("tracklets"))
    return out.select("tracklets", (F.abs(F.col("about") - F.col("tracklets")) <= 0.15 * F.col("tracklets")).alias("close"))


@query("""WITH v AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
SELECT "column", count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 4) AS deviation, round(min(v), 6) AS least, round(max(v), 6) AS greatest, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.25), 6) AS p25,
round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95 FROM v GROUP BY 1""")
def percentile_profile(spark, d):
    out = stats.percentile_profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select("column", "n", r("mean").alias("mean"), F.round("deviation", 4).alias("deviation"), *[r(c).alias(c) for c in ("least", "greatest", "p5", "p25", "p50", "p75", "p95")])


@query("SELECT l_returnflag, round(sqrt(sum((l_quantity - 25) * (l_quantity - 25)) / count(*)), 6) AS e_rmse, count(*) AS n FROM lineitem GROUP BY 1")
def rmse_by_group(spark, d):
    e = table(spark, d, "lineitem").withColumn("e", F.col("l_quantity") - 25)
    return stats.rmse(e, "l_returnflag", ["e"]).select("l_returnflag", r("e_rmse").alias("e_rmse"), "n")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem")
def pearson(spark, d):
    return stats.correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(r("r").alias("r"), "n")


@query("""WITH e AS (SELECT event_type, user_id AS obj_id, (value - 50) AS e FROM events) SELECT event_type, round(sqrt(avg(e * e)), 6) AS v_se_root, round(avg(abs(e)), 6) AS v_ae_mean, count(DISTINCT obj_id) AS obj_id_values FROM e GROUP BY 1""")
def aggregates_by_pattern(spark, d):
    e = events(spark, d).withColumn("ref", F.lit(50.0)).withColumnRenamed("user_id", "obj_id")
    e = stats.element_errors(e, {"v": ("value", "ref")}).select("event_type", "obj_id", "v_se", "v_ae")
    return stats.by_pattern(e, "event_type").select("event_type", r("v_se_root").alias("v_se_root"), r("v_ae_mean").alias("v_ae_mean"), "obj_id_values")


@query("""WITH m AS (SELECT user_id, CAST(floor(epoch_ms(ts) / 86400000) AS BIGINT) AS g, avg(value) AS v FROM events GROUP BY ALL),
o AS (SELECT unnest(range(-3, 4)) AS o), j AS (SELECT o.o * 86400000 AS offset_ms, b.v - a.v AS e FROM m a CROSS JOIN o JOIN m b ON b.user_id = a.user_id AND b.g = a.g + o.o)
SELECT offset_ms, count(*) AS n, round(sqrt(sum(e * e) / count(*)), 6) AS rmse FROM j GROUP BY 1""")
def offset_sweep(spark, d):
    m = events(spark, d).groupBy("user_id", F.date_trunc("day", "ts").alias("g")).agg(F.avg("value").alias("v"))
    return stats.offset_sweep(m, m, "user_id", "g", "v", [k * 86_400_000 for k in range(-3, 4)]).select(F.col("offset_ms").cast("long").alias("offset_ms"), "n", r("rmse").alias("rmse"))


@query("""WITH m AS (SELECT user_id, event_type, date_trunc('day', ts) AS g, avg(value) AS v FROM events GROUP BY ALL), t AS (SELECT event_type, g, avg(value) AS tv FROM (SELECT *, date_trunc('day', ts) AS g FROM events) GROUP BY ALL),
p AS (SELECT event_type, user_id, sqrt(avg((v - tv) * (v - tv))) AS rmse FROM m JOIN t USING (event_type, g) GROUP BY ALL) SELECT event_type, arg_min(user_id, (rmse, user_id)) AS user_id, round(min(rmse), 6) AS rmse FROM p GROUP BY 1""")
def best_match(spark, d):
    e = events(spark, d).withColumn("g", F.date_trunc("day", "ts"))
    m = e.groupBy("user_id", "event_type", "g").agg(F.avg("value").alias("v"))
    t = e.groupBy("event_type", "g").agg(F.avg("value").alias("v"))
    p = stats.element_errors(stats.paired(t, m, ["event_type", "g"]), {"v": ("v", "v_true")})
    return stats.best_match(p, "event_type", "user_id", "v_e").select("event_type", "user_id", r("rmse").alias("rmse"))


# ---------------------------------------------------------------- association and fusion


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT user_id AS a, 1000000 + event_id % 400 AS b FROM events WHERE value > 200),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, c) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON r.id = u.a)
SELECT id, min(c) AS component FROM r GROUP BY id""")
def connected_components(spark, d):
    e = events(spark, d).where("value > 200").select(F.col("user_id").alias("a"), (1000000 + F.col("event_id") % 400).alias("b"))
    return assoc.connected_components(e, "a", "b")


@query(f"""WITH {_LF}, z AS (SELECT id, leader, lane, epoch_ms(t) AS t_ms, s_gap AS es, s / 100 AS ed FROM p)
SELECT id, leader, lane, t_ms, round((2.5 * es * es - 2 * 0.2 * es * ed + (1 + 5.0 / 3) * ed * ed) / ((1 + 5.0 / 3) * 2.5 - 0.04) + ln((1 + 5.0 / 3) * 2.5 - 0.04), 6) AS distance FROM z""")
def association_distance_2d(spark, d):
    lf = pairs.leader_follower(_user_frames(spark, d), ["t", "lane"], "id", "s")
    dist = assoc.distance_2d(F.col("s_gap"), F.col("s") / 100, F.lit(1.0), F.lit(1.0), F.lit(0.2))
    return lf.select("id", "leader", "lane", C.millis("t").alias("t_ms"), r(dist).alias("distance"))


@query("""WITH g AS (SELECT user_id % 20 AS v, user_id AS t, date_trunc('day', ts) AS d, min(value) AS s, bool_and(value > 30) AS pred FROM events GROUP BY ALL),
a AS (SELECT *, min(d) OVER (PARTITION BY t) AS st, row_number() OVER (PARTITION BY t ORDER BY d) - 1 AS cum FROM g),
b AS (SELECT *, row_number() OVER (PARTITION BY v, d ORDER BY st, t) - 1 AS nth, (epoch_ms(max(d) OVER (PARTITION BY v)) - epoch_ms(d)) / 1000.0 AS td FROM a),
c AS (SELECT *, count(*) OVER (PARTITION BY v, d) AS n, bool_and(pred) OVER (PARTITION BY v, d) AS ap, row_number() OVER (PARTITION BY v, d ORDER BY st, t) - 1 AS k FROM b WHERE nth < 1 OR cum > 5),
e AS (SELECT * FROM c WHERE (NOT pred OR n = 1 OR (ap AND k = 1)) AND NOT (ap AND td < 200000)),
f AS (SELECT *, dense_rank() OVER (PARTITION BY v ORDER BY d) - 1 AS time_index, row_number() OVER (PARTITION BY v, d ORDER BY pred, st, t) - 1 AS contributor FROM e)
SELECT v, t, epoch_ms(d) AS d_ms, time_index, contributor FROM f WHERE contributor < 3""")
def contributors(spark, d):
    g = events(spark, d).groupBy((F.col("user_id") % 20).alias("v"), F.col("user_id").alias("t"), F.date_trunc("day", "ts").alias("d")).agg(F.min("value").alias("s"), F.every(F.col("value") > 30).alias("pred"))
    out = fusion.contributors(g, "v", "t", "d", "pred", 3, 200000.0, 5)
    return out.select("v", "t", C.millis("d").alias("d_ms"), F.col("time_index").cast("long").alias("time_index"), F.col("contributor").cast("long").alias("contributor"))


@query("""WITH g AS (SELECT user_id % 20 AS v, user_id AS t, date_trunc('day', ts) AS d, min(value) AS s FROM events GROUP BY ALL)
SELECT a.v, epoch_ms(a.d) AS d_ms, round(max(abs(a.s - b.s)), 6) AS association_distance FROM g a JOIN g b ON a.v = b.v AND a.d = b.d AND a.t < b.t GROUP BY a.v, a.d""")
def greatest_pair_distance(spark, d):
    g = events(spark, d).groupBy((F.col("user_id") % 20).alias("v"), F.col("user_id").alias("t"), F.date_trunc("day", "ts").alias("d")).agg(F.min("value").alias("s"))
    out = fusion.greatest_pair_distance(g, ["v", "d"], "t", lambda p: p.withColumn("association_distance", F.abs(F.col("s") - F.col("s_leader"))))
    return out.select("v", C.millis("d").alias("d_ms"), r("association_distance").alias("association_distance"))


@query("""WITH a AS (SELECT *, event_type AS lane, value AS s_velocity, (epoch_ms(ts) - epoch_ms(min(ts) OVER (PARTITION BY user_id, event_type))) / 1000.0 AS elapsed FROM events),
b AS (SELECT *, max(elapsed) OVER (PARTITION BY user_id, event_type) AS m, avg(value) OVER (PARTITION BY user_id, event_type) AS g FROM a) SELECT user_id, event_id, elapsed, round(g, 6) AS mean_distance FROM b WHERE m > 2250000""")
def final_trim(spark, d):
    e = events(spark, d).withColumn("vehicle", F.struct("user_id", "event_type")).withColumn("lane", F.col("event_type")).withColumn("s_velocity", F.col("value")).withColumn("association_distance", F.col("value")).withColumn("tracks", F.array("event_id"))
    out = fusion.trimmed(e, "vehicle", "ts", 2250000.0)
    return out.select("user_id", "event_id", "elapsed", r("mean_association_distance").alias("mean_distance"))


@query("""WITH x AS (SELECT user_id, unnest(tracks) AS event_id FROM (SELECT user_id, list(event_id) AS tracks FROM events GROUP BY 1 HAVING avg(value) > 50)) SELECT event_id, event_type FROM events WHERE event_id IN (SELECT event_id FROM x)""")
def raw_rows_of_vehicle(spark, d):
    """Lists of tracks of the vehicles asked for (those with a high mean), back to their raw rows."""
    e = events(spark, d)
    lists = e.groupBy("user_id").agg(F.collect_list("event_id").alias("tracks"), F.avg("value").alias("mean")).where("mean > 50")
    return e.join(lists.select(F.explode("tracks").alias("event_id")), "event_id", "left_semi").select("event_id", "event_type")


@query("""WITH i AS (SELECT event_type, ts AS since, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS until, user_id, event_id AS phase FROM events WHERE event_type = 'view')
SELECT e.event_id, i.phase FROM events e JOIN i ON i.user_id = e.user_id AND e.ts >= i.since AND e.ts < i.until WHERE e.event_type = 'click'""")
def signal_overlay(spark, d):
    e = events(spark, d)
    i = timeseries.next_as_end(e.where("event_type = 'view'"), ["user_id", "event_type"], "ts", ORDER, "until").select("user_id", "ts", "event_id", "until", F.col("event_id").alias("phase"))
    clicks = e.where("event_type = 'click'").select("user_id", "event_id", "ts")
    # Phases of a signal do not overlap: the last one that has begun is the only one that can hold.
    return joins.asof_backward(clicks, i, ["user_id"], "ts", ["until", "phase"], ["event_id"]).where("ts < until").select("event_id", "phase")


@query(f"SELECT user_id, event_id, round(sum(value) {W} ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY user_id), 6) AS running_share FROM events")
def running_share(spark, d):
    return stats.share_by_window(events(spark, d), "user_id", ORDER, "value").select("user_id", "event_id", r("running_share").alias("running_share"))


@query(f"""WITH a AS (SELECT *, abs(value - lag(value) {W})) AS step FROM events), t AS (SELECT user_id, coalesce(sum(step), 0) AS path, (epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0 AS seconds FROM a GROUP BY 1)
SELECT round(sum(seconds) / 3600, 4) AS hours, round(sum(path) / 1000, 6) AS km, count(*) AS n FROM t""")
def total_hours_km(spark, d):
    t = stats.totals(stats.trip_summary(events(spark, d), "user_id", "ts", ORDER, "value", None, "value"))
    return t.select(F.round("hours", 4).alias("hours"), r("km").alias("km"), "n")


@query("SELECT strftime(min(l), '%Y-%m-%d %H:%M') AS first_local, strftime(max(l), '%Y-%m-%d %H:%M') AS last_local, count(DISTINCT user_id) AS objects FROM (SELECT user_id, timezone('America/Chicago', timezone('UTC', ts)) AS l FROM events)")
def local_span(spark, d):
    s = stats.local_span(events(spark, d), "ts", "user_id")
    return s.select(F.date_format("first_local", "yyyy-MM-dd HH:mm").alias("first_local"), F.date_format("last_local", "yyyy-MM-dd HH:mm").alias("last_local"), "objects")


@query("SELECT event_id, user_id FROM events WHERE CAST('0x' || substr(md5('7|' || event_id), 1, 7) AS BIGINT) < CAST(floor(0.1 * 268435456) AS BIGINT)")
def sampled_rows(spark, d):
    """A tenth of the rows by a hash of their key (sampling is the feature)."""
    return stats.sampled(events(spark, d), "event_id", 0.1, 7).select("event_id", "user_id")


@query("SELECT o_orderkey, abs(o_totalprice - 150000) AS off FROM orders ORDER BY abs(o_totalprice - 150000), o_orderkey LIMIT 10")
def nearest_rows(spark, d):
    """The ten rows nearest to a value (a top-k report)."""
    return table(spark, d, "orders").select("o_orderkey", F.abs(F.col("o_totalprice") - 150000).alias("off")).orderBy("off", "o_orderkey").limit(10)


@query("SELECT DISTINCT event_type, user_id % 7 AS k FROM events")
def distinct_rows(spark, d):
    return events(spark, d).select("event_type", (F.col("user_id") % 7).alias("k")).distinct()


@query("""WITH t AS (SELECT user_id, date_trunc('day', ts) AS g, avg(value) AS v FROM events GROUP BY ALL),
m AS (SELECT 'first' AS method, user_id, date_trunc('day', ts) AS g, arg_min(value, (ts, event_id)) AS v FROM events GROUP BY ALL UNION ALL SELECT 'top', user_id, date_trunc('day', ts), max(value) FROM events GROUP BY ALL)
SELECT method, round(avg(m.v - t.v), 6) AS v_bias, round(avg(abs(m.v - t.v)), 6) AS v_mae, round(sqrt(avg((m.v - t.v) * (m.v - t.v))), 6) AS v_rmse, count(*) AS n FROM m JOIN t USING (user_id, g) GROUP BY method""")
def validation_errors(spark, d):
    e = events(spark, d).withColumn("g", F.date_trunc("day", "ts"))
    truth = e.groupBy("user_id", "g").agg(F.avg("value").alias("v"))
    methods = {"first": e.groupBy("user_id", "g").agg(F.min_by("value", F.struct(*ORDER)).alias("v")), "top": e.groupBy("user_id", "g").agg(F.max("value").alias("v"))}
    out = stats.error_table(methods, truth, ["user_id", "g"], {"v": ("v", "v_true")})
    return out.select("method", *[r(c).alias(c) for c in ("v_bias", "v_mae", "v_rmse")], "n")


@query("SELECT c_custkey, i - 1 AS vertex, x[i][1] AS x, x[i][2] AS y FROM (SELECT c_custkey, [[c_acctbal, 0.0], [c_acctbal + 1, 1.0], [c_acctbal + 2, 4.0]] AS x FROM customer), (SELECT unnest([1, 2, 3]) AS i)")
def exploded_lines(spark, d):
    from ..operators.geo import exploded_lines as op

    b = F.col("c_acctbal")
    line = F.array(F.array(b, F.lit(0.0)), F.array(b + 1, F.lit(1.0)), F.array(b + 2, F.lit(4.0)))
    return op(table(spark, d, "customer").select("c_custkey", line.alias("line")), "line", ["c_custkey"])
