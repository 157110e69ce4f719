"""Registered queries of sources and sinks: the driver's tables are written in each format below the shared folder and read back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import millis
from ..operators import geo
from ..sources import readers
from ..sources.writers import shared_dir, write_parquet
from .queries import events, r, table, whole_millis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(spark: SparkSession, name: str, content: str) -> str:
    """A small configuration file."""
    path = _place(spark, name)
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return path


@query
def source_signals(spark, d):
    """Events as a signal log (CSV), read as phase intervals."""
    code = F.element_at(F.create_map(*[F.lit(x) for kv in (("click", 1), ("view", 8), ("purchase", 10), ("error", 3), ("signup", 7)) for x in kv]), F.col("event_type"))
    log = events(spark, d).select(F.col("user_id").cast("int").alias("SignalID"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"), code.alias("EventCode"), (F.col("event_id") % 4).cast("int").alias("EventParam"))
    path = _place(spark, "signals")
    log.write.option("header", True).csv(path)
    out = readers.signals(spark, path, offset_seconds=2.5, zone="UTC")
    return out.select("SignalID", "Phase", "colour", millis("since").alias("since_ms"), millis("until").alias("until_ms"))


@query
def source_lines(spark, d):
    """Nations as lines of a GeoJSON file, exploded to one row a vertex."""
    rows = sorted((x.n_nationkey, x.n_name, x.n_regionkey) for x in table(spark, d, "nation").collect())  # 25 rows
    features = [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": "LineString", "coordinates": [[k + 0.5 * i, g - 0.25 * i] for i in range(g + 2)]}} for k, n, g in rows]
    lines = readers.line_table(spark, _text(spark, "lines", json.dumps({"type": "FeatureCollection", "features": features})))
    return geo.exploded_lines(lines, "coordinates", ["name"]).select("name", F.col("vertex").cast("long").alias("vertex"), "x", "y")


@query
def source_calibration(spark, d):
    """Nations as sensors of a YAML file, origins as (lat, lon) or (lon, lat), and the same as JSON."""
    rows = sorted((x.n_nationkey, x.n_name) for x in table(spark, d, "nation").collect())  # 25 rows
    origin = {n: [36.0 + k / 100, -87.0 + k / 50] if k % 2 else [-87.0 + k / 50, 36.0 + k / 100] for k, n in rows}
    yaml = "".join(f"{json.dumps(n)}:\n  angle: {k * 7.5}\n  origin: [{origin[n][0]!r}, {origin[n][1]!r}]\n  channel: {k}\n" for k, n in rows)
    got = readers.calibration(_text(spark, "calibration", yaml), spark)
    same = readers.origins(_text(spark, "origins", json.dumps(origin)), spark)
    out = [(ip, v["lat"], v["lon"], v["angle"], abs(same[ip][0] - v["x"]) + abs(same[ip][1] - v["y"])) for ip, v in got.items()]
    return spark.createDataFrame(out, "ip string, lat double, lon double, angle double, off double").select("ip", *[r(c).alias(c) for c in ("lat", "lon", "angle", "off")])


@query
def parquet_sink(spark, d):
    """Lines of orders written as floats, in folders by flag and without some columns, and read back through a glob."""
    path = _place(spark, "sink")
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.col("l_tax").alias("tax_extra"))
    write_parquet(own, path, partition_by=["l_returnflag"], as_floats=True, drop=["extra"])
    back = spark.read.option("basePath", path).parquet(f"{path}/l_returnflag=[AR]")
    return back.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.max(F.typeof("l_quantity")).alias("kind"), F.lit(len(back.columns)).cast("long").alias("width"))


ORACLE_SQL = {
    "source_signals": """WITH c AS (SELECT CAST(user_id AS INTEGER) AS SignalID, CAST(event_id % 4 AS INTEGER) AS Phase,
CASE event_type WHEN 'click' THEN 'G' WHEN 'view' THEN 'Y' ELSE 'R' END AS colour, ts + INTERVAL 2500 MILLISECOND AS since FROM events WHERE event_type IN ('click', 'view', 'purchase'))
SELECT SignalID, Phase, colour, epoch_ms(since) AS since_ms, epoch_ms(lead(since) OVER (PARTITION BY SignalID, Phase ORDER BY since, colour)) AS until_ms FROM c""",
    "source_lines": "SELECT n_name AS name, i AS vertex, n_nationkey + 0.5::DOUBLE * i AS x, n_regionkey - 0.25::DOUBLE * i AS y FROM (SELECT *, unnest(range(0, n_regionkey + 2)) AS i FROM nation)",
    "source_calibration": "SELECT n_name AS ip, round(36.0::DOUBLE + n_nationkey / 100.0::DOUBLE, 6) AS lat, round(-87.0::DOUBLE + n_nationkey / 50.0::DOUBLE, 6) AS lon, round(radians(n_nationkey * 7.5::DOUBLE), 6) AS angle, 0.0::DOUBLE AS off FROM nation",
    "parquet_sink": "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, 'float' AS kind, CAST(4 AS BIGINT) AS width FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1",
}
ORACLE_SQL = {k: whole_millis(v) for k, v in ORACLE_SQL.items()}
