"""Readers: Parquet, signal logs, lane and detector lines, calibrations.  Configuration files are small and read by the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import to_utm, utm_zone

SIGNAL_SCHEMA = "SignalID int, Timestamp string, EventCode int, EventParam int"
#: Signal event codes that begin a phase colour (fixed values of the log format).
PHASES = {1: "G", 8: "Y", 10: "R"}


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file, folder or glob; filters and columns are pushed into the scan."""
    return spark.read.parquet(path)


def signals(spark: SparkSession, path: str, offset_seconds: float = 0.0, zone: str = "US/Central") -> DataFrame:
    """Signal log (CSV) -> phase intervals in UTC: SignalID, Phase, colour, since, until."""
    from ..operators.timeseries import next_as_end

    raw = spark.read.csv(path, header=True, schema=SIGNAL_SCHEMA)
    local = F.to_timestamp_ntz("Timestamp", F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][.S]"))
    utc = F.timestamp_add("MILLISECOND", F.lit(int(offset_seconds * 1000)), F.convert_timezone(F.lit(zone), F.lit("UTC"), local))
    colour = F.element_at(F.create_map(*[x for k, v in PHASES.items() for x in (F.lit(k), F.lit(v))]), F.col("EventCode"))
    own = raw.where(F.col("EventCode").isin(*PHASES)).select("SignalID", F.col("EventParam").alias("Phase"), colour.alias("colour"), utc.alias("since"))
    return next_as_end(own, ["SignalID", "Phase"], "since", ["since", "colour"], "until")


def _read_text(spark: SparkSession | None, path: str) -> str:
    if spark is None:
        with open(path, encoding="utf-8") as f:
            return f.read()
    return spark.read.text(path, wholetext=True).first()[0]


def lines(path: str, key: str = "name", spark: SparkSession | None = None) -> dict[str, np.ndarray]:
    """Named polylines (lon, lat) of a GeoJSON file; parts of a multi-line are joined end to end."""
    out = {}
    for k, f in enumerate(json.loads(_read_text(spark, path))["features"]):
        g = f["geometry"]
        xy = [p for part in g["coordinates"] for p in part] if g["type"] == "MultiLineString" else g["coordinates"]
        out[str(f.get("properties", {}).get(key, k))] = np.array([p[:2] for p in xy], dtype=float)
    return out


def lanes_utm(path: str, key: str = "name", zone: int | None = None, spark: SparkSession | None = None) -> dict[str, np.ndarray]:
    """The same in UTM metres, in the zone of the first point unless one is given."""
    got = lines(path, key, spark)
    if not got:
        return {}
    zone = zone or utm_zone(next(iter(got.values()))[0, 0])
    return {name: np.stack(to_utm(xy[:, 0], xy[:, 1], zone), axis=1) for name, xy in got.items()}


def line_table(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features as rows (name, coordinates), for many or large files."""
    raw = spark.read.option("multiline", True).json(path).select(F.explode("features").alias("f"))
    return raw.select(F.col("f.properties.name").alias("name"), F.col("f.geometry.coordinates").alias("coordinates"))


def _origin(pair) -> tuple[float, float]:
    """(lat, lon) of a pair in either order: latitudes of the UTM system do not exceed 84 degrees."""
    a, b = float(pair[0]), float(pair[1])
    return (a, b) if abs(a) <= 84 else (b, a)


def _yaml(text: str) -> dict:
    """Nested maps with scalars and lists, as calibration files use them (a subset of YAML)."""
    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    last: tuple[dict, str] | None = None

    def scalar(v: str):
        v = v.strip().strip("'\"")
        if v.startswith("["):
            return [scalar(x) for x in v.strip("[]").split(",")]
        try:
            return float(v) if any(c in v for c in ".eE") and v.count(".") <= 1 else int(v)
        except ValueError:
            return v

    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        depth, body = len(line) - len(line.lstrip()), line.strip()
        if body.startswith("- "):
            if last is None:
                raise ValueError(f"list item without a key: {raw!r}")
            owner, key = last
            if not isinstance(owner[key], list):
                owner[key] = []
            owner[key].append(scalar(body[2:]))
            continue
        while stack[-1][0] >= depth:
            stack.pop()
        key, _, value = body.partition(": ") if ": " in body else (body.rstrip(":"), "", "")
        key = key.strip().strip("'\"")
        parent = stack[-1][1]
        if value.strip():
            parent[key] = scalar(value)
        else:
            parent[key] = {}
            last = (parent, key)
            stack.append((depth, parent[key]))
    return root


def calibration(path: str, spark: SparkSession | None = None) -> dict[str, dict]:
    """Sensor calibrations: ip -> angle in radians, lat, lon, UTM origin x and y."""
    out = {}
    for ip, v in _yaml(_read_text(spark, path)).items():
        if not isinstance(v, Mapping) or "origin" not in v:
            continue
        lat, lon = _origin(v["origin"])
        x, y = to_utm(lon, lat, utm_zone(lon))
        out[str(ip)] = {"angle": float(np.radians(float(v.get("angle", 0.0)))), "lat": lat, "lon": lon, "x": float(x), "y": float(y)}
    return out


def origins(path: str, spark: SparkSession | None = None) -> dict[str, tuple[float, float]]:
    """Sensor origins of a JSON file: ip -> UTM x and y."""
    out = {}
    for ip, v in json.loads(_read_text(spark, path)).items():
        lat, lon = _origin(v["origin"] if isinstance(v, Mapping) else v)
        x, y = to_utm(lon, lat, utm_zone(lon))
        out[str(ip)] = (float(x), float(y))
    return out


def calibration_table(spark: SparkSession, got: Mapping[str, Mapping]) -> DataFrame:
    """A row a sensor, for a broadcast join."""
    return spark.createDataFrame([(ip, float(v["angle"]), float(v["x"]), float(v["y"])) for ip, v in got.items()], "ip string, angle double, origin_x double, origin_y double")
