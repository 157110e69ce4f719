"""Expressions of columns: angles, planar geometry, time, and the like.  All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def millis(ts: str | Column) -> Column:
    """Milliseconds since 1970 of a timestamp with or without time zone (session zone UTC)."""
    return F.timestamp_diff("MILLISECOND", F.expr(EPOCH), col(ts).cast("timestamp_ntz"))


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    """Seconds on the grid of milliseconds."""
    return (millis(later) - millis(earlier)) / F.lit(1000.0)


def plus_millis(ts: str | Column, ms: int | Column) -> Column:
    return F.timestamp_add("MILLISECOND", F.lit(ms) if isinstance(ms, int) else ms, col(ts))


def wrap(angle: Column) -> Column:
    """An angle in radians brought to (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def direction(y: str | Column, x: str | Column) -> Column:
    """atan2 as IEEE 754 has it.  Spark's own takes -0.0 for 0.0, which turns a direction by half a circle."""
    y, x = col(y).cast("double"), col(x).cast("double")
    below = lambda c: (c < 0) | ((c == 0) & (c.cast("string") == "-0.0"))
    flat = F.when(below(x), F.pi()).otherwise(F.lit(0.0))
    return F.when((y == 0) & x.isNotNull() & ~F.isnan(x), F.when(below(y), -flat).otherwise(flat)).otherwise(F.atan2(y, x))


def heading(dx: str | Column, dy: str | Column) -> Column:
    return direction(dy, dx)


def compass(dx: str | Column, dy: str | Column, turn: Column | float = 0.0) -> Column:
    """Heading from the y axis, turned and brought to [0, 360) degrees."""
    turn = turn if isinstance(turn, Column) else F.lit(float(turn))
    return F.degrees(F.pmod(direction(dx, dy) + turn + F.pi(), 2 * F.pi()))


def rotated(x: str | Column, y: str | Column, angle: Column) -> tuple[Column, Column]:
    x, y = col(x), col(y)
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def distance(x: str | Column, y: str | Column) -> Column:
    x, y = col(x), col(y)
    return F.sqrt(x * x + y * y)


def within_radius(x: str | Column, y: str | Column, radius: float) -> Column:
    """At most ``radius`` from the origin, the rim included."""
    x, y = col(x), col(y)
    return x * x + y * y <= F.lit(radius * radius)


def within_view(x: str | Column, y: str | Column, degrees: float) -> Column:
    """Inside a field of view of ``degrees`` around the y axis, the edge excluded."""
    import math

    return F.abs(col(x)) < col(y) * F.lit(math.tan(math.radians(degrees) / 2))


def in_sector(x: str | Column, y: str | Column, radius: float, degrees: float) -> Column:
    """Point in the sector that a sensor sees."""
    return within_radius(x, y, radius) & within_view(x, y, degrees)


def only_if(condition: Column, predicate: Column) -> Column:
    """A predicate that applies where the condition holds; elsewhere rows are kept."""
    return F.when(condition, predicate).otherwise(F.lit(True))


def lane_band(offset: str | Column, centre: float, width: float) -> Column:
    """0 within the band around ``centre`` (both edges), 1 within the next band (upper edge only), else null."""
    d, half = col(offset), width / 2
    return F.when((d >= centre - half) & (d <= centre + half), 0).when((d > centre + half) & (d <= centre + width + half), 1)


def pair(a: str | Column, b: str | Column) -> tuple[Column, Column, Column]:
    """Smaller, larger and joined name of an unordered pair."""
    lo, hi = F.least(col(a), col(b)), F.greatest(col(a), col(b))
    return lo, hi, F.concat_ws("-", lo.cast("string"), hi.cast("string"))


def object_key(number: str | Column, sensor: str | Column, ts: str | Column) -> Column:
    """Key of a sensor's object number, which is used again on other days."""
    return F.xxhash64(col(number).cast("string"), col(sensor).cast("string"), F.date_format(col(ts), "yyyy-MM-dd"))


def as_utc(ts: str | Column) -> Column:
    """Naive time read as UTC (the session's zone), without a shift."""
    return col(ts).cast("timestamp")


def local_time(ts: str | Column, zone: str = "US/Central") -> Column:
    """UTC time as naive local time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(ts).cast("timestamp_ntz"))


def standard_time(local: str | Column) -> Column:
    """Local summer time as standard time: an hour less."""
    return col(local) - F.expr("INTERVAL 1 HOUR")


def finite(x: str | Column) -> Column:
    return ~F.isnan(col(x)) & (F.abs(col(x)) < F.lit(float("inf")))
