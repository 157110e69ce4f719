"""Joins that Spark has no operator for, as plans without nested loops."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import over
from ..sources.writers import saved


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Each left row with the last right row at or before it: one union, one shuffle, one window."""
    cols = left.columns
    a = left.select(*[F.col(c) for c in cols], *[F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values], F.lit(1).alias("__side"))
    b = right.select(*[F.col(c) if c in (*keys, at, *tie) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], *[F.col(v).alias(f"__{v}") for v in values], F.lit(0).alias("__side"))
    b = b.withColumn("__row", F.struct(*[F.col(f"__{v}") for v in values]))
    a = a.withColumn("__row", F.lit(None).cast(b.schema["__row"].dataType))
    w = over(keys, [at, "__side", *tie]).rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__got", F.last("__row", ignorenulls=True).over(w)).where("__side = 1")
    return out.select(*cols, *[F.col(f"__got.__{v}").alias(v) for v in values])


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, values: Sequence[str], tolerance: float, ident: Sequence[str]) -> DataFrame:
    """Each left row with the nearest right row within the tolerance (the lower one of a tie), else nulls.

    Both sides get cells as wide as the tolerance, so a left row meets three cells: an equality join, then a minimum
    per left row.  ``ident`` names a left row.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(tolerance))).cast("long")
    slim = left.select(*ident, *keys, at).withColumn("__c", F.explode(F.array(*[cell(at) + k for k in (-1, 0, 1)])))
    r = right.select(*keys, right_at, *values).withColumn("__c", cell(right_at))
    hit = slim.join(r, [*keys, "__c"]).withColumn("__d", F.abs(F.col(at) - F.col(right_at))).where(F.col("__d") <= tolerance)
    best = hit.groupBy(*ident).agg(F.min(F.struct("__d", right_at, *values)).alias("__b"))
    out = left.join(best, list(ident), "left")
    return out.select(*left.columns, F.col(f"__b.{right_at}").alias(f"nearest_{right_at}"), *[F.col(f"__b.{v}").alias(v) for v in values])


#: Targets that a point should meet at most, about, and how often the cells may be halved for that.
MET, HALVINGS = 24, 8


def nearest_point(points: DataFrame, targets: DataFrame, ident: Sequence[str], x: str, y: str, tx: str, ty: str, bound: float, values: Sequence[str], gate: Column | None = None) -> DataFrame:
    """Each point with the nearest target within ``bound``, else nulls.

    Where targets lie densely, points look into small cells first.  A target found there within a cell's width is the
    nearest one, so only points without one look into cells four times as wide, up to the bound.  Targets at one place
    collapse first, unless a gate tells them apart.
    """
    if gate is None:
        targets = targets.groupBy(tx, ty).agg(F.min(F.struct(*values)).alias("__v")).select(tx, ty, *[F.col(f"__v.{v}").alias(v) for v in values])
    targets = saved(targets.select(tx, ty, *values))
    width, rest, own = bound, points, [c for c in points.columns if c not in values]
    met = lambda w: targets.groupBy(F.floor(F.col(tx) / w), F.floor(F.col(ty) / w)).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n") * 9).first()[0]
    for _ in range(HALVINGS):
        if (met(width) or 0) <= MET:
            break
        width /= 2
    if width == bound:
        return nearest_on_grid(points, targets, ident, x, y, tx, ty, bound, values, gate)
    done = []
    while True:
        out = saved(nearest_on_grid(rest, targets, ident, x, y, tx, ty, min(width, bound), values, gate))
        if width >= bound:
            return reduce(DataFrame.unionByName, [*done, out])
        done.append(out.where("distance is not null"))
        rest, width = out.where("distance is null").select(*own), width * 4


def nearest_on_grid(points: DataFrame, targets: DataFrame, ident: Sequence[str], x: str, y: str, tx: str, ty: str, bound: float, values: Sequence[str], gate: Column | None = None) -> DataFrame:
    """The same with cells as wide as the bound.

    Targets are put in every cell of a square grid that lies within the bound of their own, so each point looks
    into one cell; the minimum per point is pre-aggregated before its shuffle.
    """
    cx, cy = (lambda c: F.floor(F.col(c) / F.lit(float(bound))).cast("long")), (lambda c: F.floor(F.col(c) / F.lit(float(bound))).cast("long"))
    around = F.explode(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]))
    t = targets.select(tx, ty, *values).withColumn("__i", around).withColumn("__j", around)
    t = t.withColumn("__gx", cx(tx) + F.col("__i")).withColumn("__gy", cy(ty) + F.col("__j")).drop("__i", "__j")
    own = [c for c in points.columns if c not in values]
    p = points.select(*own).withColumn("__gx", cx(x)).withColumn("__gy", cy(y))
    d2 = (F.col(x) - F.col(tx)) * (F.col(x) - F.col(tx)) + (F.col(y) - F.col(ty)) * (F.col(y) - F.col(ty))
    hit = p.join(t, ["__gx", "__gy"]).withColumn("__d2", d2).where(F.col("__d2") <= bound * bound)
    if gate is not None:
        hit = hit.where(gate)
    best = hit.groupBy(*ident).agg(F.min(F.struct("__d2", *values, tx, ty)).alias("__b"))
    out = points.select(*own).join(best, list(ident), "left")
    return out.select(*own, *[F.col(f"__b.{v}").alias(v) for v in values], F.col(f"__b.{tx}").alias(tx), F.col(f"__b.{ty}").alias(ty), F.sqrt("__b.__d2").alias("distance"))


def updated(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left rows whose columns take the right side's values where these are known."""
    r = right.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    out = left.join(r, list(keys), "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in left.columns])


def within_bounds(df: DataFrame, bounds: DataFrame, keys: Sequence[str], column: str, low: str, high: str) -> DataFrame:
    """Rows whose value lies between the limits of their keys; rows without limits go."""
    return df.join(bounds.select(*keys, low, high), list(keys)).where(F.col(column).between(F.col(low), F.col(high))).drop(low, high)
