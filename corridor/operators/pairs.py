"""Pairs of tracks: leaders and followers, gates, overlaps, episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pair
from ..schema import over


def with_suffix(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else f"{c}{suffix}") for c in df.columns])


def leader_follower(df: DataFrame, frame: Sequence[str], ident: str, s: str) -> DataFrame:
    """Each row with the next one ahead in its frame (time, lane): leader, its s, and the gap.  One window, no join."""
    w = over(frame, [s, ident])
    out = df.withColumn("leader", F.lead(ident).over(w)).withColumn(f"{s}_leader", F.lead(s).over(w))
    return out.where(F.col("leader").isNotNull()).withColumn("s_gap", F.col(f"{s}_leader") - F.col(s))


def ever_close(df: DataFrame, frame: Sequence[str], ident: str, s: str, max_gap: float) -> DataFrame:
    """Pairs (__f, __l) that were ever next to each other within the gap."""
    return leader_follower(df, frame, ident, s).where(F.col("s_gap") < max_gap).select(F.col(ident).alias("__f"), F.col("leader").alias("__l")).distinct()


def leader_follower_history(df: DataFrame, frame: Sequence[str], ident: str, s: str, max_gap: float) -> DataFrame:
    """All common rows, frame by frame, of the pairs that were ever next to each other within the gap."""
    close = ever_close(df, frame, ident, s, max_gap)
    ahead = with_suffix(df, "_leader", frame)
    mine = df.join(close, df[ident] == close["__f"])
    both = mine.join(ahead, [*[mine[c] == ahead[c] for c in frame], mine["__l"] == ahead[f"{ident}_leader"]]).drop("__f", "__l")
    for c in frame:
        both = both.drop(ahead[c])
    return both.withColumn("s_gap", F.col(f"{s}_leader") - F.col(s))


def all_pairs_in_frame(df: DataFrame, frame: Sequence[str], ident: str, s: str, max_gap: float) -> DataFrame:
    """Pairs of different rows of a frame less than ``max_gap`` apart, the second ahead.

    The gap becomes a cell of s, so only neighbouring cells of a frame meet, however many rows a frame has.
    """
    cell = F.floor(F.col(s) / max_gap)
    a = df.withColumn("__c", cell)
    b = with_suffix(df, "_other", frame).withColumn("__c", F.explode(F.array(*[F.floor(F.col(f"{s}_other") / max_gap) - k for k in (0, 1)])))
    out = a.join(b, [*frame, "__c"]).drop("__c")
    ahead = (F.col(f"{s}_other") > F.col(s)) | ((F.col(f"{s}_other") == F.col(s)) & (F.col(f"{ident}_other") > F.col(ident)))
    return out.where(ahead & (F.col(f"{s}_other") - F.col(s) < max_gap)).withColumn("s_gap", F.col(f"{s}_other") - F.col(s))


def gate(df: DataFrame, first: str, second: str, ts: str, value: str, cutoff: float, window: int = 20, order: Sequence[str] = ()) -> DataFrame:
    """Per unordered pair: the least trailing mean of ``value``, when it first meets the cutoff, first and last time."""
    lo, hi, name = pair(first, second)
    order = [ts, *order, first, second]
    out = df.withColumns({"lo": lo, "hi": hi, "pair": name})
    out = out.withColumn("filtered", F.avg(value).over(over("pair", order).rowsBetween(-(window - 1), 0)))
    at = F.struct(*order)
    return out.groupBy("pair", "lo", "hi").agg(
        F.min("filtered").alias("least"),
        F.min_by(ts, F.when(F.col("filtered") <= cutoff, at)).alias("join_time"),
        F.min(ts).alias("first_time"),
        F.max(ts).alias("last_time"),
        F.avg("filtered").alias("mean_filtered"),
        F.count("*").alias("n"),
    )


def matches(gated: DataFrame, ends: DataFrame, ident: str, end: str, cutoff: float, cutoff_predicted: float, predicted: Column) -> DataFrame:
    """Gated pairs with both tracks' ends, kept if the least distance meets the cutoff that applies."""
    e = ends.select(F.col(ident).alias("__id"), F.col(end).alias("__end"))
    out = gated.join(e.withColumnsRenamed({"__id": "lo", "__end": "end_lo"}), "lo").join(e.withColumnsRenamed({"__id": "hi", "__end": "end_hi"}), "hi")
    return out.where(F.col("least") <= F.when(predicted, F.lit(cutoff_predicted)).otherwise(F.lit(cutoff)))


def overlapping(df: DataFrame, group: Sequence[str], ident: str, begin: str, end: str) -> DataFrame:
    """Pairs of a group's intervals that overlap: the earlier end lies after the later begin.

    Only intervals of positive length can overlap, and of two that do the later one begins inside the earlier one.  So each
    begin meets, in its cell of time, the intervals that cover the cell: a pair is looked at once, in one order, whatever
    its overlap.  Cells are a quarter of the mean length, so a group of any size is dealt out over time.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    df = df.where(F.col(end) > F.col(begin))
    mean = df.agg(F.avg(at(end) - at(begin))).first()[0]
    width = max(int((mean or 0) / 4), 1)
    rest = [c for c in df.columns if c not in group]
    cell = {c: F.floor(at(c) / width) for c in (begin, end)}
    early = df.withColumn("__cell", F.explode(F.sequence(cell[begin], F.greatest(cell[end], cell[begin]))))
    late = with_suffix(df.withColumn("__cell", cell[begin]), "_other", [*group, "__cell"])
    both = early.join(late, [*group, "__cell"])
    mine, other, b, b_other = F.col(ident), F.col(f"{ident}_other"), F.col(begin), F.col(f"{begin}_other")
    both = both.where((b_other < F.col(end)) & ((b < b_other) & (mine != other) | (b == b_other) & (mine < other)))
    one = [F.when(mine < other, F.col(c)).otherwise(F.col(f"{c}_other")).alias(c) for c in rest]
    two = [F.when(mine < other, F.col(f"{c}_other")).otherwise(F.col(c)).alias(f"{c}_other") for c in rest]
    return both.select(*group, *one, *two, b_other.alias("overlap_begin"), F.least(end, f"{end}_other").alias("overlap_end"))


def episodes(df: DataFrame, follower: str, leader: str, ts: str, order: Sequence[str], aggs: Sequence[Column], frame: Sequence[str] = ()) -> DataFrame:
    """Stretches in which a follower keeps its leader, aggregated."""
    w = over([*frame, follower], [ts, *order])
    change = ~F.col(leader).eqNullSafe(F.lag(leader).over(w)) & (F.row_number().over(w) > 1)
    out = df.withColumn("__c", change.cast("int")).withColumn("episode", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*frame, follower, leader, "episode").agg(*aggs)


def bad_pairs_removed(pairs: DataFrame, votes: DataFrame, key: str, good: Column) -> DataFrame:
    """Pairs all of whose votes are good."""
    return pairs.join(votes.groupBy(key).agg(F.every(good).alias("__g")).where("__g").select(key), key, "left_semi")
