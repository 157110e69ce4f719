"""From lane-mapped sensor tracks to fused, smoothed vehicle trajectories; also a command line."""

from __future__ import annotations

import argparse
import uuid
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assoc, extents, fusion, geo, kalman, pairs, timeseries
from ..schema import narrowed, over
from ..sources import readers, writers
from ..sources.writers import saved, shared_dir
from . import cleaning


@dataclass(frozen=True)
class Settings:
    prediction_seconds: float = 4.0
    step_ms: int = 100
    lane_step: float = 1.0
    max_gap: float = 17.5
    window: int = 20
    least_span: float = 5.0
    least_seconds: float = 2.0
    gate: float = assoc.GATES[0.95]
    gate_predicted: float = assoc.GATES[0.99]
    gate_prune: float = assoc.GATES[0.999]
    least_steps: int = 10
    most_tracks: int = 3
    skip: int = 15


#: A track's own columns.  Rows are dealt out by the first two once, and every window up to the steps lies within them.
TRACK = ["object_id", "lane", "kalman_id"]


def sessions(df: DataFrame, cfg: Settings) -> DataFrame:
    """Tracks on one lane without long gaps, at most 100 s each: kalman_id; projected onto the lane."""
    out = timeseries.sessions(df, TRACK[:2], "epoch_time", ["epoch_time"], cfg.prediction_seconds + 0.1, 100.0)
    out = out.withColumn("kalman_id", F.xxhash64("object_id", "lane", "session", "session_part"))
    out = timeseries.short_spans_removed(out, TRACK, "epoch_time", "s", cfg.least_span, cfg.least_seconds)
    out = extents.along_lane(out, TRACK, ["epoch_time"], "heading_utm", "heading_lane", "f32_velocityInDir_mps", ["f32_distanceToFront_m", "f32_distanceToBack_m", "f32_length_m"])
    return out.withColumnsRenamed({"f32_distanceToFront_m_s": "front_off", "f32_distanceToBack_m_s": "back_off", "f32_length_m_s": "length_s"})


def extended(df: DataFrame, cfg: Settings) -> DataFrame:
    """Regular steps, with predictions beyond each track's end, ready to be filtered."""
    keep = [*assoc.MEASURED, "front_off", "back_off", "length_s", "dist", "approaching"]
    out = timeseries.densified(df, "kalman_id", "epoch_time", cfg.step_ms, int(cfg.prediction_seconds * 1000), keep, include_start=True, within=TRACK[:2])
    return timeseries.filter_input(out, TRACK, "epoch_time", ["epoch_time"], assoc.MEASURED, cfg.least_steps).drop("measurement", "max_time")


def lengthened(steps: DataFrame) -> DataFrame:
    """Steps whose lengths are lifted to the mean one where they are seen short from afar; the mean is one number."""
    mean = extents.mean_length(steps).first()[0]
    return steps.withColumn("length_s", extents.lifted_length(F.lit(mean).cast("double")))


def places(steps: DataFrame) -> DataFrame:
    """Where the filter has each track: kalman_id, epoch_time, lane, s."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, got = kalman.estimates(pdf, "kalman_id", ["epoch_time"], assoc.MEASURED)
        return rows[["kalman_id", "epoch_time", "lane"]].assign(s=got["x"][:, 0])

    cols = ["kalman_id", "epoch_time", "lane", *assoc.MEASURED, "time_diff", "predicted", "missing"]
    return kalman.by_track(steps.select(*cols), "kalman_id", ["epoch_time"], run, "kalman_id long, epoch_time timestamp_ntz, lane string, s double")


def close(steps: DataFrame, cfg: Settings) -> DataFrame:
    """Pairs of tracks that were ever next to each other within the gap: kalman_id, leader."""
    return pairs.ever_close(places(steps.where("lane IS NOT NULL")), ["epoch_time", "lane"], "kalman_id", "s", cfg.max_gap).select(F.col("__f").alias("kalman_id"), F.col("__l").alias("leader"))


def matched(steps: DataFrame, near: DataFrame, cfg: Settings) -> DataFrame:
    """Edges between tracks that follow each other so closely that they are one vehicle: lo, hi, least."""
    both = saved(assoc.pair_distances(steps, near, "kalman_id", "leader"))
    gated = pairs.gate(both, "kalman_id", "kalman_id_leader", "epoch_time", "association_distance", cfg.gate, cfg.window)
    pred = both.groupBy(F.least("kalman_id", "kalman_id_leader").alias("lo"), F.greatest("kalman_id", "kalman_id_leader").alias("hi")).agg(F.every("any_pred").alias("only_predicted"))
    gated = gated.join(pred, ["lo", "hi"])
    ends = steps.groupBy("kalman_id").agg(F.max("epoch_time").alias("end"))
    return pairs.matches(gated, ends, "kalman_id", "end", cfg.gate, cfg.gate_predicted, F.col("only_predicted"))


def vehicles(steps: DataFrame, edges: DataFrame, cfg: Settings) -> DataFrame:
    """(id, component) of the tracks that share a vehicle: components of the edges, those of more than two tracks pruned first."""
    e = edges.select("lo", "hi", F.col("mean_filtered").alias("weight"))
    first = assoc.connected_components(e, "lo", "hi")
    large = first.groupBy("component").agg(F.count("*").alias("n")).where("n > 2").select("component")
    own = first.join(large, "component")
    together = saved(own.withColumnRenamed("id", "lo").join(own.withColumnRenamed("id", "hi"), "component").where("lo < hi"))
    if together.isEmpty():
        return first
    mean = F.avg("association_distance").over(over(["kalman_id", "kalman_id_leader"], "epoch_time").rowsBetween(-(cfg.window - 1), 0))
    weights = assoc.pair_distances(steps, together, "lo", "hi").withColumn("m", mean).groupBy(F.col("kalman_id").alias("lo"), F.col("kalman_id_leader").alias("hi")).agg(F.avg("m").alias("weight"))
    mine = e.join(first.select(F.col("id").alias("lo"), "component"), "lo")
    kept = assoc.pruned_edges(mine.join(large, "component", "left_semi"), weights.join(together, ["lo", "hi"]), cfg.gate_prune).select("lo", "hi")
    rest = mine.join(large, "component", "left_anti").select("lo", "hi")
    return assoc.connected_components(kept.unionByName(rest), "lo", "hi")


def trajectories(steps: DataFrame, components: DataFrame, cfg: Settings) -> DataFrame:
    """One smoothed row for each vehicle and time.

    Steps are dealt out by vehicle once, as they were measured; all windows and the kernel lie within a vehicle.
    """
    cols = ["kalman_id", "epoch_time", "lane", *assoc.MEASURED, F.col("time_diff").alias("seconds"), *assoc.CARRIED[1:]]
    own = kalman.dealt(assoc.with_vehicle(steps.select(*cols), components, "kalman_id"), "vehicle_id")
    chosen = fusion.marked(own, "vehicle_id", ["vehicle_id", "kalman_id"], "epoch_time", "predicted", cfg.most_tracks, cfg.prediction_seconds, cfg.skip)
    out = fusion.trajectory_rows(chosen)
    shift = F.col("centroid_s") - F.col("ci_s")
    return out.withColumn("s_velocity", F.col("s_velocity_smooth")).withColumn("centre_shift", shift)


def run(tracks: DataFrame, cfg: Settings = Settings(), lanes: DataFrame | None = None, store: writers.StageStore | None = None, source: str = "") -> DataFrame:
    """Lane-mapped tracks (object_id, epoch_time, lane, s, d, headings, speed, extents) -> trajectories.

    With lanes, positions of the smoothed and fused centres, fronts and backs are added in one pass.  Stages are written
    once, to the given store or to a folder of this run below the shared one, since later stages read them repeatedly; the
    trajectories only go to a given store.  States and covariances are large and follow from the steps, so they are
    computed where they are needed and never written.
    """
    own = store is None
    if own:
        store = writers.StageStore(tracks.sparkSession, f"{shared_dir(tracks.sparkSession)}/run-{uuid.uuid4().hex}")
    inputs = [source] if source else []
    keep = lambda name, f: store.get_or_compute(name, asdict(cfg), f, inputs)
    steps = lengthened(keep("steps", lambda: extended(sessions(tracks, cfg), cfg)))
    near = keep("close", lambda: close(steps, cfg))
    edges = keep("edges", lambda: matched(steps, near, cfg))
    components = keep("vehicles", lambda: vehicles(steps, edges, cfg))
    make = lambda: trajectories(steps, components, cfg)
    out = fusion.trimmed(make() if own else keep("trajectories", make), "vehicle_id", "epoch_time")
    if lanes is not None:
        places = {"centroid": ("s_smooth", "d_smooth"), "front": ("front_s", "d_smooth"), "back": ("back_s", "d_smooth"), "ci": ("ci_s", "ci_d")}
        out = geo.many_to_xy(out, lanes, ["vehicle_id", "time_index"], places, step=cfg.lane_step)
    return out


def main(argv: list[str] | None = None) -> None:
    """Raw Parquet, lanes and calibration in, trajectories out."""
    p = argparse.ArgumentParser(description="Fuse sensor tracks into vehicle trajectories")
    p.add_argument("raw_data_path")
    p.add_argument("output_path")
    p.add_argument("calibration_yaml")
    p.add_argument("lanes_geojson")
    p.add_argument("--prediction-length", type=float, default=4.0)
    p.add_argument("--cache-dir", default=None)
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--build-small", action="store_true", help="only day 13, hour 12")
    p.add_argument("--lowpass-filter", action="store_true", help="filter speeds before sessions are built")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("trajectories").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    cfg = Settings(prediction_seconds=a.prediction_length)
    raw = readers.parquet(spark, a.raw_data_path)
    raw = cleaning.small_subset(raw) if a.build_small else raw
    lanes = geo.network(spark, readers.lanes_utm(a.lanes_geojson, spark=spark), cfg.lane_step)
    tracks = cleaning.on_lanes(cleaning.cleaned(raw, readers.calibration_table(spark, readers.calibration(a.calibration_yaml, spark))), lanes)
    if a.lowpass_filter:
        from ..operators.probe import low_passed

        tracks = low_passed(tracks, "object_id", ["epoch_time"], ["f32_velocityInDir_mps"])
    store = writers.StageStore(spark, a.cache_dir, not a.no_cache) if a.cache_dir else None
    out = run(tracks, cfg, lanes, store, a.raw_data_path)
    writers.write_parquet(narrowed(out), a.output_path)


if __name__ == "__main__":
    main()
