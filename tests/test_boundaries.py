"""Strict and inclusive limits, nulls, ties, empty input."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor.functions import columns as C
from corridor.operators import extents, joins, pairs, stats, timeseries
from corridor.schema import require
from corridor.sources import readers, writers

T0 = dt.datetime(2024, 3, 13, 12)


def rows(spark, data, schema="k string, ts timestamp_ntz, i int, v double"):
    return spark.createDataFrame([(k, T0 + dt.timedelta(seconds=t), i, v) for i, (k, t, v) in enumerate(data)], schema)


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_require_names_what_is_missing(spark):
    with pytest.raises(ValueError, match="b, c"):
        require(spark.range(1), ["id", "b", "c"])


def test_gap_at_the_limit_is_no_new_session(spark):
    df = rows(spark, [("a", 0, 1.0), ("a", 10, 1.0), ("a", 20.001, 1.0)])
    assert column(timeseries.sessions(df, "k", "ts", ["ts", "i"], 10.0), "session") == [0, 0, 1]


def test_short_tracks_limits_are_inclusive_and_spans_exclusive(spark):
    df = rows(spark, [("a", 0, 0.0), ("a", 1, 2.0), ("b", 0, 0.0), ("b", 1, 1.9), ("c", 0, None), ("c", 5, None)]).withColumn("y", F.lit(0.0))
    assert {r.k for r in timeseries.short_tracks_removed(df, "k", "ts", ["ts", "i"], "v", "y", 2.0, 1).collect()} == {"a"}
    assert timeseries.short_spans_removed(df, "k", "ts", "v", 2.0, 0.5).count() == 0
    assert {r.k for r in timeseries.short_spans_removed(df, "k", "ts", "v", 1.95, 0.5).collect()} == {"a"}


def test_dangling_predictions_go(spark):
    df = rows(spark, [("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 2.0), ("a", 4, 2.0), ("b", 0, 1.0)])
    assert column(timeseries.tail_trimmed(df, "k", ["ts", "i"], F.col("v") > 0), "i") == [0, 1, 2]


def test_fills_and_interpolation_respect_keys_and_ends(spark):
    df = rows(spark, [("a", 0, None), ("a", 1, 1.0), ("a", 2, None), ("a", 3, 4.0), ("a", 4, None), ("b", 0, None)])
    o = ["ts", "i"]
    assert column(timeseries.forward_filled(df, "k", o, "v"), "v") == [None, 1.0, 1.0, 4.0, 4.0, None]
    assert column(timeseries.interpolated(df, "k", o, "v"), "v") == [None, 1.0, 2.5, 4.0, None, None]
    assert column(timeseries.next_filled(df, "k", o, "v"), "v") == [1.0, 1.0, 4.0, 4.0, None, None]


def test_null_after_null_is_a_change_only_if_asked(spark):
    df = rows(spark, [("a", 0, None), ("a", 1, None), ("a", 2, 1.0)])
    assert column(timeseries.changes(df, "k", ["ts", "i"], "v", "g"), "g") == [0, 0, 1]
    assert column(timeseries.changes(df, "k", ["ts", "i"], "v", "g", null_changes=True), "g") == [0, 1, 2]


def test_grid_starts_after_the_first_row_unless_asked(spark):
    df = rows(spark, [("a", 0, 1.0), ("a", 0.3, 2.0)])
    late = timeseries.densified(df, "k", "ts", 100, 200, ["v"]).collect()
    full = timeseries.densified(df, "k", "ts", 100, 200, ["v"], include_start=True).orderBy("ts").collect()
    assert len(late) == 3 and not any(r.v == 1.0 for r in late)
    assert [r.v for r in full] == [1.0, 1.0, 1.0, 2.0, 2.0, 2.0]
    assert [r.predicted for r in full] == [False] * 4 + [True] * 2 and [r.missing for r in full][:2] == [False, True]


def test_lane_band_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 1.0, 1.5, 3.0, 3.1, None)], "d double")
    assert [r[0] for r in df.select(C.lane_band("d", 0.0, 2.0)).collect()] == [0, 0, 1, 1, None, None]


def test_ties_lead_to_the_smaller_id(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 3, 1.0), (1, 4, 9.0)], "f int, id int, s double")
    got = {(r.id, r.leader) for r in pairs.leader_follower(df, ["f"], "id", "s").collect()}
    assert got == {(3, 5), (5, 4)}


def test_all_pairs_cells_lose_none(spark):
    df = spark.createDataFrame([(1, i, float((i * 37) % 101)) for i in range(40)], "f int, id int, s double")
    got = {(r.id, r.id_other) for r in pairs.all_pairs_in_frame(df, ["f"], "id", "s", 7.0).collect()}
    v = [(i, float((i * 37) % 101)) for i in range(40)]
    assert got == {(a, b) for a, s in v for b, t in v if (t > s or t == s and b > a) and t - s < 7.0}


def test_asof_joins(spark):
    left = spark.createDataFrame([("a", 10.0, 1), ("a", 0.5, 2), ("b", 3.0, 3), (None, 1.0, 4)], "k string, t double, id int")
    right = spark.createDataFrame([("a", 1.0, 7), ("a", 9.0, 8), ("a", 11.0, 9)], "k string, t double, v int")
    back = {r.id: r.v for r in joins.asof_backward(left, right, ["k"], "t", ["v"]).collect()}
    assert back == {1: 8, 2: None, 3: None, 4: None}
    near = {r.id: r.v for r in joins.asof_nearest(left, right.withColumnRenamed("t", "rt"), ["k"], "t", "rt", ["v"], 1.0, ["id"]).collect()}
    assert near == {1: 8, 2: 7, 3: None, 4: None}


def test_overlap_needs_a_positive_length(spark):
    df = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 5, 9), (1, 3, 4, 6)], "g int, id int, b int, e int")
    assert {(r.id, r.id_other) for r in pairs.overlapping(df, ["g"], "id", "b", "e").collect()} == {(1, 3), (2, 3)}


def _interval_table(spark):
    """Some 100 intervals of all lengths, equal begins and repeated identities among them, and 900 instants."""
    rng = np.random.default_rng(4)
    long = [(int(rng.integers(0, 3)), int(rng.integers(0, 60)), int(x), int(x + rng.integers(1, 4000))) for x in rng.integers(0, 9000, 100) // 50 * 50]
    rows = [*long, *((k % 3, 100 + k, 10 * k, 10 * k) for k in range(900)), (0, 2000, 500, 400), (None, 2001, 0, 9000), (1, None, 0, 9000)]
    return rows, spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "row int, g int, id int, b int, e int")


def test_overlaps_equal_brute_force(spark):
    rows, df = _interval_table(spark)
    want = sorted(
        (g, i, j, x[0], y[0], max(x[1], y[1]), min(x[2], y[2]))
        for k, (g, i, *_) in enumerate(rows)
        for m, (h, j, *_) in enumerate(rows)
        if g is not None and g == h and i is not None and j is not None and i < j
        for x, y in [((k, *rows[k][2:]), (m, *rows[m][2:]))]
        if min(x[2], y[2]) > max(x[1], y[1])
    )
    got = pairs.overlapping(df, ["g"], "id", "b", "e").collect()
    assert sorted((r.g, r.id, r.id_other, r.row, r.row_other, r.overlap_begin, r.overlap_end) for r in got) == want and len(want) > 300
    assert all((r.b, r.e, r.b_other, r.e_other) == (*rows[r.row][2:], *rows[r.row_other][2:]) for r in got)


def test_overlaps_send_no_instants(spark):
    _, df = _interval_table(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pairs.overlapping(df, ["g"], "id", "b", "e")
        out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    todo, sent = [out._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        if (m := p.metrics().get("shuffleRecordsWritten")).isDefined():
            sent.append(m.get().value())
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            todo.append(p.executedPlan() if name == "AdaptiveSparkPlanExec" else p.plan())
        else:
            todo += [p.children().apply(k) for k in range(p.children().size())]
    assert len(sent) == 2 and sum(sent) < 1000, sent  # some 100 begins, and 100 intervals in five cells or so


def test_gate_remembers_the_first_time_below(spark):
    data = [(1, 2, T0 + dt.timedelta(seconds=i), d) for i, d in enumerate([9.0, 1.0, 1.0, 1.0])]
    g = pairs.gate(spark.createDataFrame(data, "a int, b int, ts timestamp_ntz, d double"), "a", "b", "ts", "d", 4.0, 2).first()
    assert g.join_time == T0 + dt.timedelta(seconds=2) and g.least == 1.0 and g.pair == "1-2"


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        extents.front_back(spark.range(1), "median")


def test_offset_sweep_finds_the_planted_shift(spark):
    truth = rows(spark, [("a", i, float(i * i % 17)) for i in range(60)])
    seen = truth.withColumn("ts", F.expr("ts + INTERVAL 15 SECONDS"))
    best = stats.best_offset(stats.offset_sweep(truth, seen, "k", "ts", "v", range(10_000, 20_001, 500))).first()
    assert best.offset_ms == 15_000 and best.rmse == 0.0


def test_trip_of_nulls_has_path_zero(spark):
    t = stats.trip_summary(rows(spark, [("a", 0, None), ("a", 1, None)]), "k", "ts", ["ts", "i"], "v", None, "v").first()
    assert t.path == 0.0 and t.n == 2


def test_empty_input(spark):
    e = rows(spark, [])
    assert timeseries.sessions(e, "k", "ts", ["ts"], 1.0).count() == 0
    assert timeseries.densified(e, "k", "ts", 100, 0, ["v"]).count() == 0
    assert timeseries.resample(e, "k", "ts", "1 second", ["ts", "i"]).count() == 0


def test_readers_and_stage_store(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("10.0.0.1:\n  angle: 90.0\n  origin: [36.1, -87.6]\n10.0.0.2:\n  angle: 0\n  origin:\n    - -87.6\n    - 36.1\n")
    c = readers.calibration(str(tmp_path / "c.yaml"))
    assert c["10.0.0.1"]["lat"] == c["10.0.0.2"]["lat"] == 36.1 and c["10.0.0.1"]["angle"] == pytest.approx(1.5707963)
    assert c["10.0.0.1"]["x"] == pytest.approx(c["10.0.0.2"]["x"])
    (tmp_path / "l.json").write_text('{"features": [{"properties": {"name": "A"}, "geometry": {"type": "MultiLineString", "coordinates": [[[-87.6, 36.1], [-87.59, 36.1]]]}}]}')
    assert readers.lanes_utm(str(tmp_path / "l.json"))["A"].shape == (2, 2)
    assert readers.line_table(spark, str(tmp_path / "l.json")).first().name == "A"
    (tmp_path / "s.csv").write_text("SignalID,Timestamp,EventCode,EventParam\n1,2024-03-13 07:00:00.5,1,2\n1,2024-03-13 07:00:30.0,8,2\n1,2024-03-13 07:00:31.0,99,2\n")
    got = readers.signals(spark, str(tmp_path / "s.csv")).orderBy("since").collect()
    assert [r.colour for r in got] == ["G", "Y"] and got[0].since == dt.datetime(2024, 3, 13, 12, 0, 0, 500000) and got[0].until == got[1].since
    store, calls = writers.StageStore(spark, str(tmp_path / "store")), []

    def make():
        calls.append(1)
        return spark.range(3)

    for config in ({"x": 1}, {"x": 1}, {"x": 2}):
        assert store.get_or_compute("s", config, make).count() == 3
    assert len(calls) == 2  # another configuration is another result
    writers.write_parquet(spark.range(2).withColumn("P_x", F.lit(1.0)).withColumn("v", F.lit(1.5)), str(tmp_path / "o"), as_floats=True, drop=["P_"])
    assert spark.read.parquet(str(tmp_path / "o")).dtypes == [("id", "bigint"), ("v", "float")]


def test_directions_keep_the_sign_of_zero(spark):
    """Spark's own atan2 takes -0.0 for 0.0."""
    import math

    data = [(y, x) for y in (0.0, -0.0, 1.0, -1.0, float("nan"), None) for x in (0.0, -0.0, 2.0, -2.0, float("nan"), None)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(data)], "i int, y double, x double")
    for (y, x), got in zip(data, column(df.withColumn("a", C.heading("x", "y")), "a"), strict=True):
        want = None if y is None or x is None else math.atan2(y, x)
        assert str(got) == str(want) or got == pytest.approx(want, abs=1e-15) != 0, (y, x)


def test_compass_keeps_the_sign_of_zero(spark):
    df = spark.createDataFrame([(0, 0.0, -0.0), (1, -0.0, -0.0), (2, 0.0, 0.0), (3, -0.0, 0.0)], "i int, x double, y double")
    got = column(df.withColumn("a", C.compass("x", "y", 0.5)), "a")
    assert got == pytest.approx([28.64788975654116, 28.64788975654116, 208.64788975654116, 208.64788975654116])


def test_nearest_point_where_targets_lie_densely(spark, monkeypatch):
    """Small cells first, wider ones for the rest: as brute force has it, without wide cells for every point."""
    import numpy as np

    rng = np.random.default_rng(5)
    t = np.round(np.concatenate([rng.normal(0, 1, (1500, 2)), rng.uniform(-40, 40, (20, 2))]), 2)
    p = np.round(np.concatenate([rng.normal(0, 2, (200, 2)), rng.uniform(-45, 45, (200, 2))]), 2)
    t = np.concatenate([t, t[:100]])
    targets = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(t)], "name int, tx double, ty double")
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "i int, x double, y double")
    widths, inner = [], joins.nearest_on_grid
    monkeypatch.setattr(joins, "nearest_on_grid", lambda *a: widths.append(a[7]) or inner(*a))
    got = {r["i"]: r for r in joins.nearest_point(points, targets, ["i"], "x", "y", "tx", "ty", 5.0, ["name"]).collect()}
    assert len(got) == len(p) and widths[0] < 1 and widths[-1] == 5.0
    for i, v in enumerate(p):
        d2 = (v[0] - t[:, 0]) ** 2 + (v[1] - t[:, 1]) ** 2
        k = int(d2.argmin())
        assert (got[i]["name"], got[i]["distance"]) == ((k, pytest.approx(d2[k] ** 0.5, abs=1e-12)) if d2[k] <= 25 else (None, None))


def test_grid_does_not_broadcast_observations_of_an_explode(spark):
    """The planner takes rows that an explode made for as few as there were before it."""
    few = spark.range(3).select(F.col("id").cast("string").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(500))).alias("i"))
    df = few.select("k", F.timestamp_add("SECOND", F.col("i"), F.lit(T0).cast("timestamp_ntz")).alias("ts"), F.col("i").cast("double").alias("v"))
    out = timeseries.densified(df, "k", "ts", 1000, 0, ["v"], include_start=True)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1503
