"""From associated tracks to one trajectory a vehicle: choice of contributors, fusion, and the final columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.columns import seconds_between
from ..schema import over
from .assoc import CARRIED, MEASURED, distances, tracked
from .kalman import NOISE_S, STATE, _dense, _kind, _scatter, by_track, process_noise, smoothed_rows, transition
from .pairs import with_suffix
from .timeseries import Names, _list

#: Measurement noise that the fast rule widens covariances by, for s, s', d and d'.
R_WIDEN = np.zeros((6, 6))
R_WIDEN[[0, 1, 3, 4], [0, 1, 3, 4]] = (0.5, 0.8112, 0.1, 0.1)


def marked(df: DataFrame, vehicle: str, track: Names, ts: str, predicted: str, most: int = 3, prediction_seconds: float = 4.0, skip: int = 15, pick: int = 1) -> DataFrame:
    """All rows, those of ``contributors`` marked as ``chosen``; only on these do the columns that it adds say anything.

    Where ``track`` begins with the vehicle, every window lies within a vehicle, so that rows dealt by it stay where they are.
    """
    track = _list(track)
    meets = lambda c: F.coalesce(c, F.lit(False))
    out = df.withColumn("start_time", F.min(ts).over(over(track)))
    out = out.withColumn("__cum", F.row_number().over(over(track, ts)) - 1)
    frame = [vehicle, ts]
    live = [*frame, "chosen"]
    out = out.withColumn("__nth", F.row_number().over(over(frame, ["start_time", *track])) - 1)
    out = out.withColumn("timedelta", seconds_between(F.max(ts).over(over(vehicle)), F.col(ts)))
    out = out.withColumn("chosen", meets((F.col("__nth") < 1) | (F.col("__cum") > skip)))
    out = out.withColumn("count", F.count("*").over(over(live))).withColumn("all_pred", F.every(predicted).over(over(live)))
    out = out.withColumn("__nth", F.row_number().over(over(live, ["start_time", *track])) - 1)
    alone = ~F.col(predicted) | (F.col("count") == 1) | (F.col("all_pred") & (F.col("__nth") == pick))
    out = out.withColumn("chosen", F.col("chosen") & meets(alone) & meets(~(F.col("all_pred") & (F.col("timedelta") < prediction_seconds))))
    out = out.withColumn("time_index", F.dense_rank().over(over([vehicle, "chosen"], ts)) - 1)
    out = out.withColumn("contributor", F.row_number().over(over(live, [predicted, "start_time", *track])) - 1)
    out = out.withColumn("chosen", F.col("chosen") & (F.col("contributor") < most))
    out = out.withColumn("time_diff", F.coalesce(seconds_between(F.col(ts), F.lag(ts).over(over([*track, "chosen"], ts))), F.lit(0.0)))
    return out.drop("__cum", "__nth")


def contributors(df: DataFrame, vehicle: str, track: Names, ts: str, predicted: str, most: int = 3, prediction_seconds: float = 4.0, skip: int = 15, pick: int = 1) -> DataFrame:
    """At most ``most`` rows for each vehicle and time.

    The first ``skip`` rows of a later track go while another one is there, predictions go where data exist, frames of
    predictions only keep the row at index ``pick`` and go altogether in the last seconds of a vehicle.
    """
    return marked(df, vehicle, track, ts, predicted, most, prediction_seconds, skip, pick).where("chosen").drop("chosen")


def _inv(p: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(p, hermitian=True)


def intersect(x, p, xi, pi, rule: str = "fast"):
    """Covariance intersection of estimates; the weight comes from determinants."""
    if rule == "fast":
        a, b = _inv(p), _inv(pi)
        d = np.linalg.det(a + b)
        w = ((d - np.linalg.det(b) + np.linalg.det(a)) / np.where(d == 0, 1.0, 2 * d)).clip(0, 1)[..., None, None]
    elif rule == "plain":
        a, b = _inv(p), _inv(pi)
        u, v = np.linalg.det(pi), np.linalg.det(p)
        w = (u / np.where(u + v == 0, 1.0, u + v)).clip(0, 1)[..., None, None]
    else:
        raise ValueError(rule)
    pf = _inv(w * a + (1 - w) * b)
    xf = (pf @ (w * a @ x[..., None] + (1 - w) * b @ xi[..., None]))[..., 0]
    return xf, pf


def fuse(z: np.ndarray, pz: np.ndarray, there: np.ndarray, dt: np.ndarray, rule: str = "fast", who: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fused states over arrays [time, vehicle, contributor, ...]; ``there`` says who contributes.

    The first step is the first contributor's own estimate; updates begin with the second step.

    'fast' intersects covariances that are widened by ``R_WIDEN``, the first estimate's too, contributor by contributor.
    'plain' intersects the covariances as they are, last contributor first.
    'information' adds what each track's measurement of the step told it, inv(P_t) - inv(P_t|t-1), for tracks that are
    there at both steps; predictions of the tracks and of the fused state carry no process noise.  ``who`` numbers the
    track behind each contributor, so that a track is found again in another place; without it places are tracks.
    """
    steps, n, m = there.shape
    xs, ps = np.zeros((steps, n, 6)), np.zeros((steps, n, 6, 6))
    own = pz + R_WIDEN if rule == "fast" else pz
    x, p = z[0, :, 0].copy(), own[0, :, 0].copy()
    xs[0], ps[0] = x, p
    if who is None:
        who = np.broadcast_to(np.arange(m), there.shape)
    for t in range(1, steps):
        f = transition(dt[t], "calc")
        x, p = (f @ x[..., None])[..., 0], f @ p @ np.swapaxes(f, -1, -2)
        if rule == "information":
            total = _inv(p)
            gained = total @ x[..., None]
            for k in range(m):
                for j in range(m):  # the same track one step before
                    on = (there[t, :, k] & there[t - 1, :, j] & (who[t, :, k] == who[t - 1, :, j]))[:, None, None]
                    if not on.any():
                        continue
                    after, before = _inv(pz[t, :, k]), _inv(f @ pz[t - 1, :, j] @ np.swapaxes(f, -1, -2))
                    total = total + np.where(on, after - before, 0.0)
                    gained = gained + np.where(on, after @ z[t, :, k, :, None] - before @ (f @ z[t - 1, :, j, :, None]), 0.0)
            p = _inv(total)
            x = (p @ gained)[..., 0]
        else:
            p = p + process_noise(dt[t], NOISE_S**0.5)
            for k in range(m) if rule == "fast" else range(m - 1, -1, -1):
                x1, p1 = intersect(x, p, z[t, :, k], own[t, :, k], rule)
                on = there[t, :, k, None]
                x, p = np.where(on, x1, x), np.where(on[..., None], p1, p)
        xs[t], ps[t] = x, p
    return xs, ps


def fused_rows(pdf: pd.DataFrame, x: np.ndarray, p: np.ndarray, vehicle: str, rule: str = "fast", track: str | None = None) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A row for each vehicle and time_index, with its seconds __t, and the fused states and covariances.

    ``pdf`` has a row for each contributor of whole vehicles, ``x`` and ``p`` its states and covariances.
    """
    frames = pdf.drop_duplicates([vehicle, "time_index"])[[vehicle, "time_index", "__t"]]
    pdf = pdf.assign(__row=np.arange(len(pdf)), __who=pd.factorize(pdf[track])[0] if track else 0)
    parts = []
    for rows, t, v, _ in _scatter(frames, vehicle, ["time_index"]):
        place = pd.DataFrame({vehicle: rows[vehicle], "time_index": rows["time_index"], "t": t, "v": v})
        own = pdf[[vehicle, "time_index", "contributor", "__row", "__who"]].merge(place, on=[vehicle, "time_index"])
        k = own["contributor"].to_numpy(int)
        shape = (t.max() + 1, v.max() + 1, k.max() + 1)
        z, pz, there = np.zeros((*shape, 6)), np.broadcast_to(np.eye(6), (*shape, 6, 6)).copy(), np.zeros(shape, bool)
        at = own["t"].to_numpy(), own["v"].to_numpy(), k
        z[at], pz[at], there[at] = x[own["__row"]], p[own["__row"]], True
        who = None
        if track:
            who = np.full(shape, -1)
            who[at] = own["__who"]
        sec = _dense(rows["__t"].to_numpy(float), t, v)
        dt = np.zeros_like(sec)
        dt[1:] = np.maximum(sec[1:] - sec[:-1], 0)
        xs, ps = fuse(z, pz, there, dt, rule, who)
        parts.append((rows, xs[t, v], ps[t, v]))
    rows, xs, ps = zip(*parts, strict=True)
    return pd.concat(rows, ignore_index=True), np.concatenate(xs), np.concatenate(ps)


def fused(df: DataFrame, vehicle: str, ts: str, state: Sequence[str] = tuple(STATE), covariance: str = "P_calc", alone: str = "P", rule: str = "fast", prefix: str = "ci_", track: str | None = None, groups: int | None = None) -> DataFrame:
    """One row for each vehicle and time from rows with time_index and contributor.

    Vehicles that never have two contributors at once keep their own states and the covariance ``alone``.  ``track``
    names the column that tells contributors apart over time (rule 'information').
    """
    out_cols = [f"{prefix}{c}" for c in state]
    schema = f"{vehicle} {_kind(df, vehicle)}, time_index long, " + ", ".join(f"{c} double" for c in out_cols) + f", {prefix}P array<double>"
    df = df.withColumn("__many", F.max("contributor").over(over(vehicle)) > 0)
    names = [track] if track else []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, x, p = fused_rows(pdf, pdf[list(state)].to_numpy(float), np.stack(pdf[covariance].to_numpy()).reshape(-1, 6, 6), vehicle, rule, track)
        out = pd.DataFrame({vehicle: rows[vehicle].to_numpy(), "time_index": rows["time_index"].to_numpy(), **{c: x[:, j] for j, c in enumerate(out_cols)}})
        out[f"{prefix}P"] = list(p.reshape(-1, 36))
        return out

    seconds = df.withColumn("__t", seconds_between(F.col(ts), F.min(ts).over(over(vehicle))))
    chosen = seconds.where("__many").select(vehicle, "time_index", "contributor", "__t", *state, covariance, *names)
    many = by_track(chosen, vehicle, ["time_index", "contributor"], run, schema, groups)
    single = df.where(~F.col("__many")).select(vehicle, F.col("time_index").cast("long"), *[F.col(c).alias(f"{prefix}{c}") for c in state], F.col(alone).alias(f"{prefix}P"))
    return many.unionByName(single)


def greatest_pair_distance(df: DataFrame, frame: Sequence[str], nth: str, distance) -> DataFrame:
    """Greatest distance between two contributors of a frame; ``distance`` maps the joined pairs to a column."""
    out = df.join(with_suffix(df, "_leader", frame), list(frame)).where(F.col(nth) < F.col(f"{nth}_leader"))
    return distance(out).groupBy(*frame).agg(F.max("association_distance").alias("association_distance"))


def augmented(df: DataFrame, frame: Sequence[str], track: str, front: str, back: str, approaching: str, predicted: str, extra: Sequence[Column] = ()) -> DataFrame:
    """What each frame says beside the fused state, in one aggregation.

    Fronts come from approaching tracks and backs from receding ones where there are any, else from all; the centre
    lies half-way.
    """
    out = df.groupBy(*frame).agg(
        F.array_sort(F.collect_list(track)).alias("tracks"),
        F.count("*").alias("n_tracks"),
        F.every(predicted).alias("prediction"),
        F.coalesce(F.avg(F.when(F.col(approaching), F.col(front))), F.avg(front)).alias("front_s"),
        F.coalesce(F.avg(F.when(~F.col(approaching), F.col(back))), F.avg(back)).alias("back_s"),
        *extra,
    )
    return out.withColumn("centroid_s", (F.col("front_s") + F.col("back_s")) / 2).withColumn("length_s", F.abs(F.col("front_s") - F.col("back_s")))


_FRAME = f"""vehicle_id long, time_index long, {", ".join(f"ci_{c} double" for c in STATE)}, ci_P array<double>, tracks array<long>, n_tracks long, prediction boolean,
front_s double, back_s double, epoch_time timestamp_ntz, lane string, centroid_s double, length_s double, association_distance double, time_diff double,
time_ind long, {", ".join(f"{c}_smooth double" for c in STATE)}"""


def trajectory_rows(steps: DataFrame) -> DataFrame:
    """Marked steps of tracks (``marked`` by vehicle_id), dealt out by their vehicle -> a row for each vehicle and time.

    Tracks are filtered once more, then their contributors fused, summed up (as in ``augmented``, with the greatest distance of two
    measured ones) and smoothed, a whole vehicle at a time, so that covariances are never stored or shuffled.  ``seconds``
    is the time since the track's last step.
    """
    target = to_arrow_schema(StructType.fromDDL(_FRAME))

    def run(pdf: pd.DataFrame) -> pa.RecordBatch:
        rows, got, spots = tracked(pdf, "kalman_id", ["epoch_time"], "seconds")
        at = np.flatnonzero(rows["chosen"].to_numpy(bool))
        at = at[np.lexsort([rows[c].to_numpy()[at] for c in ("kalman_id", "time_index", "vehicle_id")])]
        own, x, spots = rows.iloc[at].reset_index(drop=True), got["x"][at], spots[at]
        alone, calc = (got[k][at].reshape(-1, 6, 6) for k in ("P", "P_calc"))
        vehicle, index = own["vehicle_id"].to_numpy(), own["time_index"].to_numpy()
        new = np.r_[True, (vehicle[1:] != vehicle[:-1]) | (index[1:] != index[:-1])][: len(own)]
        first, frame = np.flatnonzero(new), np.cumsum(new) - 1
        n, many = len(first), own.groupby("vehicle_id")["contributor"].transform("max").to_numpy() > 0
        ms = own["epoch_time"].to_numpy().astype("datetime64[ms]").astype(np.int64)
        own["__t"] = (ms - pd.Series(ms).groupby(vehicle).transform("min").to_numpy()) / 1000.0
        cx, cp = x[first], alone[first]
        if many.any():
            got_rows, fx, fp = fused_rows(own[many], x[many], calc[many], "vehicle_id")
            back = np.lexsort([got_rows["time_index"].to_numpy(), got_rows["vehicle_id"].to_numpy()])
            cx[many[first]], cp[many[first]] = fx[back], fp[back]
        predicted = own["predicted"].to_numpy(bool)

        def mean(column: str, where: np.ndarray) -> np.ndarray:
            v = own[column].to_numpy(float)
            seen = ~np.isnan(v)
            some = seen & where
            some = np.where(np.bincount(frame, some, n)[frame] > 0, some, seen)
            with np.errstate(invalid="ignore"):
                return np.bincount(frame, np.where(some, v, 0.0), n) / np.bincount(frame, some, n)

        front, rear = mean("front_s", (own["approaching"] == True).to_numpy(bool)), mean("back_s", (own["approaching"] == False).to_numpy(bool))  # noqa: E712
        far = np.full(n, -np.inf)
        for k in range(1, int(np.bincount(frame).max()) if n else 0):
            i = np.flatnonzero((frame[k:] == frame[:-k]) & ~predicted[k:] & ~predicted[:-k])
            if len(i):
                np.maximum.at(far, frame[i], distances(spots[i], spots[i + k], alone[i] + alone[i + k]))
        code, lanes = pd.factorize(own["lane"], sort=True)
        lane = np.maximum.reduceat(code, first) if n else code
        step, same = np.diff(ms[first]) / 1000.0, vehicle[first][1:] == vehicle[first][:-1]
        dt = np.full(n, np.nan)
        dt[:-1][same] = step[same]  # the first frame takes the second one's
        dt[1:][same] = step[same]
        frames = pd.DataFrame({"vehicle_id": vehicle[first], "time_index": index[first], "time_diff": dt})
        soft = np.zeros((n, 6))
        if n:
            placed, xs = smoothed_rows(frames, cx, cp, "vehicle_id", ["time_index"])
            soft[placed["__row"]] = xs
        ends = np.append(first, len(own)).astype(np.int32)
        columns = {
            **frames, **{f"ci_{c}": cx[:, k] for k, c in enumerate(STATE)}, **{f"{c}_smooth": soft[:, k] for k, c in enumerate(STATE)},
            "ci_P": pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * 36, cp.ravel()), "tracks": pa.ListArray.from_arrays(ends, own["kalman_id"].to_numpy()),
            "n_tracks": np.diff(ends), "prediction": np.logical_and.reduceat(predicted, first) if n else predicted, "front_s": front, "back_s": rear, "epoch_time": own["epoch_time"].to_numpy()[first],
            "lane": np.append(np.asarray(lanes, dtype=object), None)[lane], "centroid_s": (front + rear) / 2, "length_s": np.abs(front - rear),
            "association_distance": np.where(np.isinf(far), np.nan, far), "time_ind": index[first],
        }
        made = [c if isinstance(c, pa.Array) else pa.Array.from_pandas(c) for c in (columns[f.name] for f in target)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, target, strict=True)], schema=target)

    cols = ["vehicle_id", "kalman_id", "epoch_time", "lane", *MEASURED, "seconds", *CARRIED[1:], "chosen", "time_index", "contributor"]
    return by_track(steps.select(*cols), "vehicle_id", ["kalman_id", "epoch_time"], run, _FRAME, deal=False)


def trimmed(df: DataFrame, vehicle: str, ts: str, least_seconds: float = 5.0) -> DataFrame:
    """Final rows: on a lane, with a speed, of vehicles that last long enough; with per-vehicle summaries."""
    w = over(vehicle)
    out = df.where(F.col("lane").isNotNull() & F.col("s_velocity").isNotNull())
    out = out.withColumn("mean_association_distance", F.avg("association_distance").over(w)).withColumn("most_tracks", F.max(F.size("tracks")).over(w))
    out = out.withColumn("elapsed", seconds_between(F.col(ts), F.min(ts).over(w)))
    return out.withColumn("__d", F.max("elapsed").over(w)).where(F.col("__d") > least_seconds).drop("__d")
