"""Structured Streaming forms: tumbling means, session windows, and a stateful track filter."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kalman


def tumbling(stream: DataFrame, keys: Sequence[str], ts: str, width: str, means: Sequence[str], late: str = "5 seconds") -> DataFrame:
    """Means of each key and bucket; buckets are final once the watermark has passed."""
    return stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, width)).agg(*[F.avg(c).alias(c) for c in means], F.count("*").alias("n")).select(*keys, F.col("window.start").alias("bucket"), *means, "n")


def session_windows(stream: DataFrame, keys: Sequence[str], ts: str, gap: str, late: str = "5 seconds") -> DataFrame:
    """Sessions of each key that end after a gap."""
    return stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), "n")


def tracked(stream: DataFrame, key: str, ts: str, measurement: Sequence[str], timeout_ms: int = 4100, late: str = "5 seconds") -> DataFrame:
    """Filtered states (key, ms, f_ and the state's names) while rows arrive: the state kept for each track is (x, P, last time in seconds).

    Rows of one batch are taken in the order of time; rows before the kept time are dropped as late, and a
    track is forgotten once the watermark passes its last time by the timeout.
    """
    names = [f"f_{c}" for c in kalman.STATE]
    kind = stream.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(ts, kind="stable")
        t = pdf[ts].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        z = pdf[list(measurement)].to_numpy(float)
        kept = state.getOption
        if kept is None:
            x, p = kalman.first_state(z[:1])
            last = t[0]
        else:
            flat = np.frombuffer(kept[0])
            x, p, last = flat[None, :6], flat[6:42].reshape(1, 6, 6), flat[42]
        out = []
        seen = np.ones(1, bool)
        for when, row in zip(t, z, strict=True):
            if when < last:
                continue
            dt = np.array([when - last])
            if dt[0] > 0:
                f = kalman.transition(dt, "calc")
                x = (f @ x[..., None])[..., 0]
                p = f @ p @ np.swapaxes(f, -1, -2) + kalman.noise_at(dt, row[None, 1], seen)
            x, p, _ = kalman.update(x, p, row[None], seen)
            last = when
            out.append((group[0], int(np.floor(when * 1000)), *x[0]))
        state.update((np.concatenate([x[0], p[0].ravel(), [last]]).tobytes(),))
        state.setTimeoutTimestamp(max(int(last * 1000) + timeout_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "ms", *names])

    schema = f"{key} {kind}, ms long, " + ", ".join(f"{c} double" for c in names)
    return stream.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, schema, "kept binary", "append", "EventTimeTimeout")
