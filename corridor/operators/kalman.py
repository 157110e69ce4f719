"""Recursive estimation along lanes: Kalman, interacting multiple models, and backward smoothing.

State (s, s', s'', d, d', d''), measurement (s, s', d, d').  The kernels are numpy over many tracks at once and step
through time together; Spark deals tracks out by a hash and hands whole groups over as Arrow tables.  Within a group,
tracks of similar length are batched, so padding stays below a factor of two.  Whether a step was measured is a
mask of its own, never a zero.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

H = np.zeros((4, 6))
H[[0, 1, 2, 3], [0, 1, 3, 4]] = 1
R_FILTER = np.diag([0.6, 1.013779, 0.6, 0.5]) ** 2
NOISE_S, NOISE_D, STANDING = 2.0, 0.5, 0.2
#: Mode transitions and first weights of (accelerating, lane keeping, lane keeping at constant speed).
MODES = np.array([[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]])
FIRST = np.array([0.1, 0.1, 0.8])
STATE = ["s", "s_velocity", "s_accel", "d", "d_velocity", "d_accel"]


def transition(dt: np.ndarray, model: str) -> np.ndarray:
    """F for each time step: 'calc' accelerates in s and d, 'calk' in s alone, 'cvlk' keeps its speed."""
    dt = np.asarray(dt, float)
    f = np.zeros((*dt.shape, 6, 6))
    f[..., 0, 0] = f[..., 1, 1] = f[..., 3, 3] = 1
    f[..., 0, 1] = dt
    if model != "cvlk":
        f[..., 2, 2] = 1
        f[..., 0, 2], f[..., 1, 2] = dt**2 / 2, dt
    if model == "calc":
        f[..., 4, 4] = f[..., 5, 5] = 1
        f[..., 3, 4], f[..., 3, 5], f[..., 4, 5] = dt, dt**2 / 2, dt
    return f


def process_noise(dt: np.ndarray, sigma_s: np.ndarray | float = NOISE_S**0.5, sigma_d: float = NOISE_D**0.5) -> np.ndarray:
    """White noise of acceleration on either axis."""
    dt = np.asarray(dt, float)
    g = np.stack([dt**2 / 2, dt, np.ones_like(dt)], axis=-1)
    block = g[..., :, None] * g[..., None, :]
    q = np.zeros((*dt.shape, 6, 6))
    q[..., :3, :3] = block * (np.broadcast_to(sigma_s, dt.shape) ** 2)[..., None, None]
    q[..., 3:, 3:] = block * sigma_d**2
    return q


def noise_at(dt: np.ndarray, speed: np.ndarray, measured: np.ndarray) -> np.ndarray:
    """No noise along s while a vehicle stands or a step is unmeasured."""
    return process_noise(dt, np.where(measured & (np.abs(speed) > STANDING), NOISE_S**0.5, 0.0))


def _T(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2)


def update(x, p, z, measured, r=R_FILTER):
    """Joseph-form update where measured; also the log-likelihood of each measurement."""
    y = z - x @ H.T
    s = H @ p @ H.T + r
    k = p @ H.T @ np.linalg.inv(s)
    keep = np.eye(6) - k @ H
    x1, p1 = x + (k @ y[..., None])[..., 0], keep @ p @ _T(keep) + k @ r @ _T(k)
    _, logdet = np.linalg.slogdet(s)
    ll = -0.5 * ((y * np.linalg.solve(s, y[..., None])[..., 0]).sum(-1) + logdet + z.shape[-1] * np.log(2 * np.pi))
    m = measured[..., None]
    return np.where(m, x1, x), np.where(m[..., None], p1, p), ll


def first_state(z0: np.ndarray, speed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    x = z0 @ H
    if speed is not None:
        x[:, 1] = speed
    return x, np.broadcast_to(np.eye(6), (len(z0), 6, 6)).copy()


def kalman(z: np.ndarray, dt: np.ndarray, measured: np.ndarray, model: str = "calc", speed0: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Single-model filter over arrays [time, track, ...]."""
    steps, n = z.shape[:2]
    xs, ps = np.zeros((steps, n, 6)), np.zeros((steps, n, 6, 6))
    x, p = first_state(z[0], speed0)
    for t in range(steps):
        if t:
            f = transition(dt[t], model)
            x = (f @ x[..., None])[..., 0]
            p = f @ p @ _T(f) + noise_at(dt[t], z[t, :, 1], measured[t])
        x, p, _ = update(x, p, z[t], measured[t])
        xs[t], ps[t] = x, p
    return xs, ps


def imm(z: np.ndarray, dt: np.ndarray, measured: np.ndarray, predicted: np.ndarray, speed0: np.ndarray | None = None, modes: np.ndarray = MODES, first: np.ndarray = FIRST) -> dict[str, np.ndarray]:
    """Interacting multiple models over arrays [time, track, ...]; predicted steps keep to the last model alone."""
    names = ("calc", "calk", "cvlk")
    steps, n = z.shape[:2]
    out = {"x": np.zeros((steps, n, 6)), "P": np.zeros((steps, n, 6, 6)), "P_calc": np.zeros((steps, n, 6, 6)), "mu": np.zeros((steps, n, 3))}
    x0, p0 = first_state(z[0], speed0)
    x, p = np.repeat(x0[:, None], 3, axis=1), np.repeat(p0[:, None], 3, axis=1)
    mu = np.broadcast_to(first, (n, 3)).copy()
    for t in range(steps):
        cbar = mu @ modes
        omega = modes.T[None] * mu[:, None, :] / np.maximum(cbar[:, :, None], 1e-300)  # [track, into, from]
        omega /= np.maximum(omega.sum(-1, keepdims=True), 1e-300)
        xm = omega @ x
        diff = x[:, None] - xm[:, :, None]  # [track, into, from, state]
        pm = np.einsum("nij,njab->niab", omega, p) + np.einsum("nij,nija,nijb->niab", omega, diff, diff)
        if t:
            q = noise_at(dt[t], z[t, :, 1], measured[t])
            for i, m in enumerate(names):
                f = transition(dt[t], m)
                xm[:, i] = (f @ xm[:, i, :, None])[..., 0]
                pm[:, i] = f @ pm[:, i] @ _T(f) + q
        x, p, ll = update(xm, pm, np.repeat(z[t][:, None], 3, axis=1), np.repeat(measured[t][:, None], 3, axis=1))
        log_mu = ll + np.log(np.maximum(cbar, 1e-300))
        new = np.exp(log_mu - log_mu.max(-1, keepdims=True))  # log-sum-exp: likelihoods may underflow
        mu = np.where(measured[t][:, None], new / new.sum(-1, keepdims=True), mu)
        mu = np.where(predicted[t][:, None], np.array([0.0, 0.0, 1.0]), mu)
        xc = (mu[..., None] * x).sum(1)
        diff = x - xc[:, None]
        out["x"][t], out["mu"][t], out["P_calc"][t] = xc, mu, p[:, 0]
        out["P"][t] = (mu[..., None, None] * (p + diff[..., :, None] * diff[..., None, :])).sum(1)
    return out


def smooth(xs: np.ndarray, ps: np.ndarray, dt: np.ndarray, model: str = "calc", length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rauch-Tung-Striebel backward pass over arrays [time, track, ...] with tracks of the given lengths.

    As in the filter, noise along s is none while a vehicle stands; the pseudo-inverse settles what is then singular.
    """
    steps, n = xs.shape[:2]
    length = np.full(n, steps) if length is None else length
    x, p = xs.copy(), ps.copy()
    for t in range(steps - 2, -1, -1):
        live = (t + 1 < length)[:, None]
        f = transition(dt[t + 1], model)
        ahead = f @ ps[t] @ _T(f) + process_noise(dt[t + 1], np.where(np.abs(xs[t, :, 1]) > STANDING, NOISE_S**0.5, 0.0))
        c = ps[t] @ _T(f) @ np.linalg.pinv(ahead, hermitian=True)
        x1 = xs[t] + (c @ (x[t + 1] - (f @ xs[t, ..., None])[..., 0])[..., None])[..., 0]
        p1 = ps[t] + c @ (p[t + 1] - ahead) @ _T(c)
        x[t], p[t] = np.where(live, x1, xs[t]), np.where(live[..., None], p1, ps[t])
    return x, p


def _batches(sizes: np.ndarray, cells: int = 200_000):
    """Tracks of similar length, so many that a padded batch has at most ``cells`` cells."""
    order = np.argsort(sizes, kind="stable")
    k = 0
    while k < len(order):
        m = k
        while m < len(order) and sizes[order[m]] <= 2 * sizes[order[k]] and sizes[order[m]] * (m - k + 1) <= max(cells, sizes[order[k]]):
            m += 1
        yield order[k : max(m, k + 1)]
        k = max(m, k + 1)


def _scatter(pdf: pd.DataFrame, key: str, order: Sequence[str]):
    """Sorted rows, and for each batch of tracks the (time, track) place of its rows."""
    pdf = pdf.sort_values([key, *order], kind="stable").reset_index(drop=True)
    codes, _ = pd.factorize(pdf[key], use_na_sentinel=False)  # a null key is a track of its own
    sizes = np.bincount(codes)
    first = np.cumsum(sizes) - sizes
    for tracks in _batches(sizes):
        rows = np.concatenate([np.arange(first[k], first[k] + sizes[k]) for k in tracks])
        v = np.repeat(np.arange(len(tracks)), sizes[tracks])
        t = rows - np.repeat(first[tracks], sizes[tracks])
        yield pdf.iloc[rows].reset_index(drop=True), t, v, sizes[tracks]


def _dense(values: np.ndarray, t: np.ndarray, v: np.ndarray, fill=0.0) -> np.ndarray:
    out = np.full((t.max() + 1, v.max() + 1, *values.shape[1:]), fill, dtype=values.dtype)
    out[t, v] = values
    return out


#: Rows of whole tracks that a call of a kernel gets at most, unless one track has more.
CALL_ROWS = 100_000


def dealt(df: DataFrame, key: str, groups: int | None = None) -> DataFrame:
    """Rows dealt out by a hash of their key."""
    return df.repartition(groups or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def by_track(df: DataFrame, key: str, order: Sequence[str], run, schema: str, groups: int | None = None, rows: int | None = None, deal: bool = True) -> DataFrame:
    """``run`` over whole tracks, as pandas frames of about ``rows`` rows; it returns a frame or an Arrow batch.

    Tracks are dealt out by a hash of their key (unless they are already, ``deal``) and sorted within partitions (which
    spills), then stream through in Arrow batches: a task holds that many rows and at most one more track, whatever the
    partition holds.
    """
    limit = rows or CALL_ROWS
    ordered = (dealt(df, key, groups) if deal else df).sortWithinPartitions(key, *order)
    at = df.columns.index(key)

    def whole(held):
        got = run(_frame(held))
        return got if isinstance(got, pa.RecordBatch) else pa.RecordBatch.from_pandas(got, schema=target, preserve_index=False)

    def stream(batches):
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            while batch.num_rows:
                # Rows up to the last change of track may go once there are enough; the rest waits for its track's end.
                own = pa.concat_arrays([held[-1].column(at).slice(held[-1].num_rows - 1), batch.column(at)]) if held else batch.column(at)
                cut = _last_change(own) - bool(held)
                if cut < 0 or (count + cut < limit and count + batch.num_rows < limit):
                    held.append(batch)
                    count += batch.num_rows
                    break
                if cut:
                    held.append(batch.slice(0, cut))
                yield whole(held)
                held, count, batch = [], 0, batch.slice(cut)
        if held:
            yield whole(held)

    target = to_arrow_schema(StructType.fromDDL(schema))
    return ordered.mapInArrow(stream, schema)


def _frame(batches: list[pa.RecordBatch]) -> pd.DataFrame:
    return pa.Table.from_batches(batches).to_pandas(integer_object_nulls=True)  # ids stay whole numbers


def _last_change(keys: pa.Array) -> int:
    """Index of the last value that differs from the one before it; -1 if there is none."""
    code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    change = np.flatnonzero(code[1:] != code[:-1])
    return int(change[-1]) + 1 if len(change) else -1


_KEYED = "{key} {kind}, time_ind long, " + ", ".join(f"{c} double" for c in STATE)


def _kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def estimates(pdf: pd.DataFrame, key: str, order: Sequence[str], measurement: str | Sequence[str] = "measurement", dt: str = "time_diff", predicted: str = "predicted", missing: str = "missing", model: str = "imm") -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
    """Rows of whole tracks with time_ind, and what the filter says of each row: x, P, P_calc, mu.

    ``measurement`` is a column of arrays or four columns.  Rows come by batches of tracks.
    """
    frames, parts = [], []
    for rows, t, v, _ in _scatter(pdf, key, order):
        z = np.stack(rows[measurement].to_numpy()).astype(float) if isinstance(measurement, str) else rows[list(measurement)].to_numpy(float)
        z = _dense(z, t, v)
        step = _dense(rows[dt].fillna(0).to_numpy(float), t, v)
        pred = _dense(rows[predicted].to_numpy(bool), t, v, False)
        seen = _dense(~(rows[missing].to_numpy(bool) | rows[predicted].to_numpy(bool)), t, v, False)
        if model == "imm":
            got = imm(z, step, seen, pred)
        else:
            x, p = kalman(z, step, seen, model)
            got = {"x": x, "P": p, "P_calc": p, "mu": np.repeat(np.array([[[float(m == model) for m in ("calc", "calk", "cvlk")]]]), len(x), 0).repeat(x.shape[1], 1)}
        frames.append(rows.assign(time_ind=t))
        parts.append({k: g[t, v].reshape(len(t), -1) for k, g in got.items()})
    return pd.concat(frames, ignore_index=True), {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def filtered(df: DataFrame, key: str, order: Sequence[str], measurement: str = "measurement", dt: str = "time_diff", predicted: str = "predicted", missing: str = "missing", model: str = "imm", groups: int | None = None) -> DataFrame:
    """Filter every track: key, time_ind, state, P, P_calc (36 numbers each) and mode weights.

    ``model`` is 'imm' or one of 'calc', 'calk', 'cvlk'.  Rows marked missing or predicted are not measured.
    """
    schema = _KEYED.format(key=key, kind=_kind(df, key)) + ", P array<double>, P_calc array<double>, mu_calc double, mu_calk double, mu_cvlk double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, got = estimates(pdf, key, order, measurement, dt, predicted, missing, model)
        out = pd.DataFrame({key: rows[key].to_numpy(), "time_ind": rows["time_ind"].to_numpy(), **{c: got["x"][:, k] for k, c in enumerate(STATE)}})
        out["P"], out["P_calc"] = list(got["P"]), list(got["P_calc"])
        for k, c in enumerate(("mu_calc", "mu_calk", "mu_cvlk")):
            out[c] = got["mu"][:, k]
        return out

    return by_track(df.select(key, *order, measurement, dt, predicted, missing), key, order, run, schema, groups)


def smoothed_rows(pdf: pd.DataFrame, x: np.ndarray, p: np.ndarray, key: str, order: Sequence[str], dt: str = "time_diff", model: str = "calc") -> tuple[pd.DataFrame, np.ndarray]:
    """Rows of whole tracks with time_ind, and their smoothed states; ``x`` and ``p`` are the filtered ones of ``pdf``'s rows.

    Rows come by batches of tracks; __row says which of ``pdf``'s each is.
    """
    frames, parts = [], []
    for rows, t, v, sizes in _scatter(pdf.assign(__row=np.arange(len(pdf))), key, order):
        at = rows["__row"].to_numpy()
        ps = _dense(p[at], t, v)
        pad = np.ones(ps.shape[:2], bool)
        pad[t, v] = False
        ps[pad] = np.eye(6)
        xs, _ = smooth(_dense(x[at], t, v), ps, _dense(rows[dt].fillna(0).to_numpy(float), t, v), model, sizes)
        frames.append(rows.assign(time_ind=t))
        parts.append(xs[t, v])
    return pd.concat(frames, ignore_index=True), np.concatenate(parts)


def smoothed(df: DataFrame, key: str, order: Sequence[str], state: Sequence[str] = tuple(STATE), covariance: str = "P", dt: str = "time_diff", model: str = "calc", suffix: str = "_smooth", groups: int | None = None) -> DataFrame:
    """Backward smoothing of filtered tracks: key, time_ind and the smoothed state."""
    schema = f"{key} {_kind(df, key)}, time_ind long, " + ", ".join(f"{c}{suffix} double" for c in STATE)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.stack(pdf[covariance].to_numpy()).astype(float).reshape(-1, 6, 6)
        rows, xs = smoothed_rows(pdf, pdf[list(state)].to_numpy(float), p, key, order, dt, model)
        return pd.DataFrame({key: rows[key].to_numpy(), "time_ind": rows["time_ind"].to_numpy(), **{f"{c}{suffix}": xs[:, k] for k, c in enumerate(STATE)}})

    return by_track(df.select(key, *order, *state, covariance, dt), key, order, run, schema, groups)
