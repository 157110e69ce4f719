"""Recursive filters, fusion, graphs and geometry against references that are simple to trust."""

import math
import os

import numpy as np
import pandas as pd
import pytest

from corridor.functions import geodesy
from corridor.operators import assoc, fusion, geo, kalman, probe
from corridor.plans import numeric_queries, pipeline, synthetic


def track(n=60, speed=20.0, seed=0, noise=0.3):
    rng = np.random.default_rng(seed)
    s = speed * 0.1 * np.arange(n)
    z = np.stack([s, np.full(n, speed), np.zeros(n), np.zeros(n)], axis=1)
    return s, z + rng.normal(0, noise, z.shape)


def one_by_one(z, dt, measured, model):
    """Textbook filter of a single track."""
    x, p = z[0] @ kalman.H, np.eye(6)
    out = []
    for t in range(len(z)):
        if t:
            f = kalman.transition(np.array(dt[t]), model)
            q = kalman.process_noise(np.array(dt[t]), 2**0.5 if measured[t] and abs(z[t, 1]) > 0.2 else 0.0)
            x, p = f @ x, f @ p @ f.T + q
        if measured[t]:
            s = kalman.H @ p @ kalman.H.T + kalman.R_FILTER
            k = p @ kalman.H.T @ np.linalg.inv(s)
            x, p = x + k @ (z[t] - kalman.H @ x), (np.eye(6) - k @ kalman.H) @ p
        out.append(x)
    return np.array(out)


@pytest.mark.parametrize("model", ["calc", "calk", "cvlk"])
def test_batched_filter_equals_single_tracks(model):
    zs = [track(seed=k)[1] for k in range(3)]
    z = np.stack(zs, axis=1)
    dt = np.full(z.shape[:2], 0.1)
    measured = np.ones(z.shape[:2], bool)
    measured[20:25, 1] = False
    x, _ = kalman.kalman(z, dt, measured, model)
    for k in range(3):
        np.testing.assert_allclose(x[:, k], one_by_one(z[:, k], dt[:, k], measured[:, k], model), atol=1e-8)


def test_imm_converges_and_predictions_keep_the_lane():
    s, z = track(noise=0.05)
    z = z[:, None]
    dt, ones = np.full(z.shape[:2], 0.1), np.ones(z.shape[:2], bool)
    pred = np.zeros_like(ones)
    pred[50:] = True
    got = kalman.imm(z, dt, ones & ~pred, pred)
    assert abs(got["x"][49, 0, 0] - s[49]) < 0.3 and abs(got["x"][49, 0, 1] - 20) < 0.5
    np.testing.assert_allclose(got["mu"].sum(-1), 1)
    np.testing.assert_allclose(got["mu"][55, 0], [0, 0, 1])
    assert np.allclose(got["x"][50:, 0, 3], got["x"][50, 0, 3])  # d stays
    np.testing.assert_allclose(got["P"], np.swapaxes(got["P"], -1, -2), atol=1e-9)


def test_imm_survives_underflowing_likelihoods():
    z = np.zeros((5, 1, 4))
    z[3] = 1e6
    got = kalman.imm(z, np.full((5, 1), 0.1), np.ones((5, 1), bool), np.zeros((5, 1), bool))
    assert np.isfinite(got["x"]).all() and np.allclose(got["mu"].sum(-1), 1)


def test_smoother_is_no_worse_than_the_filter():
    errors = []
    for seed in range(5):
        s, z = track(seed=seed)
        z = z[:, None]
        dt, ones = np.full(z.shape[:2], 0.1), np.ones(z.shape[:2], bool)
        x, p = kalman.kalman(z, dt, ones)
        xs, ps = kalman.smooth(x, p, dt)
        errors.append((np.abs(x[:, 0, 0] - s).mean(), np.abs(xs[:, 0, 0] - s).mean()))
        assert np.trace(ps[30, 0]) <= np.trace(p[30, 0]) + 1e-9
    assert np.mean([b for _, b in errors]) < np.mean([a for a, _ in errors])


@pytest.mark.parametrize("rule", ["fast", "plain"])
def test_fusion_of_equal_estimates_keeps_the_state(rule):
    x, p = np.arange(6.0)[None], np.eye(6)[None] * 2
    xf, pf = fusion.intersect(x, p, x.copy(), p.copy(), rule)
    np.testing.assert_allclose(xf, x, atol=1e-9)
    np.testing.assert_allclose(pf, p, atol=1e-9)


def test_gates_are_chi_square_quantiles():
    assert assoc.GATES[0.95] == pytest.approx(9.487729, abs=1e-5)
    assert assoc.GATES[0.999] == pytest.approx(18.466827, abs=1e-5)


def test_distance_of_equal_states_is_the_log_determinant():
    z = np.zeros((1, 3, 4))
    p = np.eye(6)[None]
    d = assoc.distances(z, z, p)
    s = kalman.H @ np.eye(6) @ kalman.H.T + assoc.R_ASSOC
    assert d[0] == pytest.approx(np.log(np.linalg.det(s)))
    assert assoc.distances(z, z, p, maha=True)[0] == 0


@pytest.mark.parametrize("few", [0, 30, 500_000])
def test_components_equal_union_find(spark, monkeypatch, few):
    """By rounds to the end, by rounds until few edges are left, and at once."""
    monkeypatch.setattr(assoc, "FEW", few)
    rng = np.random.default_rng(3)
    e = rng.integers(0, 80, (60, 2)).tolist() + [[5, 5], [1, 2], [2, 1]]
    got = {r.id: r.component for r in assoc.connected_components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert assoc.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    named = spark.createDataFrame([("x", "y"), ("y", "b"), ("q", None), ("p", "p")], "a string, b string")
    assert {r.id: r.component for r in assoc.connected_components(named, "a", "b").collect()} == {"x": "b", "y": "b", "b": "b"}


def test_pruning_cuts_the_bad_bridge():
    edges = {(1, 2): 1.0, (2, 3): 2.0, (3, 4): 1.0}
    weights = {(1, 2): 1.0, (2, 3): 90.0, (3, 4): 1.0, (1, 3): 90.0, (2, 4): 90.0, (1, 4): 90.0}
    assert assoc.prune([1, 2, 3, 4], edges, weights, 18.0) == [(1, 2), (3, 4)]
    assert assoc.prune([1, 2], {(1, 2): 1.0}, {(1, 2): None}, 18.0) == [(1, 2)]  # unknown counts as just below
    assert assoc.prune([1, 2, 3], {(1, 2): 1.0, (2, 3): 1.0}, {(1, 2): 1.0, (2, 3): 1.0}, 18.0) == [(1, 2), (2, 3)]
    # one bad pair within a component whose mean is good
    assert assoc.prune([1, 2, 3], {(1, 2): 1.0, (2, 3): 1.0}, {(1, 2): 1.0, (2, 3): 1.0, (1, 3): 40.0}, 18.0) == [(2, 3)]


def parts_of(nodes, edges):
    """Component number of each node, by painting."""
    colour = {}
    for n in nodes:
        todo = [] if n in colour else [n]
        while todo:
            x = todo.pop()
            colour[x] = n
            todo += [y for e in edges for x1, y in (e, e[::-1]) if x1 == x and y not in colour]
    return colour


def pruned_by_trying(nodes, edges, weights, cutoff, removals):
    """The rule as it reads, every candidate tried on its own."""

    def scores(kept):
        c = parts_of(nodes, kept)
        return [w or cutoff - 0.001 for (a, b), w in weights.items() if c[a] == c[b]]

    kept, gone = set(edges), []
    while len(gone) < removals and any(w >= cutoff for w in scores(kept)):
        tried = []
        for e in kept:
            got = scores(kept - {e})
            tried.append((sum(got) / (len(got) or 1), e))
        gone.append(min(tried)[1])
        kept.remove(gone[-1])
    for e in gone:
        if all(w < cutoff for w in scores(kept | {e})):
            kept.add(e)
    return sorted(kept)


@pytest.mark.parametrize("seed", range(40))
def test_pruning_equals_trying_every_edge(seed):
    rng = np.random.default_rng(seed)
    nodes = list(range(int(rng.integers(2, 9))))
    pairs = [(a, b) for a in nodes for b in nodes if a < b]
    edges = {p: float(rng.integers(0, 30)) for p in pairs if rng.random() < 0.4}
    weights = {p: None if rng.random() < 0.1 else float(rng.integers(0, 30)) for p in pairs if p in edges or rng.random() < 0.6}
    for removals in (1, 3, 20):
        assert assoc.prune(nodes, edges, weights, 18.5, removals) == pruned_by_trying(nodes, edges, weights, 18.5, removals)


def vehicle(rng, steps, tracks):
    """Random states, covariances and presence of up to ``tracks`` contributors, the first always there."""
    z = rng.normal(0, 1, (steps, tracks, 6))
    z[..., 0] += 2.0 * np.arange(steps)[:, None]
    a = rng.normal(0, 1, (steps, tracks, 6, 6))
    p = a @ np.swapaxes(a, -1, -2) + np.eye(6)
    there = rng.random((steps, tracks)) < 0.7
    there[:, 0] = True
    return z, p, there


def fused_alone(z, p, there, dt, rule):
    """One vehicle, step by step, as the formulas read."""
    r = np.zeros((6, 6))
    for k, v in ((0, 0.5), (1, 0.8112), (3, 0.1), (4, 0.1)):
        r[k, k] = v
    p = [[q + r for q in row] for row in p] if rule == "fast" else p
    x, c = z[0][0], p[0][0]
    out = [(x, c)]
    for t in range(1, len(z)):
        f = kalman.transition(np.array(dt), "calc")
        x, c = f @ x, f @ c @ f.T
        if rule == "information":
            info, vec = np.linalg.inv(c), np.linalg.inv(c) @ x
            for k in range(z.shape[1]):
                if there[t, k] and there[t - 1, k]:
                    new, old = np.linalg.inv(p[t][k]), np.linalg.inv(f @ p[t - 1][k] @ f.T)
                    info, vec = info + new - old, vec + new @ z[t, k] - old @ f @ z[t - 1, k]
            c = np.linalg.inv(info)
            x = c @ vec
        else:
            c = c + kalman.process_noise(np.array(dt), 2**0.5)
            order = range(z.shape[1]) if rule == "fast" else reversed(range(z.shape[1]))
            for k in order:
                if not there[t, k]:
                    continue
                i, j, det = np.linalg.inv(c), np.linalg.inv(p[t][k]), np.linalg.det
                w = (det(i + j) - det(j) + det(i)) / (2 * det(i + j)) if rule == "fast" else det(p[t][k]) / (det(c) + det(p[t][k]))
                c = np.linalg.inv(w * i + (1 - w) * j)
                x = c @ (w * i @ x + (1 - w) * j @ z[t, k])
        out.append((x, c))
    return np.array([x for x, _ in out]), np.array([c for _, c in out])


@pytest.mark.parametrize("rule", ["fast", "plain", "information"])
def test_fusion_equals_one_vehicle_at_a_time(rule):
    rng = np.random.default_rng(11)
    got = [vehicle(rng, 7, 3) for _ in range(5)]
    if rule == "information":  # each step knows more than the prediction from the step before, as filters' covariances do
        got = [(z, np.stack([p[0] / (t + 1) ** 2 for t in range(7)]), there) for z, p, there in got]
    z, p, there = (np.stack([g[k] for g in got], axis=1) for k in range(3))
    dt = np.full(z.shape[:2], 0.1)
    x, c = fusion.fuse(z, p, there, dt, rule)
    for v, (z1, p1, there1) in enumerate(got):
        want_x, want_c = fused_alone(z1, p1, there1, 0.1, rule)
        np.testing.assert_allclose(x[:, v], want_x, rtol=1e-8, atol=1e-8)
        np.testing.assert_allclose(c[:, v], want_c, rtol=1e-8, atol=1e-8)


def test_fusion_starts_with_the_first_estimate():
    z, p = np.ones((1, 1, 1, 6)), 2 * np.eye(6)[None, None, None]
    for rule, want in (("fast", 2 * np.eye(6) + fusion.R_WIDEN), ("plain", 2 * np.eye(6)), ("information", 2 * np.eye(6))):
        x, c = fusion.fuse(z, p, np.ones((1, 1, 1), bool), np.zeros((1, 1)), rule)
        np.testing.assert_array_equal(x[0, 0], np.ones(6))
        np.testing.assert_allclose(c[0, 0], want)


def test_information_of_a_track_that_changes_its_place():
    rng = np.random.default_rng(5)
    z, p, there = vehicle(rng, 4, 2)
    p = np.stack([p[0] / (t + 1) ** 2 for t in range(4)])
    there[:] = True
    who = np.tile(np.arange(2), (4, 1))
    swapped = [k[:, None] for k in (z, p, there, who)]
    for k in swapped:
        k[2] = k[2][:, ::-1]
    x, _ = fusion.fuse(*swapped[:3], np.full((4, 1), 0.1), "information", swapped[3])
    np.testing.assert_allclose(x[:, 0], fused_alone(*[a.copy() for a in vehicle_unswapped(z, p, there)], 0.1, "information")[0], atol=1e-8)


def vehicle_unswapped(*arrays):
    out = [a.copy() for a in arrays]
    for a in out:
        a[2] = a[2][::-1]
    return out


def imm_alone(z, dt, measured, predicted):
    """Interacting models of one track in plain loops, with likelihoods as such."""
    names, m, mu = ("calc", "calk", "cvlk"), np.full((3, 3), 0.1) + 0.7 * np.eye(3), np.array([0.1, 0.1, 0.8])
    x, p = [z[0] @ kalman.H] * 3, [np.eye(6)] * 3
    out = []
    for t in range(len(z)):
        c = [sum(mu[k] * m[k, i] for k in range(3)) for i in range(3)]
        w = np.array([[m[j, i] * mu[j] / c[i] for j in range(3)] for i in range(3)])
        xm = [sum(w[i, j] * x[j] for j in range(3)) for i in range(3)]
        pm = [sum(w[i, j] * (p[j] + np.outer(x[j] - xm[i], x[j] - xm[i])) for j in range(3)) for i in range(3)]
        like = np.ones(3)
        for i, name in enumerate(names):
            if t:
                f = kalman.transition(np.array(dt[t]), name)
                noise = 2**0.5 if measured[t] and abs(z[t, 1]) > 0.2 else 0.0
                xm[i], pm[i] = f @ xm[i], f @ pm[i] @ f.T + kalman.process_noise(np.array(dt[t]), noise)
            if measured[t]:
                y, s = z[t] - kalman.H @ xm[i], kalman.H @ pm[i] @ kalman.H.T + kalman.R_FILTER
                like[i] = np.exp(-0.5 * y @ np.linalg.inv(s) @ y) / np.sqrt((2 * np.pi) ** 4 * np.linalg.det(s))
                gain = pm[i] @ kalman.H.T @ np.linalg.inv(s)
                xm[i], pm[i] = xm[i] + gain @ y, (np.eye(6) - gain @ kalman.H) @ pm[i]
        x, p = xm, pm
        if measured[t]:
            mu = like * c / (like @ c)
        if predicted[t]:
            mu = np.array([0.0, 0.0, 1.0])
        mean = sum(mu[i] * x[i] for i in range(3))
        out.append((mean, sum(mu[i] * (p[i] + np.outer(x[i] - mean, x[i] - mean)) for i in range(3)), mu))
    return [np.array([o[k] for o in out]) for k in range(3)]


def test_imm_equals_one_track_in_loops():
    rng = np.random.default_rng(2)
    zs = [track(n=40, seed=k)[1] for k in range(4)]
    zs[1][10:, 1] = 0.05  # stands
    measured, predicted = rng.random((40, 4)) < 0.85, np.zeros((40, 4), bool)
    predicted[35:] = True
    measured[35:] = False
    measured[0] = True
    dt = np.full((40, 4), 0.1)
    got = kalman.imm(np.stack(zs, axis=1), dt, measured, predicted)
    for k in range(4):
        x, p, mu = imm_alone(zs[k], dt[:, k], measured[:, k], predicted[:, k])
        np.testing.assert_allclose(got["x"][:, k], x, atol=1e-7)
        np.testing.assert_allclose(got["P"][:, k], p, atol=1e-7)
        np.testing.assert_allclose(got["mu"][:, k], mu, atol=1e-7)


def smoothed_alone(x, p, dt):
    x, p = x.copy(), p.copy()
    for t in range(len(x) - 2, -1, -1):
        f = kalman.transition(np.array(dt[t + 1]), "calc")
        ahead = f @ p[t] @ f.T + kalman.process_noise(np.array(dt[t + 1]), 2**0.5 if abs(x[t, 1]) > 0.2 else 0.0)
        gain = p[t] @ f.T @ np.linalg.pinv(ahead)
        x[t], p[t] = x[t] + gain @ (x[t + 1] - f @ x[t]), p[t] + gain @ (p[t + 1] - ahead) @ gain.T
    return x, p


def test_smoother_equals_one_track_at_a_time():
    sizes = np.array([30, 18, 30])
    z = np.zeros((30, 3, 4))
    for k, n in enumerate(sizes):
        z[:n, k] = track(n=n, seed=k)[1]
    z[8:16, 2, 1] = 0.0  # stands for a while
    dt = np.full((30, 3), 0.1)
    x, p = kalman.kalman(z, dt, np.ones((30, 3), bool))
    xs, ps = kalman.smooth(x, p, dt, length=sizes)
    for k, n in enumerate(sizes):
        want = smoothed_alone(x[:n, k], p[:n, k], dt[:n, k])
        np.testing.assert_allclose(xs[:n, k], want[0], atol=1e-7)
        np.testing.assert_allclose(ps[:n, k], want[1], atol=1e-7)


@pytest.mark.parametrize("dims", [2, 4])
def test_distances_equal_one_pair_at_a_time(dims):
    rng = np.random.default_rng(8)
    a = rng.normal(0, 1, (6, 6, 6))
    p = a @ np.swapaxes(a, -1, -2) + np.eye(6)
    zf, zl = rng.normal(0, 2, (2, 6, 3, dims))
    keep = [0, 2] if dims == 2 else [0, 1, 2, 3]
    h, r = kalman.H[keep], np.diag([5 / 3, 1.0, 1.5, 1.0])[np.ix_(keep, keep)]
    for k in range(6):
        s = h @ p[k] @ h.T + r
        maha = [float(e @ np.linalg.inv(s) @ e) for e in zf[k] - zl[k]]
        log = np.log(np.linalg.det(s))
        assert assoc.distances(zf, zl, p, True, dims)[k] == pytest.approx(min(maha))
        assert assoc.distances(zf, zl, p, False, dims)[k] == pytest.approx(min(maha) + log)
        want = max(-0.5 * (dims * np.log(2 * np.pi) + log + m) for m in maha)
        assert assoc.likelihoods(zf, zl, p)[k] == pytest.approx(want)


def test_distances_over_places(spark):
    rng = np.random.default_rng(4)
    cols = ["s", "front_s", "back_s", "s_velocity", "d", "d_velocity"]
    rows, want = [], []
    for k in range(20):
        f, lead = (dict(zip(cols, rng.normal(0, 2, 6).tolist(), strict=True)) for _ in range(2))
        a, b = rng.normal(0, 1, (2, 6, 6))
        p, q = a @ a.T + np.eye(6), b @ b.T + np.eye(6)
        rows.append((k, *f.values(), p.ravel().tolist(), *lead.values(), q.ravel().tolist()))

        def far(x, y, cov, log=True):
            s = kalman.H @ cov @ kalman.H.T + assoc.R_ASSOC
            e = np.array([f[x] - lead[y], *[f[c] - lead[c] for c in cols[3:]]])
            return e @ np.linalg.inv(s) @ e + (np.log(np.linalg.det(s)) if log else 0)

        spots = cols[:3]
        want.append((min(far(x, x, p + q) for x in spots), min(far(x, x, p + q, False) for x in spots), min(far(x, y, p + q) for x in spots for y in spots if x != y), max(-0.5 * (4 * np.log(2 * np.pi) + far(x, x, q)) for x in spots)))
    schema = "k long, " + ", ".join(f"{c} double" for c in cols) + ", P array<double>, " + ", ".join(f"{c}_leader double" for c in cols) + ", P_leader array<double>"
    df = assoc.association_distance(spark.createDataFrame(rows, schema))
    df = assoc.association_distance(assoc.association_distance(df, "maha", maha=True), "permuted", permute=True)
    got = assoc.loglikelihood(df).orderBy("k").select("association_distance", "maha", "permuted", "loglikelihood").toPandas()
    np.testing.assert_allclose(got.to_numpy(), np.array(want))


def test_utm_round_trip_and_known_point():
    lon, lat = np.array([-87.6, -86.1, 9.0]), np.array([36.1, 35.9, 48.0])
    x, y = geodesy.to_utm(lon, lat, 16)
    back = geodesy.from_utm(x, y, 16)
    np.testing.assert_allclose(back[0][:2], lon[:2], atol=1e-9)
    np.testing.assert_allclose(back[1][:2], lat[:2], atol=1e-9)
    x, y = geodesy.to_utm(-87.0, 0.0, 16)  # central meridian at the equator
    assert (float(x), float(y)) == (pytest.approx(500_000), pytest.approx(0))


def test_frenet_round_trip(spark):
    t = np.linspace(0, 2 * np.pi * 0.9, 80)  # headings pass through plus and minus pi
    lanes = geo.network(spark, {"ring": np.stack([200 * np.cos(t), 200 * np.sin(t)], axis=1)}, 0.2)
    rows = [(i, "ring", 5.0 + 10.3 * i, (i % 7 - 3) * 0.5) for i in range(100)] + [(200, "ring", -4.0, 0.0), (201, "none", 5.0, 0.0), (202, None, None, None)]
    p = spark.createDataFrame(rows, "id int, lane string, s0 double, d0 double")
    xy = geo.frenet_to_xy(p, lanes, "s0", "d0", step=0.2)
    bad = {r.id: r.x for r in xy.where("id >= 200").collect()}
    assert bad == {200: None, 201: None, 202: None}
    back = geo.map_to_lane(xy.where("id < 100").drop("lane"), lanes, ["id"], "x", "y").toPandas()
    assert (back.s - back.s0).abs().max() < 0.45 and (back.d - back.d0).abs().max() < 0.15


def test_points_off_the_network_have_no_lane(spark):
    lanes = geo.network(spark, {"a": np.array([[0.0, 0.0], [100.0, 0.0]])}, 1.0)
    p = spark.createDataFrame([(1, 50.0, 2.0), (2, 50.0, 90.0), (3, None, None), (4, 50.0, -2.0)], "id int, x double, y double")
    got = {r.id: (r.lane, r.d) for r in geo.map_to_lane(p, lanes, ["id"], "x", "y").collect()}
    assert got[2] == (None, None) and got[3] == (None, None)
    assert got[1][0] == "a" and got[1][1] == pytest.approx(2.0) and got[4][1] == pytest.approx(-2.0)


def test_low_pass_keeps_slow_and_removes_fast():
    t = np.arange(600) / 10
    sections = probe.butterworth()
    slow, fast = np.sin(2 * np.pi * 0.02 * t), np.sin(2 * np.pi * 2.0 * t)
    y = probe.zero_phase(slow + fast, sections)
    assert np.abs(y - slow)[150:-150].max() < 0.01  # away from the reflected ends
    short = np.arange(10.0)
    assert probe.zero_phase(short, sections) is short
    sizes = np.array([600, 5, 100, 600, 100])
    x = np.random.default_rng(1).normal(0, 1, sizes.sum())
    apart = np.split(x, np.cumsum(sizes)[:-1])
    np.testing.assert_array_equal(probe.zero_phases(x, sizes, sections), np.concatenate([probe.zero_phase(v, sections) for v in apart]))


def test_corridor_finds_the_planted_vehicles(spark):
    lanes = geo.network(spark, synthetic.LANES, 1.0)
    out = pipeline.run(synthetic.corridor(spark, vehicles=6), lanes=lanes)
    pdf = out.select("vehicle_id", "n_tracks", "s_velocity_smooth", "centroid_x", "d_smooth").toPandas()
    assert pdf.vehicle_id.nunique() == 6
    assert (pdf.n_tracks.groupby(pdf.vehicle_id).max() == 2).all()  # both sensors contribute
    speed = pdf.s_velocity_smooth.groupby(pdf.vehicle_id).median().round().tolist()
    assert sorted(speed) == [18, 18, 19, 19, 20, 20]
    assert pdf.d_smooth.abs().max() < 1.0


@pytest.mark.parametrize("rows_a_call", [1, 16, 40, 1000])
def test_calls_get_whole_tracks_of_bounded_size(spark, rows_a_call):
    """Many tracks in one partition and small Arrow batches: a call holds no more than its bound or one track."""
    sizes = {k: 1 + k * 7 % 23 for k in range(60)}
    df = spark.createDataFrame([(k if k else None, i) for k, n in sizes.items() for i in range(n)], "k long, i long")

    def run(pdf):
        assert pdf["i"].iloc[0] == 0
        size = pdf.groupby("k", dropna=False)["i"].transform("size")
        assert (pdf.groupby("k", dropna=False)["i"].transform("max") + 1 == size).all()  # whole tracks
        return pd.DataFrame({"k": pdf["k"], "i": pdf["i"], "n": len(pdf)})

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = kalman.by_track(df, "k", ["i"], run, "k long, i long, n long", groups=1, rows=rows_a_call).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == sum(sizes.values())
    assert got.n.max() < rows_a_call + 10 + 23


def test_filter_over_spark_groups(spark):
    rows = []
    for k in range(4):
        _, z = track(n=15 + 10 * k, seed=k)
        rows += [(k, i, [float(v) for v in z[i]], 0.1 if i else 0.0, False, False) for i in range(len(z))]
    df = spark.createDataFrame(rows, "k long, i long, measurement array<double>, time_diff double, predicted boolean, missing boolean")
    got = kalman.filtered(df, "k", ["i"], model="calc", groups=2).toPandas().sort_values(["k", "time_ind"])
    for k in range(4):
        _, z = track(n=15 + 10 * k, seed=k)
        want = one_by_one(z, np.full(len(z), 0.1), np.ones(len(z), bool), "calc")
        np.testing.assert_allclose(got[got.k == k][kalman.STATE].to_numpy(), want, atol=1e-8)
    assert isinstance(got, pd.DataFrame)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are absent")
def test_pruned_components_cover_all_lines(spark):
    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_discount").collect()
    assert max(x.l_linenumber for x in lines) < 8
    values = {}
    for x in lines:
        values.setdefault(x.l_orderkey * 8 + x.l_linenumber, []).append(round(x.l_discount * 200))
    w = {k: math.floor(sum(v) / len(v) + 0.5) for k, v in values.items()}
    want, pruned = set(), 0
    for first in sorted(w):
        if first - 1 in w:
            continue
        nodes = [first]
        while nodes[-1] + 1 in w:
            nodes.append(nodes[-1] + 1)
        pairs = {(a, b): (w[a] + w[b]) / 2 for a in nodes for b in nodes if a < b}
        edges = {k: v for k, v in pairs.items() if k[1] == k[0] + 1}
        kept = assoc.prune(nodes, edges, pairs, 12.0) if edges else []
        pruned += len(nodes) > 2 and 0 < len(kept) < len(edges)
        want |= {(first, a, b, edges[a, b]) for a, b in kept}
    got = numeric_queries.QUERIES["graph_prune"](spark, d).collect()
    assert {(x.component, x.lo, x.hi, x.weight) for x in got} == want and len(got) == len(want)
    assert pruned > 10


def test_utm_columns_equal_the_arrays(spark):
    lon, lat = np.array([-87.6, -86.1, -89.9, -87.0]), np.array([36.1, -35.9, 80.0, 0.0])
    p = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lon, lat, strict=True))] + [(9, None, 1.0)], "k int, lon0 double, lat0 double")
    out = geo.with_lonlat(geo.with_utm(p, "lon0", "lat0", 16), "x", "y", 16).orderBy("k").collect()
    x, y = geodesy.to_utm(lon, lat, 16)
    np.testing.assert_allclose([(r.x, r.y, r.lon, r.lat) for r in out[:4]], np.stack([x, y, lon, lat], axis=1), rtol=1e-12, atol=1e-6)
    assert (out[4].x, out[4].y, out[4].lon, out[4].lat) == (None, None, None, None)


def test_probe_rows_on_their_lane(spark):
    lanes = {"E1": np.array([[0.0, 0.0], [1000.0, 0.0]]), "E2": np.array([[0.0, 3.6], [1000.0, 3.6]])}
    full = geo.network(spark, lanes, 1.0)
    main = full.where("lane = 'E1'")
    rows = [(1, 500.25, 0.5, 10.0, 0.1), (2, 600.0, 3.0, 20.0, 0.0), (3, 100.0, 0.0, 5.0, 0.0), (4, 500.0, 40.0, 5.0, 0.0)]
    got = {r.id: r for r in probe.snapped(spark.createDataFrame(rows, "id int, x double, y double, speed double, heading double"), main, full, ["id"], 1.0).collect()}
    assert set(got) == {1, 2}  # the others lie near an end or off the lanes
    r = got[1]
    assert r.lane == "E1" and r.s == 501 and r.d == pytest.approx(0.5, abs=0.1) and r.lane_index == 0 and got[2].lane_index == 1
    assert (r.s_velocity, r.d_velocity) == (pytest.approx(10 * math.cos(0.1)), pytest.approx(10 * math.sin(0.1)))
    assert (r.front_s, r.back_s) == (pytest.approx(501 + 2.91 * math.cos(0.1)), pytest.approx(501 - 1.99 * math.cos(0.1))) and r.length_s == pytest.approx(4.9 * math.cos(0.1))


def test_command_line_finds_the_planted_vehicles(spark, tmp_path):
    """Raw rows, a calibration and lanes as files; trajectories out."""
    import json

    from pyspark.sql import functions as F

    east, north = 500_000.0, 4_000_000.0
    place = lambda x, y: [float(v) for v in geodesy.from_utm(np.array(east + x), np.array(north + y), 16)]
    tracks = synthetic.corridor(spark, vehicles=4)
    tracks.select(
        F.pmod("object_id", F.lit(1 << 31)).alias("ui32_objectID"), "ip", "epoch_time", F.col("s").alias("f32_positionX_m"), F.col("d").alias("f32_positionY_m"), F.lit(1.0).alias("f32_directionX"),
        F.lit(0.0).alias("f32_directionY"), "f32_velocityInDir_mps", F.lit(0).alias("ui16_predictionCount"), "f32_distanceToFront_m", "f32_distanceToBack_m", "f32_length_m",
    ).write.parquet(str(tmp_path / "raw"))
    lon, lat = place(0, 0)
    (tmp_path / "sensors.yaml").write_text("".join(f"{ip}:\n  angle: 0.0\n  origin: [{lat!r}, {lon!r}]\n" for ip in "ab"))
    features = [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": "LineString", "coordinates": [place(*p) for p in xy]}} for n, xy in synthetic.LANES.items()]
    (tmp_path / "lanes.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    pipeline.main([str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "sensors.yaml"), str(tmp_path / "lanes.json"), "--cache-dir", str(tmp_path / "cache")])
    got = spark.read.parquet(str(tmp_path / "out"))
    assert not [f for f in got.schema if f.dataType.simpleString() == "double"]
    pdf = got.select("vehicle_id", "n_tracks", "s_velocity_smooth", "centroid_x").toPandas()
    assert pdf.vehicle_id.nunique() == 4 and (pdf.n_tracks.groupby(pdf.vehicle_id).max() == 2).all()
    assert sorted(pdf.s_velocity_smooth.groupby(pdf.vehicle_id).median().round()) == [18, 18, 19, 20]
    assert pdf.centroid_x.dropna().between(east, east + 600).all()
    assert len(list((tmp_path / "cache").iterdir())) == 5  # a stage each


def test_candidates_do_not_multiply_points(spark):
    """Losses of calibration against brute force over all lane points; the plan has no rows for each candidate."""
    from corridor.operators import geo, probe

    rng = np.random.default_rng(3)
    bend = {"a": np.array([[0.0, 0.0], [60.0, 0.0], [90.0, 40.0]]), "b": np.array([[60.0, 4.0], [0.0, 4.0]])}
    lanes = geo.network(spark, bend, 1.0)
    p = np.round(np.column_stack([rng.uniform(-5, 95, 300), rng.uniform(-6, 45, 300), rng.uniform(-4, 4, 300)]), 1)
    p = np.concatenate([p, p[:50]])
    df = spark.createDataFrame([(i, "uv"[i % 2], *map(float, v)) for i, v in enumerate(p)], "i int, ip string, x double, y double, h double")
    grid, table = [(0.0, 0.0, 0.0), (0.05, 0.5, -1.0)], lanes.toPandas()
    got = {(r["ip"], r["k"]): r["loss"] for r in probe.losses(df, lambda _: grid, lanes, "ip", "x", "y", "h", 10.0, 5.0).collect()}
    for which, name in enumerate("uv"):
        for k, (a, dx, dy) in enumerate(grid):
            x, y, h = p[which::2].T
            cx, cy = x * np.cos(a) - y * np.sin(a) + dx, x * np.sin(a) + y * np.cos(a) + dy
            d = np.hypot(cx[:, None] - table["x_lane"].to_numpy(), cy[:, None] - table["y_lane"].to_numpy())
            off = h[:, None] + a - table["angle"].to_numpy()
            d[(np.abs(np.arctan2(np.sin(off), np.cos(off))) > np.radians(10)) | (d > 5)] = np.inf
            least = d.min(axis=1)
            assert 0 < np.isfinite(least).sum() < len(least)
            assert got[name, k] == pytest.approx(np.isinf(least).mean() + least[np.isfinite(least)].mean(), abs=1e-9)
    plan = probe.calibrate(df, lanes, "ip", ["i"], "x", "y", "h", [0.0, 0.1], [(0.0, 0.0)])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_solution_reads_its_points_once_and_rounds_have_no_joins(spark, monkeypatch):
    from corridor.operators import geo, probe

    lanes = geo.network(spark, {"a": np.array([[0.0, 0.0], [60.0, 0.0]])}, 1.0)
    df = spark.createDataFrame([(i, "u", float(i), -0.75, 0.0) for i in range(5, 50)], "i int, ip string, x double, y double, h double")
    plans, losses = [], probe.losses

    def seen(*a):
        out = losses(*a)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(probe, "losses", seen)
    got = probe.solved(df, lanes, "ip", ["i"], "x", "y", "h").first()
    assert abs(got["angle"]) < 0.01 and got["loss"] < 0.3
    assert len(plans) == 7 and not any("Join" in p or "Generate" in p for p in plans)


@pytest.mark.parametrize("seed", range(4))
def test_components_pruned_together_equal_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    edges, weights, want = [], [], set()
    for c in range(60):
        nodes = sorted(rng.choice(40, size=int(rng.integers(2, 6 + seed)), replace=False).tolist())
        pairs = [(f"t{100 * c + a:05}", f"t{100 * c + b:05}") for a in nodes for b in nodes if a < b]
        e = {p: float(rng.integers(0, 30)) for p in pairs if rng.random() < 0.7}
        w = {p: None if rng.random() < 0.1 else float(rng.integers(0, 30)) for p in pairs if rng.random() < 0.8} if c % 5 else {}
        edges += [(c, *p, x) for p, x in e.items()]
        weights += [(c, *p, x) for p, x in w.items()]
        kept = assoc.prune(sorted({n for k in [*e, *w] for n in k}), e, w or dict(e), 12.0, 6) if e or w else []
        want |= {(c, *p, e[p]) for p in kept}
    schema = "component long, lo string, hi string, weight double"
    out = assoc.pruned_edges(spark.createDataFrame(edges, schema), spark.createDataFrame(weights, schema), 12.0, 6)
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # no Python call for each component


def test_straight_lanes_need_no_squares():
    from corridor.operators import probe

    rng = np.random.default_rng(2)
    x = np.concatenate([np.arange(-20.0, 521.0), np.linspace(520, 300, 221), 520 + np.cumsum(rng.uniform(0.5, 1, 40))])
    y = np.concatenate([np.full(541, 50.0), np.full(221, 53.0), 50 + np.cumsum(rng.uniform(0, 1, 40))])
    angle = np.concatenate([np.zeros(541), np.full(221, np.pi), rng.uniform(0, 1, 40)])
    near = probe.Near(x, y, angle, 6.0)
    assert near.lines == [(0, 541), (541, 762)] and near.points.min() >= 762  # squares for the bend alone
    px, py, h = rng.uniform(-30, 580, 4000), rng.uniform(40, 90, 4000), rng.uniform(-0.4, 0.4, 4000) + np.pi * rng.integers(0, 2, 4000)
    d = np.hypot(px[:, None] - x, py[:, None] - y)
    off = h[:, None] - angle
    d[(np.abs(np.arctan2(np.sin(off), np.cos(off))) > np.radians(10)) | (d > 6)] = np.inf
    got = near.distance(px, py, h, np.radians(10))
    assert 100 < np.isfinite(got).sum() < 3000
    np.testing.assert_allclose(got, d.min(axis=1), atol=1e-9)


def crowded(spark):
    """Steps of vehicles that up to four sensors see at once, side by side in places, with gaps, lengths seen short from afar and a null lane."""
    from pyspark.sql import functions as F

    t = synthetic.corridor(spark, vehicles=5, gap_seconds=1.0).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("truth_id").cast("int") % 4)))
    t = t.where("k = 0 OR pmod(xxhash64(truth_id, ip, k, epoch_time), 4) > 0").withColumn("object_id", F.xxhash64("object_id", "k")).withColumn("s", F.col("s") + F.col("k") * 0.3)
    t = t.withColumn("approaching", F.when(F.col("ip") == "a", F.col("k") % 2 == 0)).withColumn("f32_length_m", F.when(F.col("dist") > 60, 3.5).otherwise(F.col("f32_length_m")))
    t = t.withColumn("lane", F.when((F.col("truth_id") == 4) & (F.col("k") == 0), None).otherwise(F.col("lane")))
    return pipeline.lengthened(pipeline.extended(pipeline.sessions(t, pipeline.Settings()), pipeline.Settings())).localCheckpoint()


def as_states(steps):
    """Every step with its estimate and covariances, front and back."""
    from pyspark.sql import functions as F

    from corridor.operators import extents

    got = kalman.filtered(steps.withColumn("measurement", F.array(*assoc.MEASURED)), "kalman_id", ["epoch_time"])
    return extents.front_back(steps.drop("s", "s_velocity", "d", "d_velocity").join(got, ["kalman_id", "time_ind"]).withColumn("dist", F.lit(0.0)), "mean").localCheckpoint()


def test_distances_of_tracks_that_are_filtered_where_they_meet(spark):
    """Pairs that get their covariances in the kernel against joined rows of states."""
    from pyspark.sql import functions as F

    from corridor.operators import pairs

    steps, cfg = crowded(spark), pipeline.Settings()
    states, key = as_states(steps), ["kalman_id", "kalman_id_leader", "epoch_time"]
    both = assoc.association_distance(pairs.leader_follower_history(states, ["epoch_time", "lane"], "kalman_id", "s", cfg.max_gap))
    want = both.select(*key, (F.col("predicted") | F.col("predicted_leader")).alias("any_pred"), "association_distance").toPandas().sort_values(key, ignore_index=True)
    near = pipeline.close(steps, cfg)
    got = assoc.pair_distances(steps, near, "kalman_id", "leader").toPandas().sort_values(key, ignore_index=True)
    assert len(want) > 1000 and near.where("kalman_id < leader").count() and near.where("kalman_id > leader").count()
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)


def test_trajectories_of_vehicles_against_joined_operators(spark):
    """Filter, fusion, summary and smoother in one kernel a vehicle against the operators, one after the other, and their joins."""
    from pyspark.sql import functions as F

    from corridor.operators import timeseries
    from corridor.operators.kalman import STATE

    steps, cfg = crowded(spark), pipeline.Settings()
    edges = pipeline.matched(steps, pipeline.close(steps, cfg), cfg)
    components = pipeline.vehicles(steps, edges, cfg).localCheckpoint()
    assert components.groupBy("component").count().where("count > 2").count()
    frame = ["vehicle_id", "time_index"]
    assigned = assoc.with_vehicle(as_states(steps), components, "kalman_id")
    chosen = fusion.contributors(assigned, "vehicle_id", "kalman_id", "epoch_time", "predicted", cfg.most_tracks, cfg.prediction_seconds, cfg.skip).localCheckpoint()
    info = fusion.augmented(chosen, frame, "kalman_id", "front_s", "back_s", "approaching", "predicted", [F.min("epoch_time").alias("epoch_time"), F.max("lane").alias("lane")])
    far = fusion.greatest_pair_distance(chosen.where("NOT predicted"), frame, "contributor", assoc.association_distance)
    fused = fusion.fused(chosen, "vehicle_id", "epoch_time").join(info, frame).join(far, frame, "left")
    fused = timeseries.time_delta(fused, "vehicle_id", "epoch_time", "epoch_time")
    soft = kalman.smoothed(fused, "vehicle_id", ["epoch_time"], [f"ci_{c}" for c in STATE], "ci_P")
    fused = timeseries.positions(fused, "vehicle_id", "epoch_time", "time_ind").join(soft, ["vehicle_id", "time_ind"])
    got = pipeline.trajectories(steps, components, cfg)
    assert set(got.columns) == {*fused.columns, "s_velocity", "centre_shift"}
    cols = [c for c in got.columns if c in fused.columns]
    want, got = (d.select(*cols).toPandas().sort_values(frame, ignore_index=True) for d in (fused, got))
    assert want.n_tracks.max() == 3 and want.association_distance.isna().any() and want.association_distance.notna().any()
    for c in ("ci_P", "tracks"):
        for a, b in zip(got.pop(c), want.pop(c), strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9)
    pd.testing.assert_frame_equal(got, want, rtol=1e-7, atol=1e-9, check_dtype=False)


def test_no_covariance_is_written_or_shuffled(spark, tmp_path):
    """States weigh some 700 bytes a step: they are computed where they are needed, and a track's steps are dealt out once a stage."""
    from corridor.sources.writers import StageStore

    lanes = geo.network(spark, synthetic.LANES, 1.0)
    out = pipeline.run(synthetic.corridor(spark, vehicles=3), lanes=lanes, store=StageStore(spark, f"file://{tmp_path}"))
    assert out.count()
    stages = {p.name.split("-")[0]: spark.read.parquet(str(p)) for p in tmp_path.iterdir()}
    assert set(stages) == {"steps", "close", "edges", "vehicles", "trajectories"}
    assert not [c for k, d in stages.items() if k != "trajectories" for c, kind in d.dtypes if kind.startswith("array")]
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    cfg = pipeline.Settings()
    assert plan(pipeline.extended(pipeline.sessions(synthetic.corridor(spark, vehicles=3), cfg), cfg)).count("Exchange hashpartitioning") == 1
    assert plan(pipeline.trajectories(stages["steps"], stages["vehicles"], cfg)).count("Exchange hashpartitioning(vehicle_id") == 1
