"""Distances between track states, and the groups of tracks that belong to one vehicle."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.writers import saved
from .extents import sides
from .kalman import H, by_track, estimates

R_ASSOC = np.diag([5 / 3, 1.0, 1.5, 1.0])


def chi2_4(p: float) -> float:
    """Quantile of the chi-square distribution with four degrees of freedom, from its closed form."""
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - math.exp(-mid / 2) * (1 + mid / 2) < p else (lo, mid)
    return lo


GATES = {p: chi2_4(p) for p in (0.95, 0.99, 0.995, 0.999)}


def distances(z_follower: np.ndarray, z_leader: np.ndarray, p_sum: np.ndarray, maha: bool = False, dims: int = 4) -> np.ndarray:
    """Least squared Mahalanobis distance over places [row, place, dims], plus log-determinant unless ``maha``."""
    keep = [0, 1, 2, 3] if dims == 4 else [0, 2]
    h = np.eye(6) if dims == 6 else H[keep]
    r = np.diag([5 / 3, 1.0, 1.0, 1.5, 1.0, 1.0]) if dims == 6 else R_ASSOC[np.ix_(keep, keep)]
    s = h @ p_sum @ h.T + r
    e = z_follower - z_leader
    m = (e * np.linalg.solve(s[:, None], e[..., None])[..., 0]).sum(-1).min(-1)
    return m if maha else m + np.linalg.slogdet(s)[1]


def likelihoods(z_follower: np.ndarray, z_leader: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Greatest Gaussian log-likelihood over places of a follower's measurement under its leader's state."""
    best = distances(z_follower, z_leader, p, dims=z_follower.shape[-1])  # least distance plus log-determinant
    return -0.5 * (z_follower.shape[-1] * math.log(2 * math.pi) + best)


def _over_places(df: DataFrame, into: str, suffix: str, pairs: list[tuple[str, str]], both: bool, kernel) -> DataFrame:
    """``kernel`` (follower's and leader's measurements [row, place, 4], covariance) as a column, in Arrow batches."""
    rest = ("s_velocity", "d", "d_velocity")
    cols = [*dict.fromkeys([*(x for p in pairs for x in p), *rest])]

    @F.pandas_udf("double")
    def run(mine: pd.DataFrame, other: pd.DataFrame, p: pd.Series, q: pd.Series) -> pd.Series:
        zf = np.stack([mine[[a, *rest]].to_numpy(float) for a, _ in pairs], axis=1)
        zl = np.stack([other[[b, *rest]].to_numpy(float) for _, b in pairs], axis=1)
        cov = np.stack(q.to_numpy()).reshape(-1, 6, 6)
        if both:
            cov = cov + np.stack(p.to_numpy()).reshape(-1, 6, 6)
        return pd.Series(kernel(zf, zl, cov))

    return df.withColumn(into, run(F.struct(*cols), F.struct(*[F.col(f"{c}{suffix}").alias(c) for c in cols]), F.col("P"), F.col(f"P{suffix}")))


SPOTS = ("s", "front_s", "back_s")


def association_distance(df: DataFrame, into: str = "association_distance", maha: bool = False, permute: bool = False, suffix: str = "_leader") -> DataFrame:
    """Distance of two states over centre, front and back positions.

    ``permute`` compares different places with each other (all ordered pairs).
    """
    pairs = [(a, b) for a in SPOTS for b in SPOTS if a != b] if permute else [(a, a) for a in SPOTS]
    return _over_places(df, into, suffix, pairs, True, lambda zf, zl, p: distances(zf, zl, p, maha))


def loglikelihood(df: DataFrame, into: str = "loglikelihood", suffix: str = "_leader") -> DataFrame:
    """Log-likelihood of the follower's place under the leader's covariance alone, the greatest over places."""
    return _over_places(df, into, suffix, [(a, a) for a in SPOTS], False, likelihoods)


MEASURED = ("s", "s_velocity", "d", "d_velocity")
#: What a step of a track carries beside its measurement, for ``tracked``.
CARRIED = ("time_diff", "predicted", "missing", "front_off", "back_off", "length_s", "approaching")


def tracked(pdf: pd.DataFrame, key: str, order: list[str], dt: str = "time_diff") -> tuple[pd.DataFrame, dict[str, np.ndarray], np.ndarray]:
    """Rows of whole tracks, with front_s and back_s, their estimates, and their places [row, place, 4] in the order of ``SPOTS``."""
    rows, got = estimates(pdf, key, order, MEASURED, dt)
    x = got["x"]
    front, back = sides(rows, x[:, 0])
    spots = np.stack([np.stack([s, x[:, 1], x[:, 3], x[:, 4]], axis=1) for s in (x[:, 0], front, back)], axis=1)
    return rows.assign(front_s=front, back_s=back), got, spots


def pair_distances(steps: DataFrame, pairs: DataFrame, follower: str, leader: str) -> DataFrame:
    """``association_distance`` of pairs of tracks at all times that they share on a lane: kalman_id, kalman_id_leader, epoch_time, any_pred.

    Both tracks of a pair meet as they were measured and are filtered there, so that covariances are never stored or
    shuffled.
    """
    f, l = F.col(follower), F.col(leader)  # noqa: E741
    both = pairs.groupBy(F.least(f, l).alias("lo"), F.greatest(f, l).alias("hi")).agg(F.max(f < l).alias("up"), F.max(f > l).alias("down"))
    each = both.select("*", F.explode(F.array("lo", "hi")).alias("__id"))
    rows = steps.select("kalman_id", "epoch_time", "lane", *MEASURED, *CARRIED).join(each, F.col("kalman_id") == F.col("__id")).drop("__id")
    on = ["lo", "hi", "lane", "epoch_time"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[["lo", "hi", "kalman_id"]].to_numpy()
        rows, got, spots = tracked(pdf.assign(__k=np.cumsum(np.r_[0, (own[1:] != own[:-1]).any(axis=1)])), "__k", ["epoch_time"])
        first = rows["kalman_id"].to_numpy() == rows["lo"].to_numpy()
        side = rows[[*on, "up", "down", "predicted"]].assign(at=np.arange(len(rows)))
        met = side[first].merge(side[~first], on=on, suffixes=("", "_other"))
        i, j = met["at"].to_numpy(), met["at_other"].to_numpy()
        p = got["P"].reshape(-1, 6, 6)
        met = met.assign(any_pred=met["predicted"] | met["predicted_other"], association_distance=distances(spots[i], spots[j], p[i] + p[j]))
        up, down = met[met["up"]], met[met["down"]]
        out = pd.concat([up.assign(kalman_id=up["lo"], kalman_id_leader=up["hi"]), down.assign(kalman_id=down["hi"], kalman_id_leader=down["lo"])])
        return out[["kalman_id", "kalman_id_leader", "epoch_time", "any_pred", "association_distance"]]

    schema = "kalman_id long, kalman_id_leader long, epoch_time timestamp_ntz, any_pred boolean, association_distance double"
    return by_track(rows.withColumn("__pair", F.xxhash64("lo", "hi")), "__pair", ["lo", "hi", "kalman_id", "epoch_time"], run, schema)


def distance_2d(es: Column, ed: Column, ss: Column, dd: Column, sd: Column, maha: bool = False) -> Column:
    """The same in s and d alone, in closed form: ss, dd, sd are the summed covariances before measurement noise."""
    a, c = ss + R_ASSOC[0, 0], dd + R_ASSOC[2, 2]
    det = a * c - sd * sd
    m = (c * es * es - 2 * sd * es * ed + a * ed * ed) / det
    return m if maha else m + F.log(det)


#: Edges that a file of a round holds at most, so that few edges never lie in many files; and so many that one task settles.
FILE_ROWS, FEW = 200_000, 500_000


def _settled(batches, names: list[str]):
    """(id, component) of all edges of a task: roots hook on to smaller ones, and paths are halved, until nothing changes."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    got = pa.Table.from_batches(held).combine_chunks()
    ends = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got.columns])
    code = ends.dictionary_encode()
    values = code.dictionary.take(pc.array_sort_indices(code.dictionary))
    at = pc.index_in(ends, values).to_numpy()  # numbered in the order of the ids
    a, b = at[: len(got)], at[len(got) :]
    root = np.arange(len(values))
    while True:
        x, y = root[a], root[b]
        if np.array_equal(x, y):
            break
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while not np.array_equal(root, root[root]):
            root = root[root]
    yield pa.RecordBatch.from_arrays([values, values.take(pa.array(root))], names=names)


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that edges lead to, by alternating large-star and small-star rounds.

    Each round rewires every edge towards the smallest neighbour, so edges never grow beyond the input's and rounds in
    the order of log(n) suffice.  Rounds are joins and grouped minima; a vertex with very many neighbours is
    pre-aggregated before the shuffle, and its join side is split by adaptive execution.  Every round is written to
    shared storage, which cuts the lineage; only two numbers reach the driver.  As soon as no more than ``FEW`` edges are
    left (some MB), one task settles them and saves the remaining rounds.

    Null ends and loops are ignored; repeated edges count once; an empty input gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = saved(e.where("hi > lo").distinct())
    check = lambda d: tuple(d.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 40)))).first())
    before = check(e)
    kind = e.schema["hi"].dataType.simpleString()
    for _ in range(rounds):
        if before[0] <= FEW:
            return e.coalesce(1).mapInArrow(lambda batches: _settled(batches, ["id", "component"]), f"id {kind}, component {kind}")
        files = before[0] // FILE_ROWS + 1
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        # Written out, so that the join below deals both of its sides itself and can split a vertex with many edges.
        least = saved(both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m")).coalesce(files))
        star = both.join(least, "hi").where("lo > hi and lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        star = saved(star.coalesce(files))
        low = saved(star.groupBy("hi").agg(F.min("lo").alias("m")).coalesce(files))
        small = star.join(low, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = saved(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct().coalesce(files))
        now = check(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return e.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("id"), "component").unionByName(roots)


def with_vehicle(df: DataFrame, components: DataFrame, ident: str, into: str = "vehicle_id") -> DataFrame:
    """Rows with their component; tracks without a partner are vehicles of their own."""
    c = components.select(F.col("id").alias("__id"), "component")
    return df.join(c, df[ident] == c["__id"], "left").withColumn(into, F.coalesce("component", ident)).drop("__id", "component")


def prune(nodes: list, edges: dict[tuple, float], weights: dict[tuple, float | None], cutoff: float, removals: int = 20) -> list[tuple]:
    """Greedy removal of edges until every measured pair within a remaining component weighs less than the cutoff.

    An unknown or zero weight counts as just below the cutoff.  Each step removes the edge that leaves the least mean
    weight of all pairs that are still together (0 if there is none; of equal ones the smallest edge), ``removals`` edges
    at most.  Then removed edges return, in the order of their removal, where all pairs stay below the cutoff.

    Only an edge whose removal splits a component changes which pairs are together, so one walk over the spanning
    trees finds every candidate's mean.
    """
    value = {k: float(w) if w else cutoff - 0.001 for k, w in weights.items()}
    kept, gone = set(edges), []
    while kept and len(gone) < removals:
        up, bridges = _trees(nodes, kept)
        root = {n: _climb(up, n) for n in nodes}
        together = {k: w for k, w in value.items() if root[k[0]] == root[k[1]]}
        if all(w < cutoff for w in together.values()):
            break
        across: dict[tuple, list[float]] = {}
        for (a, b), w in together.items():
            for e in _path(up, a, b):
                if e in bridges:
                    across.setdefault(e, []).append(w)
        total, count = sum(together.values()), len(together)

        def mean(e, total=total, count=count, across=across):
            cut = across.get(e, ())
            return (total - sum(cut)) / (count - len(cut)) if count > len(cut) else 0.0

        out = min(kept, key=lambda e: (mean(e), e))
        kept.remove(out)
        gone.append(out)
    for e in gone:
        up, _ = _trees(nodes, kept | {e})
        if all(w < cutoff for (a, b), w in value.items() if _climb(up, a) == _climb(up, b)):
            kept.add(e)
    return sorted(kept)


def _trees(nodes: list, edges: set[tuple]) -> tuple[dict, set[tuple]]:
    """Depth-first spanning trees, node -> (depth, parent, edge to it), and the edges that lie on no cycle."""
    near: dict = {n: [] for n in nodes}
    for e in sorted(edges):
        near[e[0]].append((e[1], e))
        near[e[1]].append((e[0], e))
    up: dict = {}
    low: dict = {}
    for start in nodes:
        if start in up:
            continue
        up[start], low[start] = (0, None, None), 0
        stack = [(start, iter(near[start]))]
        while stack:
            n, todo = stack[-1]
            for other, e in todo:
                if other not in up:
                    up[other] = (up[n][0] + 1, n, e)
                    low[other] = up[other][0]
                    stack.append((other, iter(near[other])))
                    break
                if e != up[n][2]:
                    low[n] = min(low[n], up[other][0])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[n])
    return up, {e for n, (depth, _, e) in up.items() if e is not None and low[n] == depth}


def _climb(up: dict, n):
    while up[n][1] is not None:
        n = up[n][1]
    return n


def _path(up: dict, a, b) -> list[tuple]:
    """Tree edges between two nodes of one tree."""
    out = []
    while a != b:
        if up[a][0] < up[b][0]:
            a, b = b, a
        out.append(up[a][2])
        a = up[a][1]
    return out


def prune_alike(n: int, edges: np.ndarray, pairs: np.ndarray, weights: np.ndarray, cutoff: float, removals: int = 20) -> np.ndarray:
    """``prune`` for many components of one shape at once: which edges [component, edge] are kept.

    Nodes are 0 to ``n`` - 1, ``edges`` and ``pairs`` are sorted rows (lo, hi), and ``weights`` [component, pair] are NaN where
    unknown.  Components with the same edges left take each step together.
    """
    value = np.where(np.isnan(weights) | (weights == 0), cutoff - 0.001, weights)
    kept, gone = np.ones((len(weights), len(edges)), bool), np.full((len(weights), removals), -1)
    names, known = [tuple(e) for e in edges.tolist()], {}

    def shape(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that are together, edges left, and which of the pairs each of these parts."""
        key = mask.tobytes()
        if key not in known:
            left = np.flatnonzero(mask)
            up, bridges = _trees(list(range(n)), {names[e] for e in left})
            together = np.array([k for k, (a, b) in enumerate(pairs.tolist()) if _climb(up, a) == _climb(up, b)], dtype=int)
            place = {names[e]: k for k, e in enumerate(left)}
            across = np.zeros((len(left), len(together)))
            for k, (a, b) in enumerate(pairs[together].tolist()):
                across[[place[e] for e in _path(up, a, b) if e in bridges], k] = 1
            known[key] = together, left, across
        return known[key]

    def groups(rows: np.ndarray, masks: np.ndarray):
        packed = np.packbits(masks, axis=1)
        _, first, which = np.unique(packed, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        cut = np.searchsorted(which.ravel()[order], np.arange(len(first) + 1))
        for k, x in enumerate(first):
            yield masks[x], rows[order[cut[k] : cut[k + 1]]]

    rows = np.arange(len(weights))
    for step in range(removals if len(edges) else 0):
        more = [rows[:0]]
        for mask, own in groups(rows, kept[rows]) if len(rows) else ():
            if not mask.any():
                continue
            together, left, across = shape(mask)
            v = value[np.ix_(own, together)]
            over = (v >= cutoff).any(axis=1)
            own, v = own[over], v[over]
            if not len(own):
                continue
            count = len(together) - across.sum(axis=1)
            with np.errstate(invalid="ignore"):
                cut = v @ across.T if np.isfinite(v).all() else np.stack([v[:, e > 0].sum(axis=1) for e in across], axis=1)
                mean = np.where(count > 0, (v.sum(axis=1, keepdims=True) - cut) / np.maximum(count, 1), 0.0)
            out = left[np.where(np.isnan(mean), np.inf, mean).argmin(axis=1)]
            kept[own, out] = False
            gone[own, step] = out
            more.append(own)
        rows = np.concatenate(more)
    for step in range(removals):
        rows = np.flatnonzero(gone[:, step] >= 0)
        if not len(rows):
            break
        masks = kept[rows]
        masks[np.arange(len(rows)), gone[rows, step]] = True
        for mask, own in groups(rows, masks):
            back = own[(value[np.ix_(own, shape(mask)[0])] < cutoff).all(axis=1)]
            kept[back, gone[back, step]] = True
    return kept


def _codes(*columns: pa.Array) -> list[np.ndarray]:
    """Numbers in the order of the ids."""
    if pa.types.is_integer(columns[0].type):
        return [c.to_numpy(zero_copy_only=False) for c in columns]
    values = pc.unique(pa.concat_arrays(columns))
    values = values.take(pc.array_sort_indices(values))
    return [pc.index_in(c, values).to_numpy(zero_copy_only=False) for c in columns]


def _pruned(batches, cutoff: float, removals: int, names: list[str]):
    """Kept edges of the components of each batch: (component, pairs), pairs as lists of (lo, hi, weight, edge)."""
    for batch in batches:
        lists_ = batch.column(1)
        many = np.diff(lists_.offsets.to_numpy())
        flat = lists_.flatten()
        if not len(flat):
            continue
        lo, hi, weight, edge = flat.flatten()
        own = np.repeat(np.arange(len(many)), many)
        a, b = _codes(lo, hi)
        node = np.lexsort((np.concatenate([a, b]), np.concatenate([own, own])))
        c, v = np.concatenate([own, own])[node], np.concatenate([a, b])[node]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (v[1:] != v[:-1])])
        number = np.cumsum(new) - 1
        first = np.zeros(len(many), int)
        first[c[::-1]] = number[::-1]  # of each component's nodes
        size = np.bincount(c[new], minlength=len(many))
        rank = np.empty(len(node), int)
        rank[node] = number - first[c]
        x, y = rank[: len(own)], rank[len(own) :]
        w, e = weight.to_numpy(zero_copy_only=False).astype(float), edge.to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((y, x, e, own))
        # a repeated pair counts once
        k = np.stack([own, e, x, y])[:, order]
        order = order[np.concatenate([(k[:, 1:] != k[:, :-1]).any(axis=0), [True]])]
        own, x, y, e, w = own[order], x[order], y[order], e[order], w[order]
        cut = np.searchsorted(own, np.arange(len(many) + 1))
        mark = np.stack([e, x, y], axis=1).astype(np.int32)
        alike: dict[tuple, list[int]] = {}
        for k, (p, q) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if q > p:
                alike.setdefault((int(size[k]), mark[p:q].tobytes()), []).append(k)
        hits = []
        for (n, _), some in alike.items():
            p = cut[some[0]]
            is_edge = e[p : cut[some[0] + 1]]
            at = cut[some][:, None] + np.arange(len(is_edge))
            xy = np.stack([x, y], axis=1)[p : p + len(is_edge)]
            measured = w[at[:, ~is_edge]]
            if is_edge.all():
                pairs, measured = xy, np.where(np.isnan(w[at]), np.inf, w[at])
            else:
                pairs = xy[~is_edge]
            kept = prune_alike(n, xy[is_edge], pairs, measured, cutoff, removals)
            hits.append(at[:, is_edge][kept])
        hit = np.sort(np.concatenate(hits))
        back = pa.array(order[hit])
        got = pa.array(np.where(np.isnan(w[hit]), np.inf, w[hit]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[hit])), lo.take(back), hi.take(back), got], names=names)


def pruned_lists(components: DataFrame, cutoff: float = GATES[0.999], removals: int = 20) -> DataFrame:
    """(component, pairs), a row a component with its pairs as structs (lo, hi, weight, edge) -> kept edges.

    A pair that is an edge and measured comes twice.  Components of one shape are settled together in Arrow batches.
    """
    kind = components.schema["component"].dataType.simpleString()
    lo = components.schema["pairs"].dataType.elementType["lo"].dataType.simpleString()
    names = ["component", "lo", "hi", "weight"]
    return components.select("component", "pairs").mapInArrow(lambda batches: _pruned(batches, cutoff, removals, names), f"component {kind}, lo {lo}, hi {lo}, weight double")


def pruned_edges(edges: DataFrame, weights: DataFrame, cutoff: float = GATES[0.999], removals: int = 20) -> DataFrame:
    """edges (component, lo, hi, weight) and measured weights of all pairs (component, lo, hi, weight) -> kept edges.

    A component is a handful of tracks.
    """
    row = lambda d, edge: d.select("component", F.struct("lo", "hi", F.col("weight").cast("double").alias("weight"), F.lit(edge).alias("edge")).alias("p"))
    both = row(edges, True).unionByName(row(weights, False))
    return pruned_lists(both.groupBy("component").agg(F.collect_list("p").alias("pairs")), cutoff, removals)
