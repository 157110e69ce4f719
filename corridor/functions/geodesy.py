"""Geometry: UTM in numpy (small inputs) and as columns, polylines, segment intersection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0, _EAST = 0.9996, 500_000.0


def utm_zone(lon: float) -> int:
    return int((lon + 180) // 6) % 60 + 1


def to_utm(lon, lat, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """Eastings and northings by Krüger's series (northern hemisphere; northings are negative south of the equator)."""
    lat, lam = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float) - (zone * 6 - 183))
    c = 2 * np.sqrt(_N) / (1 + _N)
    t = np.sinh(np.arctanh(np.sin(lat)) - c * np.arctanh(c * np.sin(lat)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.hypot(1, t))
    x, y = eta.copy(), xi.copy()
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y = y + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return _EAST + _K0 * _RADIUS * x, _K0 * _RADIUS * y


def from_utm(x, y, zone: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes."""
    xi, eta = np.asarray(y, float) / (_K0 * _RADIUS), (np.asarray(x, float) - _EAST) / (_K0 * _RADIUS)
    u, v = xi.copy(), eta.copy()
    for j, b in enumerate(_BETA, 1):
        u = u - b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        v = v - b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(u) / np.cosh(v))
    lat = chi.copy()
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * np.sin(2 * j * chi)
    return zone * 6 - 183 + np.degrees(np.arctan2(np.sinh(v), np.cos(u))), np.degrees(lat)


def utm_columns(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """``to_utm`` as columns."""
    phi, lam = F.radians(lat), F.radians(lon - float(zone * 6 - 183))
    c = float(2 * np.sqrt(_N) / (1 + _N))
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1.0))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        y = y + a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    return _EAST + _K0 * _RADIUS * x, _K0 * _RADIUS * y


def lonlat_columns(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """``from_utm`` as columns."""
    xi, eta = y / (_K0 * _RADIUS), (x - _EAST) / (_K0 * _RADIUS)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
        v = v - b * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2.0 * j * chi)
    return float(zone * 6 - 183) + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)


def smoothed_corners(xy: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Chaikin's corner cutting, both ends kept."""
    for _ in range(rounds):
        a, b = xy[:-1], xy[1:]
        cut = np.stack([0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b], axis=1).reshape(-1, 2)
        xy = np.concatenate([xy[:1], cut, xy[-1:]])
    return xy


def shrink_free(xy: np.ndarray, factor: float = 0.5, mu: float = -0.5, rounds: int = 5) -> np.ndarray:
    """Taubin's smoothing: Laplacian steps forward and back, ends kept."""
    xy = xy.astype(float).copy()
    for _ in range(rounds):
        for k in (factor, mu):
            xy[1:-1] += k * ((xy[:-2] + xy[2:]) / 2 - xy[1:-1])
    return xy


def respaced(xy: np.ndarray, step: float) -> np.ndarray:
    """The polyline cut into round(length / step) equal pieces."""
    d = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))])
    n = max(1, round(d[-1] / step))
    at = np.linspace(0, d[-1], n + 1)
    return np.stack([np.interp(at, d, xy[:, 0]), np.interp(at, d, xy[:, 1])], axis=1)


def crossing(line: np.ndarray, polyline: np.ndarray) -> np.ndarray | None:
    """Where a straight line (2 points) first crosses a polyline."""
    p, r = line[0], line[1] - line[0]
    q, s = polyline[:-1], np.diff(polyline, axis=0)
    den = r[0] * s[:, 1] - r[1] * s[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((q[:, 0] - p[0]) * s[:, 1] - (q[:, 1] - p[1]) * s[:, 0]) / den
        u = ((q[:, 0] - p[0]) * r[1] - (q[:, 1] - p[1]) * r[0]) / den
    hit = np.flatnonzero((den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    return q[hit[0]] + u[hit[0]] * s[hit[0]] if len(hit) else None
