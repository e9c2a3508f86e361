"""Curve fits of a few parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from presencia.kernels.factor import nnls

GOLDEN = (5**0.5 - 1) / 2


def golden_section(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-9) -> float:
    """The place of a minimum of ``f`` between two bounds."""
    a, b = hi - GOLDEN * (hi - lo), lo + GOLDEN * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tol * max(1.0, abs(lo), abs(hi)):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - GOLDEN * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + GOLDEN * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def heaps(sizes: np.ndarray) -> tuple[float, float]:
    """(lambda, kappa) of the least-squares fit kappa * x**lambda to sizes at x = 1, 2, ...

    For a given lambda kappa is linear, so only lambda is searched.  A curve of zeros gives (0, 0).
    """
    y = np.asarray(sizes, float)
    x = np.log(np.arange(1, len(y) + 1))
    if len(y) < 2 or not y.any():
        return 0.0, float(y[0]) if len(y) else 0.0

    def kappa(lam: float) -> float:
        p = np.exp(lam * x)
        return float(p @ y / (p @ p))

    def loss(lam: float) -> float:
        return float(((y - kappa(lam) * np.exp(lam * x)) ** 2).sum())

    grid = np.linspace(-3, 3, 121)
    at = int(np.argmin([loss(g) for g in grid]))
    lam = golden_section(loss, grid[max(at - 1, 0)], grid[min(at + 1, 120)])
    return float(lam), kappa(lam)


def dual_power(freq: np.ndarray, cumulative: np.ndarray, threshold: float = 0.1) -> dict[str, float]:
    """Fit of a cumulative frequency curve by two power laws, one from either end, and its segments.

    Y0 * (c1 x**(1-a1) / (1-a1) - c2 (n-x)**(1-a2) / (1-a2) + k), n the largest frequency + 1, c >= 0, a >= 1,
    0 <= k <= Y_last / Y0.  For given exponents it is linear with bounded coefficients; the
    exponents are searched over a shrinking grid.
    """
    x, y = np.asarray(freq, float), np.asarray(cumulative, float)
    n, scale = x.max() + 1, y[0]
    target = y / scale

    def solve(a1: float, a2: float) -> tuple[float, np.ndarray]:
        design = np.stack([x ** (1 - a1) / (1 - a1), -((n - x) ** (1 - a2)) / (1 - a2), np.ones_like(x)], 1)
        c = nnls(design.T @ design, design.T @ target)
        if c[2] > target[-1]:  # the constant at its bound
            c = np.append(nnls(design[:, :2].T @ design[:, :2], design[:, :2].T @ (target - target[-1])), target[-1])
        return float(((design @ c - target) ** 2).sum()), c

    best, centre, width = None, (2.0, 2.0), (0.999, 0.999)
    lo = 1.0 + 1e-6
    grid = [(a, b) for a in np.geomspace(1e-3, 4, 16) + 1 for b in np.geomspace(1e-3, 4, 16) + 1]
    for _ in range(12):
        for a1, a2 in grid:
            loss, c = solve(a1, a2)
            if best is None or loss < best[0]:
                best, centre = (loss, c, a1, a2), (a1, a2)
        width = (width[0] * 0.45, width[1] * 0.45)
        grid = [(max(lo, centre[0] + i * width[0]), max(lo, centre[1] + j * width[1])) for i in np.linspace(-1, 1, 7) for j in np.linspace(-1, 1, 7)]
    loss, c, a1, a2 = best
    pmf = lambda f: c[0] * f**-a1 + c[1] * (n - f) ** -a2
    edge = golden_section(pmf, 1.0, n - 1)
    fit = scale * (c[0] * x ** (1 - a1) / (1 - a1) - c[1] * (n - x) ** (1 - a2) / (1 - a2) + c[2])
    spread = ((y - y.mean()) ** 2).sum()
    return {
        "c1": float(c[0]), "c2": float(c[1]), "a1": float(a1), "a2": float(a2), "k": float(c[2]), "inflection": edge,
        "core_min": edge + (n - 1 - edge) * (1 - threshold), "unique_max": edge * threshold,
        "r_squared": float(1 - ((y - fit) ** 2).sum() / spread) if spread else 1.0, "mae": float(np.abs(y - fit).mean()),
    }
