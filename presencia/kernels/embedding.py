"""A density-preserving neighbour embedding (after McInnes et al. 2018 and Narayan et al. 2021)."""

from __future__ import annotations

import numpy as np

# The curve 1 / (1 + a d**2b) for a least distance of 0.1 and a spread of 1.
CURVE_A, CURVE_B = 1.5769, 0.8951
#: Points up to which the spectral start comes from a whole decomposition.
DENSE_POINTS = 5000


def cosine_distances(x: np.ndarray) -> np.ndarray:
    """1 - cosine of all rows; a row of zeros is at 1 from all others."""
    norm = np.linalg.norm(x, axis=1)
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    d = np.clip(1 - unit @ unit.T, 0, None)
    np.fill_diagonal(d, 0)
    return d


def nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least values of each row in rising order, the first of equal ones."""
    least = np.partition(d, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(d), k), int)
    for i, row in enumerate(d):
        at = np.flatnonzero(row <= least[i])
        out[i] = at[np.argsort(row[at], kind="stable")[:k]]
    return out


def graph_of(near: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i < j), weights and distances of the symmetric neighbour graph: each point's k neighbours weigh log2(k) in all."""
    n, k = near.shape
    rho = dist[:, 0]
    lo, hi = np.zeros(n), np.full(n, np.inf)
    sigma = np.ones(n)
    for _ in range(64):
        total = np.exp(-np.maximum(dist - rho[:, None], 0) / sigma[:, None]).sum(1)
        high = total > np.log2(k)
        hi, lo = np.where(high, sigma, hi), np.where(high, lo, sigma)
        sigma = np.where(np.isinf(hi), sigma * 2, (lo + hi) / 2)
    sigma = np.maximum(sigma, 1e-3 * max(dist.mean(), 1e-12))
    own = np.exp(-np.maximum(dist - rho[:, None], 0) / sigma[:, None]).ravel()
    frm, to = np.repeat(np.arange(n), k), near.ravel().astype(np.int64)
    pairs, at = np.unique(np.minimum(frm, to) * n + np.maximum(frm, to), return_inverse=True)
    one, other = np.zeros(len(pairs)), np.zeros(len(pairs))
    up = frm < to
    one[at[up]], other[at[~up]] = own[up], own[~up]
    w, d = one + other - one * other, np.zeros(len(pairs))
    d[at] = dist.ravel()
    keep = w > 0
    return pairs[keep] // n, pairs[keep] % n, w[keep], d[keep]


def fuzzy_graph(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i < j) and weights of :func:`graph_of` from a square of distances."""
    near = nearest(d + np.where(np.eye(len(d), dtype=bool), np.inf, 0), k)
    return graph_of(near, np.take_along_axis(d, near, 1))[:3]


def leading_vectors(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, k: int, rnd: np.random.Generator, tol: float = 1e-6, turns: int = 100) -> np.ndarray:
    """Eigenvectors of the ``k`` largest eigenvalues of the symmetric matrix with entries w at (i, j) and (j, i), largest last.

    Whole up to DENSE_POINTS, else by a block Krylov space until their residuals are at most ``tol``, or after ``turns``.
    """
    if n <= DENSE_POINTS:
        whole = np.zeros((n, n))
        whole[i, j] = whole[j, i] = w
        return np.linalg.eigh(whole)[1][:, -k:]
    frm, to = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(frm, kind="stable")
    frm, to, both = frm[order], to[order], np.concatenate([w, w])[order]
    starts = np.flatnonzero(np.concatenate([[True], frm[1:] != frm[:-1]])[: len(frm)])
    rows, held = frm[starts], np.empty(len(frm))

    def apply(x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for c in range(x.shape[1]):
            np.take(np.ascontiguousarray(x[:, c]), to, out=held, mode="clip")
            np.multiply(held, both, out=held)
            out[rows, c] = np.add.reduceat(held, starts)
        return out

    width = 2 * k
    q = np.linalg.qr(rnd.normal(size=(n, width)))[0]
    space = np.empty((2, 0, n))  # the basis and its images, a vector a row
    small = np.zeros((0, 0))
    for turn in range(turns + 1):
        if space.shape[1] < (turn + 1) * width:
            room = np.empty((2, min(2 * space.shape[1] + 10 * width, (turns + 1) * width), n))
            room[:, : turn * width] = space[:, : turn * width]
            space = room
        own = slice(turn * width, (turn + 1) * width)
        space[0, own], space[1, own] = q.T, apply(q).T
        basis, images = space[:, : own.stop]
        grown = np.zeros((own.stop, own.stop))
        grown[: own.start, : own.start] = small
        grown[:, own] = basis @ images[own].T
        grown[own] = grown[:, own].T
        small = grown
        if turn and (turn % 10 == 0 or turn == turns):
            values, mix = np.linalg.eigh(small)
            values, mix = values[-k:], mix[:, -k:]
            if np.linalg.norm(images.T @ mix - basis.T @ mix * values, axis=0).max() <= tol or turn == turns:
                break
        q = images[own].T
        for _ in range(2):
            q = np.linalg.qr(q - basis.T @ (basis @ q))[0]
    return basis.T @ mix


def densmap(x: np.ndarray, n_neighbors: int, dims: int = 3, epochs: int = 300, strength: float = 2.0, seed: int = 42) -> np.ndarray:
    """Coordinates of points in which near ones, by the cosine of their rows, stay near; see :func:`of_neighbours`."""
    n = len(x)
    if n < dims + 2:
        return np.zeros((n, dims))
    d = cosine_distances(x)
    near = nearest(d + np.where(np.eye(n, dtype=bool), np.inf, 0), min(max(2, n_neighbors), n - 1))
    return of_neighbours(near, np.take_along_axis(d, near, 1), dims, epochs, strength, seed)


def of_neighbours(near: np.ndarray, dist: np.ndarray, dims: int = 3, epochs: int = 300, strength: float = 2.0, seed: int = 42) -> np.ndarray:
    """Coordinates in which near points stay near and local densities keep their order, from each point's neighbours by rising distance.

    Spectral start, attraction along graph edges, repulsion of sampled pairs, and in the last third of the epochs a
    force that raises the correlation of the points' log radii before and after.  The same input gives the same result.
    Memory and time grow with the edges.
    """
    n = len(near)
    rnd = np.random.default_rng(seed)
    i, j, w, d = graph_of(near, dist)
    degree = np.bincount(i, w, n) + np.bincount(j, w, n)
    y = leading_vectors(i, j, w / np.sqrt(degree[i] * degree[j]), n, dims + 1, np.random.default_rng(seed))[:, -dims - 1 : -1][:, ::-1].copy()
    y *= np.where(np.take_along_axis(y, np.abs(y).argmax(0)[None], 0) < 0, -1, 1)
    y = np.ascontiguousarray((10 * y / max(np.abs(y).max(), 1e-12) + rnd.normal(0, 1e-4, y.shape)).T)
    mean = lambda v: np.bincount(i, v, n) + np.bincount(j, v, n)
    before = np.log(1e-8 + mean(w * d**2) / degree)
    before = (before - before.mean()) / (before.std() or 1)
    a, b = CURVE_A, CURVE_B
    chance = w / w.max()

    def apart(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.take(y, p, axis=1) - np.take(y, q, axis=1)
        return gap, np.einsum("ce,ce->e", gap, gap)

    def push(force: np.ndarray, p: np.ndarray, q: np.ndarray, gap: np.ndarray, size: np.ndarray) -> None:
        gap *= size
        np.clip(gap, -4, 4, out=gap)
        for c in range(dims):
            force[c] += np.bincount(p, gap[c], n) - np.bincount(q, gap[c], n)

    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        force = np.zeros_like(y)
        take = np.flatnonzero(rnd.random(len(w)) < chance)
        p, q = i[take], j[take]
        gap, s = apart(p, q)
        s += 1e-12
        power = s ** (b - 1)
        push(force, p, q, gap, -2 * a * b * power / (1 + a * s * power))
        p, q = np.repeat(p, 5), rnd.integers(0, n, 5 * len(take))
        gap, s = apart(p, q)
        push(force, p, q, gap, np.where(p == q, 0, 2 * b / ((0.001 + s) * (1 + a * np.maximum(s, 1e-12) ** b))))
        if epoch >= epochs * 2 // 3:
            gap, s = apart(i, j)
            s += 1e-12
            power = s ** (b - 1)
            phi = 1 / (1 + a * s * power)
            slope = -a * b * power * phi**2
            top, low = mean(phi * s), mean(phi)
            after = np.log(1e-8 + top / low)
            spread = after.std() or 1
            z = (after - after.mean()) / spread
            pull = (before - (before * z).mean() * z) / spread
            # the sum over both ends of pull * ((phi + s * slope) / top - slope / low)
            high, less = pull / top, pull / low
            push(force, i, j, gap, 2 * strength * ((phi + s * slope) * (high[i] + high[j]) - slope * (less[i] + less[j])))
        y += rate * force / np.maximum(1, np.linalg.norm(force, axis=0) / 4)
    return y.T
