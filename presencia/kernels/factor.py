"""Non-negative factors and least squares, and correspondence analysis, on dense matrices."""

from __future__ import annotations

import ctypes

import numpy as np

#: Rows from which a matrix is decomposed in its own memory.
IN_PLACE = 1500
#: Eigenvalues that are bisected together, and the nodes that carry what poles beyond their interval's width from it add.
TOGETHER, NODES = 64, 24


def nndsvd(x: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Starting factors from the leading singular pairs' dominant signs (Boutsidis and Gallopoulos 2008)."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    w, h = np.zeros((x.shape[0], rank)), np.zeros((rank, x.shape[1]))
    for k in range(min(rank, len(s))):
        a, b = u[:, k], vt[k]
        if k == 0:
            w[:, 0], h[0] = np.sqrt(s[0]) * np.abs(a), np.sqrt(s[0]) * np.abs(b)
            continue
        parts = [(np.maximum(sign * a, 0), np.maximum(sign * b, 0)) for sign in (1, -1)]
        p, q = max(parts, key=lambda t: np.linalg.norm(t[0]) * np.linalg.norm(t[1]))
        m = np.linalg.norm(p) * np.linalg.norm(q)
        if m:
            w[:, k] = np.sqrt(s[k] * m) * p / np.linalg.norm(p)
            h[k] = np.sqrt(s[k] * m) * q / np.linalg.norm(q)
    return w, h


def nmf(x: np.ndarray, rank: int, max_iter: int = 10_000, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, int]:
    """Frobenius factors by coordinate descent over components (HALS) from :func:`nndsvd`.

    Stops when the projected gradient falls to ``tol`` of its first value.  Components whose
    start is zero are raised to a small constant, or they could never move.
    """
    w, h = nndsvd(x, rank)
    small = 1e-6 * (x.mean() or 1.0)
    w[:, ~w.any(0)] = small
    h[~h.any(1)] = small
    first = None
    for it in range(1, max_iter + 1):
        moved = 0.0
        for a, b, data in ((w, h.T, x), (h.T, w, x.T)):
            gram, cross = b.T @ b, data @ b
            for k in range(rank):
                grad = a @ gram[:, k] - cross[:, k]
                moved += np.abs(np.where(a[:, k] == 0, np.minimum(grad, 0), grad)).sum()
                if gram[k, k] > 0:
                    a[:, k] = np.maximum(a[:, k] - grad / gram[k, k], 0)
        first = moved if first is None else first
        if moved <= tol * first:
            break
    return w, h, it


def nnls(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The non-negative x of least |A x - b| from A'A and A'b: active sets (Lawson and Hanson 1974)."""
    n = len(cross)
    x, free = np.zeros(n), np.zeros(n, bool)
    tol = 1e-10 * max(1.0, np.abs(cross).max(initial=0))
    for _ in range(3 * n + 10):
        grad = cross - gram @ x
        grad[free] = -np.inf
        if n == 0 or grad.max() <= tol:
            break
        free[int(np.argmax(grad))] = True
        while True:
            at = np.flatnonzero(free)
            z = np.zeros(n)
            z[at] = np.linalg.lstsq(gram[np.ix_(at, at)], cross[at], rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                z = x
                break
        x = z
    return x


def mca_inertia(burt: np.ndarray, n_questions: int) -> np.ndarray:
    """Principal inertias of multiple correspondence analysis from the Burt matrix, in falling order.

    The indicator matrix's inertias are the square roots of the Burt matrix's.
    """
    total = burt.sum()
    masses = burt.sum(1) / total
    keep = masses > 0
    p, r = burt[np.ix_(keep, keep)] / total, masses[keep]
    root = np.sqrt(np.outer(r, r))
    values = np.linalg.eigvalsh((p - np.outer(r, r)) / root)[::-1]
    return np.maximum(values[: keep.sum() - n_questions], 0)


def eigenvalues(a: np.ndarray) -> np.ndarray:
    """Eigenvalues of a symmetric matrix in rising order; a large one is used up, so that it is held once.

    Large ones go to LAPACK's two-stage reduction in numpy's own library, about half the time of the usual one; where that is
    not found, to numpy.
    """
    n = len(a)
    try:
        solve = ctypes.CDLL(np.linalg._umath_linalg.__file__).scipy_dsyevd_2stage_64_
    except (AttributeError, OSError):
        return np.linalg.eigvalsh(a)
    if n < IN_PLACE or not (a.flags.c_contiguous and a.dtype == np.float64):
        return np.linalg.eigvalsh(a)
    values, info, order = np.zeros(n), ctypes.c_int64(0), ctypes.c_int64(n)
    size, isize = np.zeros(1), np.zeros(1, np.int64)
    for ask in (True, False):  # first for the working space
        work, iwork = (size, isize) if ask else (np.zeros(int(size[0])), np.zeros(int(isize[0]), np.int64))
        lengths = [ctypes.c_int64(-1 if ask else len(x)) for x in (work, iwork)]
        at = lambda x: x.ctypes.data_as(ctypes.c_void_p)
        ref = ctypes.byref
        solve(b"N", b"L", ref(order), at(a), ref(order), at(values), at(work), ref(lengths[0]), at(iwork), ref(lengths[1]), ref(info), ctypes.c_size_t(1), ctypes.c_size_t(1))
        if info.value:
            raise np.linalg.LinAlgError(f"no eigenvalues: {info.value}")
    return values


def spectrum(a: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix without negative ones, and its eigenvectors' products with the columns of ``v``.

    A large matrix is used up, so that it is held once: it is made tridiagonal in place, and the rotations that make that diagonal
    (LAPACK's QR of bidiagonal matrices, on a Cholesky factor of it raised to be definite) turn ``v`` alone.
    """
    n, m = v.shape
    try:
        blas = ctypes.CDLL(np.linalg._umath_linalg.__file__)
        reduce, turn, solve = blas.scipy_dsytrd_64_, blas.scipy_dormtr_64_, blas.scipy_dbdsqr_64_
    except (AttributeError, OSError):
        n = 0
    if n < IN_PLACE or not (a.flags.c_contiguous and a.dtype == np.float64):
        values, vectors = np.linalg.eigh(a)
        return values, vectors.T @ v
    at, ref, whole, one = (lambda x: x.ctypes.data_as(ctypes.c_void_p)), ctypes.byref, ctypes.c_int64, ctypes.c_size_t(1)
    info, order, columns = whole(0), whole(n), whole(m)
    d, e, tau, c = np.zeros(n), np.zeros(n), np.zeros(n), np.array(v, dtype=float, order="F")

    def called(f, *args, names: int = 1) -> None:
        f(*args, ref(info), *[one] * names)
        if info.value:
            raise np.linalg.LinAlgError(f"no eigenvalues: {info.value}")

    for step, args, names in ((reduce, (b"L", ref(order), at(a), ref(order), at(d), at(e), at(tau)), 1), (turn, (b"L", b"L", b"T", ref(order), ref(columns), at(a), ref(order), at(tau), at(c), ref(order)), 3)):
        work = np.zeros(1)
        called(step, *args, at(work), ref(whole(-1)), names=names)  # for the working space
        work = np.zeros(int(work[0]))
        called(step, *args, at(work), ref(whole(len(work))), names=names)
    raised = np.abs(d).max() + 2 * np.abs(e[:-1]).max()
    d += raised
    for i in range(n):
        d[i] = np.sqrt(d[i] - (e[i - 1] ** 2 if i else 0))
        if i + 1 < n:
            e[i] /= d[i]
    none, work = np.zeros(1), np.zeros(4 * n)
    called(solve, b"U", ref(order), ref(columns), ref(whole(0)), ref(whole(0)), at(d), at(e), at(c), ref(order), at(none), ref(whole(1)), at(none), ref(whole(1)), at(work))
    return d**2 - raised, c


def low_rank(v: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal columns and signs of the same v diag(signs) v', without those that are nothing to working precision."""
    q, r = np.linalg.qr(v)
    values, vectors = np.linalg.eigh((r * signs) @ r.T)
    keep = np.abs(values) > 1e-15 * np.abs(values).max(initial=0)
    return q @ vectors[:, keep] * np.sqrt(np.abs(values[keep])), np.sign(values[keep])


def changed_eigenvalues(poles: np.ndarray, w: np.ndarray, signs: np.ndarray, part: int = 0, parts: int = 1) -> np.ndarray:
    """Eigenvalues of diag(poles) + w diag(signs) w', w a few orthogonal columns: of ``parts`` groups' lots the lot ``part``.

    So many poles are below x, and so many of signs + w' diag(1 / (poles - x)) w are positive beyond the positive signs: that is
    how many eigenvalues are below x.  Each is bisected between the poles that may bound it, down to rounding.  Poles far from
    such an interval are summed once, at the nodes of a Chebyshev polynomial that is as exact as the sum.
    """
    order = np.argsort(poles, kind="stable")
    poles, w, n, r = poles[order], w[order], len(poles), w.shape[1]
    up, down = int((signs > 0).sum()), int((signs < 0).sum())
    sizes = (w**2).sum(0)
    ends = np.concatenate([np.full(down, poles[0] - sizes[signs < 0].max(initial=0)), poles, np.full(up, poles[-1] + sizes[signs > 0].max(initial=0))])
    least = 2 * np.finfo(float).eps * np.abs(ends).max()
    a, b = np.triu_indices(r)
    pairs = w[:, a] * w[:, b]
    angles = (np.arange(NODES) + 0.5) * np.pi / NODES
    fit = np.cos(np.outer(np.arange(NODES), angles)) * 2 / NODES
    fit[0] /= 2

    def over(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        d = of[None, :] - x[:, None]
        d[d == 0] = least * 1e-3
        return 1 / d

    found = []
    for start in range(part * TOGETHER, n, parts * TOGETHER):
        own = np.arange(start, min(start + TOGETHER, n))
        lo, hi = ends[own].copy(), ends[own + up + down].copy()
        low, high = lo.min(), hi.max()
        middle, half = (low + high) / 2, max((high - low) / 2, least)
        i, j = np.searchsorted(poles, [low - 2 * half, high + 2 * half])
        near, near_pairs = poles[i:j], pairs[i:j]
        x = middle + half * np.cos(angles)
        series = fit @ (over(x, poles[:i]) @ pairs[:i] + over(x, poles[j:]) @ pairs[j:])
        while (hi - lo).max() > least:
            x = (lo + hi) / 2
            s = np.empty((len(own), r, r))
            s[:, a, b] = s[:, b, a] = over(x, near) @ near_pairs + np.cos(np.arange(NODES) * np.arccos(np.clip((x - middle) / half, -1, 1))[:, None]) @ series
            s[:, np.arange(r), np.arange(r)] += signs
            below = np.searchsorted(poles, x) + (np.linalg.eigvalsh(s) > 0).sum(1) - up > own
            lo, hi = np.where(below, lo, x), np.where(below, x, hi)
        found.append((lo + hi) / 2)
    return np.concatenate(found) if found else np.zeros(0)
