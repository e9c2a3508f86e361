"""One-dimensional 3-means, Ward linkage and density clustering on small dense inputs."""

from __future__ import annotations

import numpy as np


def kmeans_1d(values: np.ndarray, k: int = 3) -> np.ndarray:
    """Optimal labels 0..k-1 by rising centre (fewer if there are fewer distinct values): dynamic programming over cuts.

    Equal values share a label; of equally good cuts the lowest is taken.
    """
    uniq, back, counts = np.unique(np.asarray(values, float), return_inverse=True, return_counts=True)
    n, k = len(uniq), min(k, len(uniq))
    if n == 0:
        return np.zeros(0, int)
    w = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    centre = np.average(uniq, weights=counts)
    x = uniq - centre
    s, q = (np.concatenate([[0.0], np.cumsum(counts * x**p)]) for p in (1, 2))

    def cost(i: np.ndarray | int, j: int) -> np.ndarray:  # of the values i..j-1 as one cluster
        return (q[j] - q[i]) - (s[j] - s[i]) ** 2 / np.maximum(w[j] - w[i], 1)

    best = np.array([0.0] + [cost(0, j) for j in range(1, n + 1)])
    cuts = []
    for c in range(2, k + 1):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        # best cuts never move back as j grows, so halving the range of j halves that of the cuts
        stack = [(c, n, c - 1, n - 1)]
        while stack:
            first, last, low, high = stack.pop()
            if first > last:
                continue
            j = (first + last) // 2
            starts = np.arange(low, min(high, j - 1) + 1)
            total = best[starts] + cost(starts, j)
            at = int(np.argmin(total))
            new[j], cut[j] = total[at], starts[at]
            stack += [(first, j - 1, low, cut[j]), (j + 1, last, cut[j], high)]
        best = new
        cuts.append(cut)
    labels, j = np.zeros(n, int), n
    for c in range(k - 1, 0, -1):
        i = cuts[c - 1][j]
        labels[i:j] = c
        j = i
    return labels[back]


def ward(distances: np.ndarray) -> np.ndarray:
    """Ward linkage of a square distance matrix by the nearest-neighbour chain: rows (left, right, height, size).

    Merges come by rising height; a pair's smaller cluster number is left.  Leaves are
    0..n-1, merge i makes cluster n + i.  Memory and time grow with the square
    of the leaves; callers bound them.
    """
    d = np.array(distances, float) ** 2
    np.fill_diagonal(d, np.inf)
    return links_of(chain(d, np.ones(len(d))), len(d))


def chain(d: np.ndarray, size: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of clusters of some sizes by their squared distances, infinite on the diagonal; both arrays are used up.

    A merged cluster goes on under ``b``.
    """
    n = len(d)
    alive, merges, chain = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((a, b, np.sqrt(max(d[a, b], 0.0))))
        total = size + size[a] + size[b]
        new = ((size + size[a]) * d[a] + (size + size[b]) * d[b] - size * d[a, b]) / total
        size[b] += size[a]
        alive[a] = False
        new[~alive] = np.inf
        new[b] = np.inf
        d[b], d[:, b] = new, new
    return merges


def links_of(merges: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """Rows (left, right, height, size) by rising height of merges that name a leaf of each of their two clusters."""
    order = sorted(range(n - 1), key=lambda i: merges[i][2])
    parent = list(range(2 * n - 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes, out = [1] * n, []
    for i, at in enumerate(order):
        a, b, height = merges[at]
        left, right = sorted((root(a), root(b)))
        parent[left] = parent[right] = n + i
        sizes.append(sizes[left] + sizes[right])
        out.append((left, right, height, sizes[-1]))
    return np.array(out, float).reshape(-1, 4)


def leaf_order(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in an order in which every cluster is one run, and the heights between neighbours: two leaves join at the largest between them."""
    runs: list[list[int] | None] = [[i] for i in range(len(links) + 1)]
    gap: dict[int, float] = {}  # by the leaf before it
    for left, right, height, _ in links:
        a, b = runs[int(left)], runs[int(right)]
        runs[int(left)] = runs[int(right)] = None
        gap[a[-1]] = height
        a += b
        runs.append(a)
    order = runs[-1] or []
    return np.array(order, int), np.array([gap[x] for x in order[:-1]], float)


def cut_tree(links: np.ndarray, height: float) -> np.ndarray:
    """Cluster numbers from 1, in order of the first leaf, of the tree cut at a height (merges at it are kept)."""
    n = len(links) + 1
    parent = list(range(2 * n - 1))
    for i, (left, right, h, _) in enumerate(links):
        if h <= height:
            parent[int(left)] = parent[int(right)] = n + i
    labels, numbers = np.zeros(n, int), {}
    for leaf in range(n):
        x = leaf
        while parent[x] != x:
            x = parent[x]
        labels[leaf] = numbers.setdefault(x, len(numbers) + 1)
    return labels


def members(links: np.ndarray) -> list[list[int]]:
    """The leaves of every cluster: the leaves themselves, then each merge's."""
    out = [[i] for i in range(len(links) + 1)]
    for left, right, *_ in links:
        out.append(out[int(left)] + out[int(right)])
    return out


def cophenetic(links: np.ndarray) -> np.ndarray:
    """Heights at which leaves first share a cluster, as a square matrix."""
    n, groups = len(links) + 1, members(links)
    out = np.zeros((n, n))
    for left, right, h, _ in links:
        a, b = groups[int(left)], groups[int(right)]
        out[np.ix_(a, b)] = h
        out[np.ix_(b, a)] = h
    return out


def elbow_index(values: np.ndarray) -> int:
    """Index of the elbow of a rising curve: the lowest point once rank and value are scaled to 0..1 and the chord is level."""
    y = np.asarray(values, float)
    span = y.max() - y.min()
    scaled = (y - y.min()) / span if span else np.zeros_like(y)
    return int(np.argmin(scaled - np.linspace(0, 1, len(y)))) if len(y) > 1 else 0


def distances(x: np.ndarray) -> np.ndarray:
    """Euclidean distances between all rows, made for so many rows at a time that differences of long vectors stay in 32 MB."""
    out, step = np.zeros((len(x), len(x))), max(1, 4_000_000 // max(x.size, 1))
    for i in range(0, len(x), step):
        out[i : i + step] = np.sqrt(((x[i : i + step, None, :] - x[None, :, :]) ** 2).sum(-1))
    return out


def hdbscan(points: np.ndarray, min_cluster_size: int, min_samples: int) -> tuple[np.ndarray, float]:
    """Density clustering: labels (-1 is noise) and the relative validity on the spanning tree.

    Mutual reachability, minimum spanning tree, condensed tree and excess-of-mass
    selection (Campello, Moulavi and Sander 2013); validity after Moulavi et al. 2014 on the
    tree's edges.  Square in the points; callers bound them.
    """
    x = np.asarray(points, float)
    n = len(x)
    if n < 2:
        return np.full(n, -1), -1.0
    d = distances(x)
    core = np.sort(d, axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    # Prim's algorithm
    inside, near, frm = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        closer = (reach[at] < near) & ~inside
        near[closer], frm[closer] = reach[at][closer], at
        nxt = int(np.argmin(np.where(inside, np.inf, near)))
        edges.append((near[nxt], frm[nxt], nxt))
        at = nxt
    edges.sort()
    parent, size = list(range(2 * n - 1)), [1] * n
    top, children = list(range(n)), {}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for i, (w, a, b) in enumerate(edges):
        left, right = root(a), root(b)
        children[n + i] = (left, right, w)
        parent[left] = parent[right] = n + i
        size.append(size[left] + size[right])
    del top

    def leaves(v: int) -> list[int]:
        out, stack = [], [v]
        while stack:
            u = stack.pop()
            if u < n:
                out.append(u)
            else:
                stack += children[u][:2]
        return out

    # condensed tree: a cluster lives from its birth until it splits into two that are large enough
    stability, birth, kids, body = {}, {}, {}, {}
    stack = [(2 * n - 2, 0.0)]
    while stack:
        start, born = stack.pop()
        birth[start], stability[start], kids[start], body[start] = born, 0.0, [], leaves(start)
        v = start
        while v >= n:
            left, right, w = children[v]
            lam = 1 / w if w > 0 else 1e12
            big = [u for u in (left, right) if size[u] >= min_cluster_size]
            if len(big) == 2:
                stability[start] += size[v] * (lam - born)
                kids[start] = [left, right]
                stack += [(left, lam), (right, lam)]
                break
            lost = size[v] - (size[big[0]] if big else 0)
            stability[start] += lost * (lam - born)
            if not big:
                break
            v = big[0]
    chosen, value = {}, {}
    for c in sorted(birth, key=lambda c: size[c]):
        below = sum(value[u] for u in kids[c])
        if c == 2 * n - 2 or (kids[c] and below > stability[c]):
            value[c], chosen[c] = below, [x for u in kids[c] for x in chosen[u]]
        else:
            value[c], chosen[c] = stability[c], [c]
    labels = np.full(n, -1)
    for i, c in enumerate(sorted(chosen[2 * n - 2], key=lambda c: min(body[c]))):
        labels[body[c]] = i
    k = labels.max() + 1
    if k < 2:
        return labels, -1.0
    inner, between = np.zeros(k), np.full(k, np.inf)
    for w, a, b in edges:
        la, lb = labels[a], labels[b]
        if la == lb and la >= 0:
            inner[la] = max(inner[la], w)
        elif la >= 0 and lb >= 0:
            between[la], between[lb] = min(between[la], w), min(between[lb], w)
    between = np.where(np.isinf(between), max(e[0] for e in edges), between)
    validity = (between - inner) / np.maximum(np.maximum(between, inner), 1e-300)
    return labels, float((validity * np.bincount(labels[labels >= 0], minlength=k)).sum() / n)


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette over all points, noise counting as a cluster of its own."""
    x, names = np.asarray(points, float), np.unique(labels)
    if len(names) < 2:
        return -1.0
    d = distances(x)
    sums = np.stack([d[:, labels == c].sum(1) for c in names], 1)
    counts = np.array([(labels == c).sum() for c in names])
    own = np.searchsorted(names, labels)
    rows = np.arange(len(x))
    a = sums[rows, own] / np.maximum(counts[own] - 1, 1)
    mean = sums / counts
    mean[rows, own] = np.inf
    b = mean.min(1)
    s = np.where(counts[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())
