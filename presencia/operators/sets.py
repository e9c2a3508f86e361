"""All pairs of genomes by their gene sets, for any number of genomes: rows of the square tables are made where they are used.

The square of the genomes is never stored whole.  All tasks get the sets as numbers (4 bytes a cell) and make the rows they need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from presencia.kernels import clustering, embedding
from presencia.kernels.factor import TOGETHER, changed_eigenvalues, eigenvalues, low_rank, spectrum
from presencia.session import materialise

#: A gene that more than one in so many genomes has is counted by a dense product, others by lists.
DENSE_SHARE = 16
#: Pairs of a batch of output.
BATCH_PAIRS = 500_000
#: Bytes of the rows that a task holds of each of two blocks.
BLOCK_BYTES = 64 << 20
#: Clusters whose square one task holds (512 MB); more are first merged round by round.
MAX_SQUARE = 8000
#: Numbers of the most frequent genes that are tried as those that link groups of genomes.
LEFT_OUT = (0, 1, 2, 3, 4, 6, 8, 10, 12, 16, 24, 32, 48, 64)
#: Relative difference below which two heights count as equal.
EQUAL = 1e-12


class Sets:
    """Genomes (in order of their names) and their genes as numbers."""

    def __init__(self, ids: np.ndarray, genome: np.ndarray, gene: np.ndarray, n_genes: int) -> None:
        order = np.lexsort((gene, genome))
        self.ids, self.n, self.n_genes = ids, len(ids), n_genes
        self.size = np.bincount(genome, minlength=self.n)
        self.genes, self.start = gene[order].astype(np.int32), np.concatenate([[0], np.cumsum(self.size)])
        self._lists: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lists": None}

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rare genes' genomes with their bounds, which genes are rare, and the frequent genes' dense columns; made once a process."""
        if self._lists is None:
            genome = np.repeat(np.arange(self.n), self.size)
            freq = np.bincount(self.genes, minlength=self.n_genes)
            rare = freq * DENSE_SHARE <= self.n
            light = rare[self.genes]
            order = np.argsort(self.genes[light], kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.where(rare, freq, 0))])
            column = np.cumsum(~rare) - 1
            dense = np.zeros((self.n, int((~rare).sum())), np.float32)
            dense[genome[~light], column[self.genes[~light]]] = 1
            self._lists = genome[light][order], bounds, rare, dense
        return self._lists

    def shared(self, rows: np.ndarray) -> np.ndarray:
        """Genes shared by each of some genomes with all, exact."""
        at, bounds, rare, dense = self.lists()
        out = (dense[rows] @ dense.T).astype(float)
        for k, i in enumerate(rows):
            own = self.genes[self.start[i] : self.start[i + 1]]
            found = [at[bounds[g] : bounds[g + 1]] for g in own[rare[own]]]
            if found:
                out[k] += np.bincount(np.concatenate(found), minlength=self.n)
        return out

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """1 - |common| / |union| of some genomes with all."""
        both = self.shared(rows)
        return 1 - both / np.maximum(self.size[rows][:, None] + self.size[None, :] - both, 1)

    def blocks(self, rows: np.ndarray, n_bytes: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
        """``rows`` in blocks whose rows of the square take ``n_bytes`` at most."""
        step = max(1, n_bytes // (8 * max(self.n, 1)))
        return (rows[k : k + step] for k in range(0, len(rows), step))


def stored(files: list[str], columns: list[str], dictionaries: list[str] | None = None) -> pa.Table:
    """Columns of Parquet files in the shared folder, read without Spark."""
    parts = []
    for file in files:
        fs, inner = pafs.FileSystem.from_uri(file)
        parts.append(pq.read_table(inner, filesystem=fs, columns=columns, read_dictionary=dictionaries))
    return pa.concat_tables(parts)


def sets_of(p: DataFrame) -> Sets:
    """The gene sets of a presence table, read from its stored columns by the driver."""
    files = materialise(p.select("gene", "genome").distinct(), "presence").inputFiles()
    if not files:
        return Sets(np.zeros(0, object), np.zeros(0, int), np.zeros(0, int), 0)
    rows = stored(files, ["gene", "genome"], ["gene", "genome"]).unify_dictionaries().combine_chunks()
    genes, genomes = (pa.chunked_array(rows[c].chunks, rows[c].type).combine_chunks() for c in ("gene", "genome"))
    names = genomes.dictionary.to_numpy(zero_copy_only=False) if len(rows) else np.zeros(0, object)
    order = np.argsort(names, kind="stable")
    rank = np.empty(len(names), int)
    rank[order] = np.arange(len(names))
    return Sets(names[order], rank[genomes.indices.to_numpy()], genes.indices.to_numpy(), len(genes.dictionary))


def tasks(spark: SparkSession, made: Callable[[int], Iterator[pa.RecordBatch]], parts: int, schema: str) -> DataFrame:
    """``made`` of 0 to ``parts`` - 1, a task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from made(k)

    return spark.range(0, parts, 1, parts).mapInArrow(run, schema)


def parts_of(spark: SparkSession, n: int) -> int:
    """The number of tasks for ``n`` rows."""
    return max(1, min(n, 4 * spark.sparkContext.defaultParallelism))


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Numbers from 0 to a few, halves up as by SQL; Spark's round goes through decimals, a third of the time of a column of all pairs."""
    return x if digits is None else np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def distances(spark: SparkSession, sets: Sets, digits: int | None = None) -> DataFrame:
    """``a < b, distance`` of all pairs."""
    parts, ids = parts_of(spark, sets.n), sets.ids

    def made(k: int) -> Iterator[pa.RecordBatch]:
        names = pa.array(ids, pa.string())
        for rows in sets.blocks(np.arange(k, sets.n, parts), 8 * BATCH_PAIRS):
            d = sets.distances(rows)
            b = np.concatenate([np.arange(i + 1, sets.n) for i in rows])
            a = np.repeat(rows, sets.n - 1 - rows)
            values = np.concatenate([d[x, i + 1 :] for x, i in enumerate(rows)])
            yield pa.record_batch([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(rounded(values, digits))], ["a", "b", "distance"])

    return tasks(spark, made, parts, "a string, b string, distance double")


def correlation_distances(spark: SparkSession, sets: Sets, digits: int | None = None) -> DataFrame:
    """``genome_1 < genome_2, distance``: 1 - Pearson correlation of the rows of the square distance table."""
    blocks, ids = list(sets.blocks(np.arange(sets.n))), sets.ids

    def scaled(rows: np.ndarray) -> np.ndarray:
        d = sets.distances(rows)
        d -= d.mean(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            d /= np.sqrt((d**2).sum(1, keepdims=True))
        return d

    def made(k: int) -> Iterator[pa.RecordBatch]:
        names, rows = pa.array(ids, pa.string()), blocks[k]
        left = scaled(rows)
        for other in blocks[k:]:
            c = 1 - np.clip(np.nan_to_num(left @ (left if other is rows else scaled(other)).T), -1, 1)
            at, to = np.nonzero(rows[:, None] < other[None, :])
            yield pa.record_batch([names.take(pa.array(rows[at])), names.take(pa.array(other[to])), pa.array(rounded(c[at, to], digits))], ["genome_1", "genome_2", "distance"])

    return tasks(spark, made, len(blocks), "genome_1 string, genome_2 string, distance double")


def _between(sets: Sets, label: np.ndarray, size: np.ndarray, within: np.ndarray, of: np.ndarray, mine: int) -> np.ndarray:
    """Ward's squared distances of a cluster (its leaves ``of``, its number ``mine``) from all clusters; infinite from itself."""
    k, sums = len(size), 0
    for rows in sets.blocks(of, 16 << 20):
        sums = sums + (sets.distances(rows) ** 2).sum(0)
    mean = np.bincount(label, sums, k) / (size[mine] * size)
    out = 2 * size[mine] * size / (size[mine] + size) * (mean - within[mine] / 2 - within / 2)
    out[mine] = np.inf
    return out


def linkage(spark: SparkSession, sets: Sets) -> np.ndarray:
    """Ward links (see :func:`clustering.ward`) of the genomes by their set distances.

    While there are more than MAX_SQUARE clusters, tasks find every cluster's nearest one and all pairs that are nearest to each
    other merge: Ward's criterion never brings merged clusters nearer than their parts, so these merges belong to its tree.  What
    is left is linked whole by one task.  Among equally near clusters the next in order is taken, so that ties pair off.
    """
    n = sets.n
    label, size, within = np.arange(n), np.ones(n), np.zeros(n)  # within: a cluster's mean squared distance, each leaf with itself too
    first, merges = np.arange(n), []
    while len(size) > MAX_SQUARE:
        near, height = nearest_clusters(spark, sets, label, size, within)
        to, taken = np.arange(len(size)), np.zeros(len(size), bool)
        for i in np.argsort(height, kind="stable"):
            j = near[i]
            if not taken[i] and not taken[j] and (near[j] == i or height[i] - height[j] <= EQUAL * abs(height[j])):
                a, b = sorted((i, j))
                taken[a] = taken[b] = True
                to[b] = a
                merges.append((first[a], first[b], np.sqrt(max(height[i], 0.0))))
                mean = height[i] * (size[a] + size[b]) / (2 * size[a] * size[b]) + within[a] / 2 + within[b] / 2
                total = size[a] + size[b]
                within[a] = (size[a] ** 2 * within[a] + size[b] ** 2 * within[b] + 2 * size[a] * size[b] * mean) / total**2
                size[a] = total
        kept = np.flatnonzero(to == np.arange(len(to)))
        number = np.cumsum(to == np.arange(len(to))) - 1
        label, size, within, first = number[to[label]], size[kept], within[kept], first[kept]

    def whole(_: int) -> Iterator[pa.RecordBatch]:
        d = np.empty((len(size), len(size)))
        members = np.split(np.argsort(label, kind="stable"), np.cumsum(size.astype(int))[:-1])
        if len(size) == n:
            for rows in sets.blocks(np.arange(n), 16 << 20):
                d[rows] = sets.distances(rows) ** 2
        else:
            for mine, of in enumerate(members):
                d[mine] = _between(sets, label, size, within, of, mine)
        np.fill_diagonal(d, np.inf)
        made = clustering.chain(d, size.copy())
        yield pa.record_batch([pa.array([int(m[i]) for m in made]) for i in (0, 1)] + [pa.array([float(m[2]) for m in made])], ["a", "b", "height"])

    if len(size) > 1:
        rest = tasks(spark, whole, 1, "a bigint, b bigint, height double").collect()  # a row a merge, in the task's order
        merges += [(first[r["a"]], first[r["b"]], r["height"]) for r in rest]
    return clustering.links_of(merges, n)


def nearest_clusters(spark: SparkSession, sets: Sets, label: np.ndarray, size: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cluster's nearest one, the next in order of equally near ones, and its squared distance."""
    members = np.split(np.argsort(label, kind="stable"), np.cumsum(size.astype(int))[:-1])
    parts = parts_of(spark, len(size))

    def made(part: int) -> Iterator[pa.RecordBatch]:
        mine, near, height = [], [], []
        for k in range(part, len(members), parts):
            row = _between(sets, label, size, within, members[k], k)
            low = row.min()
            ties = np.flatnonzero(row <= low + EQUAL * abs(low))
            mine.append(k)
            near.append(int(ties[np.searchsorted(ties, k) % len(ties)]))
            height.append(float(low))
        yield pa.record_batch([pa.array(mine, pa.int64()), pa.array(near, pa.int64()), pa.array(height, pa.float64())], ["k", "near", "height"])

    found = sorted(tasks(spark, made, parts, "k bigint, near bigint, height double").collect())
    return np.array([r["near"] for r in found]), np.array([r["height"] for r in found])


def largest(spark: SparkSession, sets: Sets) -> float:
    """The largest distance of a pair, 0 without one."""
    parts = parts_of(spark, sets.n)

    def made(k: int) -> Iterator[pa.RecordBatch]:
        top = 0.0
        for rows in sets.blocks(np.arange(k, sets.n, parts), 16 << 20):
            d = sets.distances(rows)
            d[np.arange(len(rows)), rows] = 0
            top = max(top, float(d.max(initial=0)))
        yield pa.record_batch([pa.array([top])], ["top"])

    return max(r["top"] for r in tasks(spark, made, parts, "top double").collect())


def distance_clusters(spark: SparkSession, sets: Sets, threshold: float, links: np.ndarray | None = None) -> DataFrame:
    """``genome, cluster``: Ward clusters of the genomes (by ``links`` if given) cut at ``threshold`` times the largest distance."""
    labels = clustering.cut_tree(linkage(spark, sets) if links is None else links, threshold * largest(spark, sets)) if sets.n else []
    return spark.createDataFrame([(str(g), int(c)) for g, c in zip(sets.ids, labels, strict=True)], "genome string, cluster int")


def nearest(spark: SparkSession, sets: Sets, k: int) -> DataFrame:
    """``i, near, dist``: the ``k`` nearest other genomes of each by the cosine of their sets, in rising order, the first of equal ones."""
    parts = parts_of(spark, sets.n)

    def made(part: int) -> Iterator[pa.RecordBatch]:
        for rows in sets.blocks(np.arange(part, sets.n, parts), 16 << 20):
            d = np.clip(1 - sets.shared(rows) / np.sqrt(sets.size[rows][:, None] * sets.size[None, :]), 0, None)
            d[np.arange(len(rows)), rows] = np.inf
            near = embedding.nearest(d, k)
            lists = lambda x, kind: pa.ListArray.from_arrays(np.arange(0, x.size + 1, k, dtype=np.int32), pa.array(x.ravel(), kind))
            yield pa.record_batch([pa.array(rows, pa.int32()), lists(near, pa.int32()), lists(np.take_along_axis(d, near, 1), pa.float64())], ["i", "near", "dist"])

    return tasks(spark, made, parts, "i int, near array<int>, dist array<double>")


def cophenetic_correlation(spark: SparkSession, sets: Sets, links: np.ndarray) -> float | None:
    """The correlation of the distances with the heights at which the tree of ``links`` joins the genomes."""
    n, parts = sets.n, parts_of(spark, sets.n)
    if n < 3:
        return None
    order, gaps = clustering.leaf_order(links)
    place = np.empty(n, int)
    place[order] = np.arange(n)

    def made(k: int) -> Iterator[pa.RecordBatch]:
        total = np.zeros(5)
        for rows in sets.blocks(np.arange(k, n, parts), 16 << 20):
            for i, d in zip(rows, sets.distances(rows)[:, order], strict=True):
                at = place[i]
                h = np.concatenate([np.maximum.accumulate(gaps[:at][::-1])[::-1], [0], np.maximum.accumulate(gaps[at:])])
                d[at] = 0
                total += d.sum(), h.sum(), d @ d, h @ h, d @ h
        yield pa.record_batch([pa.array([x]) for x in total], list("abcde"))

    sums = np.sum([list(r) for r in tasks(spark, made, parts, ", ".join(f"{c} double" for c in "abcde")).collect()], axis=0)
    d, h, dd, hh, dh = sums / (n * (n - 1))  # each pair is met twice
    spread = (dd - d * d) * (hh - h * h)
    return float((dh - d * h) / np.sqrt(spread)) if spread > 0 else float("nan")


def components(sets: Sets, kept: np.ndarray) -> np.ndarray:
    """Of each genome, the first genome that ``kept`` genes link it to, directly or by others."""
    genome = np.repeat(np.arange(sets.n), sets.size)
    light = kept[sets.genes]
    genome, gene = genome[light], sets.genes[light]
    label = np.arange(sets.n)
    while True:
        least = np.full(sets.n_genes, sets.n)
        np.minimum.at(least, gene, label[genome])
        found = label.copy()
        np.minimum.at(found, genome, least[gene])
        found = found[found]
        if (found == label).all():
            return label
        label = found


def parted(sets: Sets) -> tuple[list[np.ndarray], np.ndarray]:
    """Groups of genomes, the largest first, and the few genes that more than one group has: what is decomposed for the least work.

    The most frequent genes are left out, none to LEFT_OUT of them, and the genomes grouped by the others.
    """
    freq = np.bincount(sets.genes, minlength=sets.n_genes)
    often = np.argsort(-freq, kind="stable")
    best = None
    for left in [x for x in LEFT_OUT if x < max(sets.n_genes, 1)]:
        kept = np.ones(sets.n_genes, bool)
        kept[often[:left]] = False
        label = components(sets, kept)
        sizes = np.bincount(label)
        work = 1.4 * sets.n**3 if sizes.max(initial=0) == sets.n else 9 * (sizes.astype(float) ** 3).sum() + 500 * sets.n * (left + 2) ** 3
        if best is None or work < best[0]:
            best = work, label, often[:left]
    _, label, across = best
    groups = np.split(np.argsort(label, kind="stable"), np.cumsum(sizes := np.bincount(label)[np.unique(label)])[:-1])
    return [groups[i] for i in np.argsort(-sizes, kind="stable")], across


def inertias(spark: SparkSession, sets: Sets) -> np.ndarray:
    """All principal inertias of the table with genomes as questions of two answers, in falling order.

    They are the eigenvalues of the genomes' correlations over their number.  A genome with all genes has no second answer and
    no inertia.  Genomes that share no gene but a few that are almost everywhere (:func:`parted`) correlate by these and the
    margins alone, so tasks decompose each group, 8 bytes for each pair in it, and the changes by the few are added to the
    eigenvalues.  Where all genomes hang together, one task holds 8 bytes for each pair of them once.
    """
    share = sets.size / max(sets.n_genes, 1)
    varied = np.flatnonzero(sets.size < sets.n_genes)
    if not len(varied):
        return np.zeros(0)
    groups, across = parted(sets)
    if len(groups) > 1:
        return _inertias_of_groups(spark, sets, [g for g in (g[sets.size[g] < sets.n_genes] for g in groups) if len(g)], across)

    def whole(_: int) -> Iterator[pa.RecordBatch]:
        r = np.empty((len(varied), len(varied)))
        root = np.sqrt(share[varied] * (1 - share[varied]))
        for at in sets.blocks(np.arange(len(varied)), 16 << 20):
            rows = varied[at]
            both = sets.shared(rows)[:, varied] / sets.n_genes
            r[at] = (both - share[rows][:, None] * share[varied][None, :]) / (root[at][:, None] * root[None, :])
        values = eigenvalues(r)[::-1]
        yield pa.record_batch([pa.array(np.maximum(values, 0) / sets.n)], ["inertia"])

    return np.array([r["inertia"] for r in tasks(spark, whole, 1, "inertia double").collect()])


def _inertias_of_groups(spark: SparkSession, sets: Sets, groups: list[np.ndarray], across: np.ndarray) -> np.ndarray:
    """:func:`inertias` of groups of genomes that share no genes but those ``across`` them."""
    m, everyone = sets.n_genes, np.concatenate(groups)
    share = sets.size[everyone] / m
    root = np.sqrt(share * (1 - share))
    column = np.full(m, -1)
    column[across] = np.arange(1, len(across) + 1)
    v = np.zeros((sets.n, len(across) + 1))
    far = column[sets.genes]
    v[np.repeat(np.arange(sets.n), sets.size)[far > 0], far[far > 0]] = 1 / np.sqrt(m)
    v = v[everyone] / root[:, None]
    v[:, 0] = share / root
    v, signs = low_rank(v, np.array([-1.0] + [1.0] * len(across)))
    bounds = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    parts = parts_of(spark, len(groups))

    def decomposed(part: int) -> Iterator[pa.RecordBatch]:
        for k in range(part, len(groups), parts):
            at, cells = slice(bounds[k], bounds[k + 1]), [sets.genes[sets.start[g] : sets.start[g + 1]] for g in groups[k]]
            cells = [c[column[c] < 0] for c in cells]
            names, gene = np.unique(np.concatenate(cells), return_inverse=True)
            own = Sets(groups[k], np.repeat(np.arange(len(cells)), [len(c) for c in cells]), gene, len(names))
            r = np.empty((own.n, own.n))
            for rows in own.blocks(np.arange(own.n), 16 << 20):
                r[rows] = own.shared(rows) / m / (root[at][rows][:, None] * root[at][None, :])
            values, w = spectrum(r, v[at])
            yield pa.record_batch([pa.array(values), *[pa.array(np.ascontiguousarray(c)) for c in w.T]], ["pole", *[f"w{i}" for i in range(w.shape[1])]])

    names = [f"w{i}" for i in range(v.shape[1])]
    files = materialise(tasks(spark, decomposed, parts, ", ".join(f"{c} double" for c in ["pole", *names])), "poles").inputFiles()
    lots = parts_of(spark, -(-len(everyone) // TOGETHER))

    def changed(lot: int) -> Iterator[pa.RecordBatch]:
        rows = stored(files, ["pole", *names])
        w = np.stack([rows[c].to_numpy() for c in names], 1)
        yield pa.record_batch([pa.array(changed_eigenvalues(rows["pole"].to_numpy(), w, signs, lot, lots))], ["value"])

    values = stored(materialise(tasks(spark, changed, lots, "value double"), "inertias").inputFiles(), ["value"])["value"].to_numpy()
    return np.maximum(np.sort(values)[::-1], 0) / sets.n
