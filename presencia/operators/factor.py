"""Factors of a presence table: fit, normalise, binarise, reconstruct, score, choose ranks.

Weights are long: (rank, gene, component, w) and (rank, genome, component, h), components from 0.  A pair without a
row in a binarised table is 0.  Presence is (gene, genome).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from presencia.kernels.clustering import kmeans_1d
from presencia.kernels.factor import nmf, nnls
from presencia.operators.sets import inertias, sets_of
from presencia.session import discard, materialise

#: Cells (genes x genomes) of a table that one task may hold densely, 128 MB; larger ones are factorised distributed.
DENSE_CELLS = 16_000_000
#: Rows (genomes or genes times the rank) of a factor that an iteration may broadcast.
MAX_FACTOR = 2_000_000
#: Vectors of a subspace iteration beside those asked for; they make the asked ones settle sooner.
EXTRA = 8


def shape(p: DataFrame) -> tuple[int, int]:
    """Numbers of genes and genomes."""
    r = p.agg(F.countDistinct("gene").alias("g"), F.countDistinct("genome").alias("s")).first()
    return r["g"], r["s"]


def factorise(p: DataFrame, ranks: list[int], max_iter: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(rank, gene, component, w) and (rank, genome, component, h) of each rank.

    Tables up to DENSE_CELLS are fitted whole, a task per rank, from a deterministic start; larger ones by
    the same fit distributed (:func:`factorise_large`).  Ranks must be positive; an empty table gives no rows.
    """
    if not ranks or min(ranks) < 1 or max_iter < 1:
        raise ValueError("ranks and iterations must be positive")
    genes, genomes = shape(p)
    if genes * genomes > DENSE_CELLS:
        parts = [factorise_large(p, r, max_iter) for r in ranks]
        w, h = parts[0]
        for a, b in parts[1:]:
            w, h = w.unionByName(a), h.unionByName(b)
        return w, h

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rank = int(rows["rank"].iloc[0])
        g, gene = np.unique(rows["gene"].to_numpy(dtype=str), return_inverse=True)
        s, genome = np.unique(rows["genome"].to_numpy(dtype=str), return_inverse=True)
        x = np.zeros((len(g), len(s)))
        x[gene, genome] = 1
        w, h, _ = nmf(x, rank, max_iter)
        w, h = w[:, (order := np.argsort(-w.sum(0) * h.sum(1), kind="stable"))], h[order]
        side = lambda kind, keys, m: pd.DataFrame({"rank": rank, "kind": kind, "key": np.repeat(keys, rank), "component": np.tile(np.arange(rank), len(keys)), "x": m.reshape(-1)})
        return pd.concat([side("w", g, w), side("h", s, h.T)])

    spread = p.withColumn("rank", F.explode(F.array(*[F.lit(r) for r in sorted(set(ranks))])))
    out = materialise(spread.groupBy("rank").applyInPandas(fit, "rank int, kind string, key string, component int, x double"), "factors")
    return (
        out.where("kind = 'w'").select("rank", F.col("key").alias("gene"), "component", F.col("x").alias("w")),
        out.where("kind = 'h'").select("rank", F.col("key").alias("genome"), "component", F.col("x").alias("h")),
    )


def _vectors(df: DataFrame, key: str, rank: int, salt: int) -> DataFrame:
    start = [(F.abs(F.xxhash64(F.lit(salt), key, F.lit(k))) % 1000 / 1000.0 + 0.05).alias(f"v{k}") for k in range(rank)]
    return df.select(key).distinct().select(key, *start)


def _gram(df: DataFrame, rank: int) -> np.ndarray:
    """v'v, combined map-side to one row."""
    cells = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")) for i in range(rank) for j in range(rank)]
    return np.array(df.agg(F.array(*cells).alias("g")).first()["g"], float).reshape(rank, rank)


def _small(df: DataFrame, values: int) -> DataFrame:
    return F.broadcast(df) if values <= MAX_FACTOR else df


def _crossed(p: DataFrame, other: DataFrame, key: str, by: str, width: int, n_other: int) -> DataFrame:
    """(key, x0 ..): the sums of the other side's vectors over the present cells of each row."""
    vectors = other.select(by, *[f"v{k}" for k in range(width)])
    return p.join(_small(vectors, n_other * width), by).groupBy(key).agg(*[F.sum(f"v{k}").alias(f"x{k}") for k in range(width)])


def _mixed(df: DataFrame, key: str, name: str, m: np.ndarray) -> DataFrame:
    """Rows of the vectors ``name``0 .. times the matrix, as v0 .."""
    cell = lambda j: sum((F.col(f"{name}{i}") * float(m[i, j]) for i in range(len(m))), F.lit(0.0)).alias(f"v{j}")
    return df.select(key, *[cell(j) for j in range(m.shape[1])])


def settled(gram: np.ndarray, image: np.ndarray, k: int, tol: float) -> bool:
    """Whether the ``k`` leading Ritz values of a basis Q under B have residuals of at most ``tol`` of the first.

    gram is Q'BQ and image (BQ)'(BQ); a residual bounds the distance to an eigenvalue.
    """
    values, vectors = np.linalg.eigh(gram)
    left = np.einsum("ij,ik,kj->j", vectors, image, vectors) - values**2
    return bool((left[::-1][:k] <= (tol * values[-1]) ** 2).all())


def _start(p: DataFrame, rank: int, genes: int, genomes: int, seed: int, turns: int = 100, tol: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """The start of :func:`presencia.kernels.factor.nndsvd`, its singular pairs by subspace iteration with EXTRA more vectors."""
    width = min(rank + EXTRA, genes, genomes)
    v, gram = materialise(_vectors(p, "genome", width, seed), "start"), None
    for turn in range(turns + 1):
        image = _gram(v, width)
        if turn == turns or (gram is not None and settled(gram, image, min(rank, width), tol)):
            turns = turn
        values, vectors = np.linalg.eigh(image)
        turned = np.where(values > 1e-14 * values[-1], vectors / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        old, v = v, materialise(_mixed(v, "genome", "v", turned), "start")
        discard(old)
        u = materialise(_mixed(_crossed(p, v, "gene", "genome", width, genomes), "gene", "x", np.eye(width)), "start")
        gram = _gram(u, width)
        if turn == turns:
            break
        old, v = v, materialise(_mixed(_crossed(p, u, "genome", "gene", width, genes), "genome", "x", np.eye(width)), "start")
        discard(old)
        discard(u)
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    good = [k for k in range(min(rank, width)) if values[k] > 1e-14 * values[0]]
    sigma = np.sqrt(values[good])
    a, b = _mixed(u, "gene", "v", vectors[:, good] / sigma), _mixed(v, "genome", "v", vectors[:, good])
    norms = {}
    for side, df in (("a", a), ("b", b)):
        parts = [F.sum(F.pow(F.greatest(F.lit(float(sign)) * F.col(f"v{k}"), F.lit(0.0)), F.lit(2.0))) for k in range(len(good)) for sign in (1, -1)]
        norms[side] = np.sqrt(np.array(df.agg(F.array(*parts).alias("n")).first()["n"], float).reshape(-1, 2))
    small = 1e-6 * p.count() / (genes * genomes)

    def made(df: DataFrame, key: str, side: str) -> DataFrame:
        out = []
        for k in range(rank):
            if k >= len(good):
                out.append(F.lit(small).alias(f"v{k}"))
                continue
            each = norms["a"][k] * norms["b"][k]
            at = int(np.argmax(each))
            if k == 0:
                value = F.abs(F.col("v0")) * float(np.sqrt(sigma[0]))
            elif each[at]:
                value = F.greatest(F.lit(1.0 - 2 * at) * F.col(f"v{k}"), F.lit(0.0)) * float(np.sqrt(sigma[k] * each[at]) / norms[side][k][at])
            else:
                value = F.lit(small)
            out.append(value.alias(f"v{k}"))
        return materialise(df.select(key, *out), "factor")

    w, h = made(a, "gene", "a"), made(b, "genome", "b")
    discard(u)
    discard(v)
    return w, h


def factorise_large(p: DataFrame, rank: int, iterations: int = 10_000, seed: int = 1, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """The fit of :func:`presencia.kernels.factor.nmf` with both factors as tables, for any size.

    Start, coordinate descent and order of components are as there: given the other factor, a row's descent needs only
    its sums over present cells and the rank x rank product, so a half iteration joins the presence with one factor, sums
    vectors per row of the other, combined map-side, and descends row by row.  It stops when the projected gradient falls
    to ``tol`` of its first value or to rounding (1e-12 of the sums), or after ``iterations``.  The smaller factor is broadcast if it is
    under MAX_FACTOR values.  Factors are written between half iterations, so lineage stays short, and dropped when replaced.
    """
    cols = [f"v{k}" for k in range(rank)]
    p = materialise(p.select("gene", "genome").distinct(), "presence")
    genes, genomes = shape(p)
    long = lambda df, key, x, order: df.select(F.lit(rank).alias("rank"), key, F.posexplode(F.array(*[cols[k] for k in order])).alias("component", x))
    if not genes:
        none = [F.lit(0.0).alias(c) for c in cols]
        return long(p.select("gene", *none), "gene", "w", range(rank)), long(p.select("genome", *none), "genome", "h", range(rank))
    w, h = _start(p, rank, genes, genomes, seed)

    def step(own: DataFrame, other: DataFrame, key: str, by: str, n_other: int) -> tuple[DataFrame, float, float]:
        """The new factor, its projected gradient and the size of its sums."""
        gram = _gram(other, rank)

        def descend(batches):
            for rows in batches:
                a, cross = rows[cols].to_numpy(float), rows[[f"x{k}" for k in range(rank)]].to_numpy(float)
                moved = np.zeros(len(a))
                for k in range(rank):
                    grad = a @ gram[:, k] - cross[:, k]
                    moved += np.abs(np.where(a[:, k] == 0, np.minimum(grad, 0), grad))
                    if gram[k, k] > 0:
                        a[:, k] = np.maximum(a[:, k] - grad / gram[k, k], 0)
                yield pd.DataFrame({key: rows[key], **{c: a[:, k] for k, c in enumerate(cols)}, "moved": moved, "sums": cross.sum(1)})

        rows = own.select(key, *cols).join(_crossed(p, other, key, by, rank, n_other), key)
        made = materialise(rows.mapInPandas(descend, f"{key} string, {', '.join(f'{c} double' for c in cols)}, moved double, sums double"), "factor")
        r = made.agg(F.sum("moved").alias("moved"), F.sum("sums").alias("sums")).first()
        discard(own)
        return made, r["moved"], r["sums"]

    first = None
    for _ in range(iterations):
        w, moved_w, sums_w = step(w, h, "gene", "genome", genomes)
        h, moved_h, sums_h = step(h, w, "genome", "gene", genes)
        moved = moved_w + moved_h
        first = moved if first is None else first
        if moved <= max(tol * first, 1e-12 * (sums_w + sums_h)):
            break
    total = lambda df: np.array(df.agg(F.array(*[F.sum(c) for c in cols]).alias("t")).first()["t"], float)
    order = [int(k) for k in np.argsort(-total(w) * total(h), kind="stable")]
    return long(w, "gene", "w", order), long(h, "genome", "h", order)


def normalised(w: DataFrame, h: DataFrame, prob: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """w / q and h * q with q the component's ``prob`` quantile of w; q = 0 leaves w at 0 and takes h to 0.

    The quantile is exact over the genes of one component, whose distinct weights its aggregation holds.
    """
    q = w.groupBy("rank", "component").agg(F.percentile("w", F.lit(prob)).alias("q"))  # a row per component
    scaled = w.join(q, ["rank", "component"]).withColumn("w", F.when(F.col("q") > 0, F.col("w") / F.col("q")).otherwise(0.0))
    return scaled.select("rank", "gene", "component", "w"), h.join(q, ["rank", "component"]).select("rank", "genome", "component", (F.col("h") * F.col("q")).alias("h"))


def binarised(df: DataFrame, key: str, value: str, groups: tuple[str, ...] = ("rank", "component")) -> DataFrame:
    """``rank, component, key, value, cluster, top``: optimal 3-means of each component's values; top is its highest cluster.

    A task holds one component's values.  Null values are in no cluster and left out.
    """
    fields = [df.schema[g] for g in groups] + [df.schema[key], df.schema[value]]
    out = T.StructType([*fields, T.StructField("cluster", T.IntegerType()), T.StructField("top", T.BooleanType())])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        labels = kmeans_1d(rows[value].to_numpy(float), 3)
        return rows.assign(cluster=labels.astype(np.int32), top=labels == labels.max(initial=0))[[f.name for f in out.fields]]

    return df.where(F.col(value).isNotNull()).select(*groups, key, value).groupBy(*groups).applyInPandas(fit, out)


def thresholds(marked: DataFrame, value: str, groups: tuple[str, ...] = ("rank", "component")) -> DataFrame:
    """The least value still in the top cluster of each component."""
    return marked.where("top").groupBy(*groups).agg(F.min(value).alias("threshold"))


def reconstruction(l_bin: DataFrame, a_bin: DataFrame) -> DataFrame:
    """``rank, gene, genome, n``: the number of components that hold both, where there is one."""
    joined = l_bin.select("rank", "component", "gene").join(a_bin.select("rank", "component", "genome"), ["rank", "component"])
    return joined.groupBy("rank", "gene", "genome").agg(F.count(F.lit(1)).alias("n"))


def _for_ranks(p: DataFrame, ranks: list[int]) -> DataFrame:
    """The presence once for each rank, a constant list."""
    return p.select(F.explode(F.array(*[F.lit(r) for r in ranks]) if ranks else F.expr("cast(array() as array<int>)")).alias("rank"), "gene", "genome")


def reconstruction_error(p: DataFrame, made: DataFrame, ranks: list[int]) -> DataFrame:
    """``rank, gene, genome, error``: presence minus count where that is not 0."""
    cells = made.select("rank", "gene", "genome", (-F.col("n")).alias("e")).unionByName(
        _for_ranks(p, ranks).withColumn("e", F.lit(1).cast("bigint"))
    )
    return cells.groupBy("rank", "gene", "genome").agg(F.sum("e").alias("error")).where("error <> 0")


def confusion(p: DataFrame, l_bin: DataFrame, a_bin: DataFrame, ranks: list[int], n_genes: int, n_genomes: int) -> DataFrame:
    """``rank, tp, fn, fp, tn`` of the reconstruction being above 0.

    Genes collapse to classes of equal sets of components, genomes likewise; the cells made are counted over pairs of classes with a
    common component, and only the present cells are looked at one by one.  The product of genes and genomes is never made.
    """
    held = lambda df, key, name: materialise(df.groupBy("rank", key).agg(F.array_sort(F.collect_set("component")).alias(name)), name)
    of_gene, of_genome = held(l_bin, "gene", "l_set"), held(a_bin, "genome", "a_set")
    classes = lambda df, name, n: df.groupBy("rank", name).agg(F.count(F.lit(1)).alias(n)).withColumn("component", F.explode(name))
    pairs = classes(of_gene, "l_set", "n_l").join(classes(of_genome, "a_set", "n_a"), ["rank", "component"]).select("rank", "l_set", "a_set", "n_l", "n_a").distinct()
    made = pairs.groupBy("rank").agg(F.sum(F.col("n_l") * F.col("n_a")).alias("made"))
    cells = _for_ranks(p, ranks)
    real = cells.groupBy("rank").agg(F.count(F.lit(1)).alias("real"))
    both = cells.join(of_gene, ["rank", "gene"]).join(of_genome, ["rank", "genome"]).where(F.arrays_overlap("l_set", "a_set"))
    both = both.groupBy("rank").agg(F.count(F.lit(1)).alias("tp"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("tp", "real", "made")}
    counts = real.join(made, "rank", "full").join(both, "rank", "left").withColumns(zero)
    counts = counts.select("rank", "tp", (F.col("real") - F.col("tp")).alias("fn"), (F.col("made") - F.col("tp")).alias("fp"))
    return counts.withColumn("tn", F.lit(n_genes * n_genomes) - F.col("tp") - F.col("fn") - F.col("fp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def metrics(counts: DataFrame, n_genes: int, n_genomes: int) -> DataFrame:
    """Thirteen scores of each rank from its confusion counts, 0 where a denominator is 0."""
    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))
    total = tp + fn + fp + tn
    out = counts.select(
        "rank", "tp", "fn", "fp", "tn",
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(fp, fp + tn).alias("fpr"),
        _ratio(fn, tp + fn).alias("fnr"), _ratio(tn, tn + fp).alias("specificity"), _ratio(tp + fn, total).alias("prevalence"),
        _ratio(tp + tn, total).alias("accuracy"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp, tp + fp + fn).alias("jaccard"),
        _ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)).alias("mcc"),
    )
    bm = F.col("recall") + F.col("specificity") - 1
    threshold = _ratio(F.sqrt(F.col("recall") * (1 - F.col("specificity"))) + F.col("specificity") - 1, bm)
    k = F.col("rank") * (n_genes + n_genomes)
    aic = 2 * k + 2 * (1 - F.col("jaccard")) * F.lit(float(n_genes * n_genomes))
    return out.withColumns({"bm": bm, "prevalence_threshold": threshold, "aic": aic})


def best_rank(scores: DataFrame, metric: str, lowest: bool = False) -> DataFrame:
    """``lower, best, higher``: the rank with the best score (ties: the smallest) and its neighbours, null at the ends."""
    order = Window.orderBy("rank")  # a row per rank
    near = scores.select("rank", F.col(metric).alias("m"), F.lag("rank").over(order).alias("lower"), F.lead("rank").over(order).alias("higher"))
    by = F.struct(F.col("m") if lowest else -F.col("m"), "rank")
    return near.agg(F.min_by(F.struct("lower", F.col("rank").alias("best"), "higher"), by).alias("b")).select("b.*")


def refined_ranks(lower: int | None, best: int, higher: int | None, known: list[int]) -> list[int]:
    """New ranks between the best one and its neighbours: all within 5, else five evenly spread; none beyond a missing neighbour."""
    out: list[int] = []
    for a, b in ((lower, best), (best, higher)):
        if a is None or b is None:
            continue
        between = range(a, b) if b - a < 5 else np.linspace(a, b, 5).astype(int).tolist()
        out += sorted(set(between) - set(known))
    return out


def ranks_around(scores: DataFrame, metric: str, reach: int = 3) -> DataFrame:
    """The ranks within ``reach`` of the one with the lowest score, from 1."""
    best = scores.agg(F.min_by("rank", F.struct(metric, "rank")).alias("b"))
    return best.select(F.explode(F.sequence(F.greatest(F.col("b") - reach, F.lit(1)), F.col("b") + reach)).alias("rank"))


def mca(p: DataFrame) -> DataFrame:
    """``component, inertia, share, cumulative`` of multiple correspondence analysis over genes with genomes as questions.

    All components, by a whole decomposition in one task (:func:`sets.inertias`); :func:`mca_leading` finds a few in little memory.
    """
    values = inertias(p.sparkSession, sets_of(p))
    share = values / values.sum() if values.sum() else values
    table = [(i + 1, float(v), float(s), float(c)) for i, (v, s, c) in enumerate(zip(values, share, np.cumsum(share), strict=True))]
    return p.sparkSession.createDataFrame(table, "component int, inertia double, share double, cumulative double")


def mca_leading(p: DataFrame, k: int = 10, iterations: int = 200, seed: int = 1, tol: float = 1e-5) -> DataFrame:
    """``component, inertia`` of the ``k`` leading components for any number of genomes, by subspace iteration.

    The standardised residuals S of the indicator table are never made: S v and S'u are sums over present cells plus
    terms of the margins, so an iteration is two joins with map-side-combined sums; k x k products are one-row
    aggregates.  EXTRA more vectors are carried along.  It stops when the residuals of the ``k`` leading components are at
    most ``tol`` of the first inertia (the inertias' own errors are far smaller), or after ``iterations``.
    """
    p = materialise(p.select("gene", "genome").distinct(), "presence")
    m, n = shape(p)
    asked, k = min(k, n), min(k + EXTRA, n)
    if not asked:
        return p.sparkSession.createDataFrame([], "component int, inertia double")
    cols = range(k)
    start = [(F.xxhash64(F.lit(seed), "genome", F.lit(x)) % 1000 / 1000.0).alias(x) for x in [f"a{i}" for i in cols] + [f"b{i}" for i in cols]]
    v = p.groupBy("genome").agg(F.count(F.lit(1)).alias("c")).select("genome", (F.col("c") / (m * n)).alias("y"), ((m - F.col("c")) / (m * n)).alias("o"), *start)
    per = lambda x, mass: F.when(F.col(mass) > 1e-15, x / F.sqrt(mass)).otherwise(0.0)

    def product(rows: DataFrame, parts: tuple[str, ...]) -> np.ndarray:
        cells = [F.sum(sum((F.col(f"{s}{i}") * F.col(f"{s}{j}") for s in parts), F.lit(0.0))) for i in cols for j in cols]
        return np.array(rows.agg(F.array(*cells).alias("g")).first()["g"], float).reshape(k, k)

    gram = None
    for turn in range(iterations + 1):
        image = product(v, ("a", "b"))
        if gram is not None and settled(gram, image, asked, tol):
            break
        # an orthonormal basis of the current vectors
        values, vectors = np.linalg.eigh(image)
        turned = vectors / np.sqrt(np.maximum(values, 1e-18))
        mixed = lambda s, j: sum((F.col(f"{s}{i}") * float(turned[i, j]) for i in cols), F.lit(0.0)).alias(f"{s}{j}")  # noqa: E731,B023
        v = materialise(v.select("genome", "y", "o", *[mixed(s, j) for s in "ab" for j in cols]), "basis")
        alpha = [per(F.col(f"a{i}"), "y") for i in cols]
        beta = [per(F.col(f"b{i}"), "o") for i in cols]
        margin = v.agg(F.array(*[F.sum(b) for b in beta]).alias("b"), F.array(*[F.sum((F.col("y") * x + F.col("o") * z) / m) for x, z in zip(alpha, beta, strict=True)]).alias("k")).first()
        diff = v.select("genome", *[(x - z).alias(f"d{i}") for i, (x, z) in enumerate(zip(alpha, beta, strict=True))])
        u = p.join(diff, "genome").groupBy("gene").agg(*[(m**0.5 * ((F.sum(f"d{i}") + margin["b"][i]) / (m * n) - margin["k"][i])).alias(f"u{i}") for i in cols])
        u = materialise(u, "genes")
        gram = product(u, ("u",))
        if turn == iterations:
            break
        total = u.agg(F.array(*[F.sum(f"u{i}") for i in cols]).alias("t")).first()["t"]
        sums = p.join(u, "gene").groupBy("genome").agg(*[F.sum(f"u{i}").alias(f"s{i}") for i in cols])
        back = lambda own, mass, i: per(m**0.5 * (own / (m * n) - F.col(mass) * total[i] / m), mass)  # noqa: E731,B023
        made = [back(F.col(f"s{i}"), "y", i).alias(f"a{i}") for i in cols] + [back(total[i] - F.col(f"s{i}"), "o", i).alias(f"b{i}") for i in cols]
        v = materialise(v.select("genome", "y", "o").join(sums, "genome").select("genome", "y", "o", *made), "vectors")
    inertia = np.linalg.eigvalsh(gram)[::-1][:asked]
    return p.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(inertia)], "component int, inertia double")


def ranks_from_inertia(inertia: DataFrame, extra: list[int], shares: tuple[float, ...] = (0.7, 0.75, 0.8, 0.85, 0.9)) -> DataFrame:
    """2, ``extra`` and the first component at which each cumulative share is reached, distinct and sorted."""
    first = F.array(F.lit(2), *[F.lit(r) for r in extra], *[F.min(F.when(F.col("cumulative") >= s, F.col("component"))) for s in shares])
    return inertia.agg(first.alias("r")).select(F.explode(F.array_sort(F.array_distinct(F.filter("r", lambda x: x.isNotNull())))).alias("rank"))


def bi_modal(df: DataFrame, value: str, tol: float = 1e-3, max_iter: int = 100) -> DataFrame:
    """``component, weight, mean, deviation`` of a mixture of two normals fitted to a column, by rising mean.

    Expectation maximisation from the groups of 2-means (from a cut at the mean), until the mean log likelihood moves by less than
    ``tol``; variances are raised by 1e-6.  Values are counted once, a step is a one-row aggregate over the distinct
    ones.  Nulls and NaN are left out; fewer than two distinct values raise.
    """
    x = F.col(value).cast("double")
    counts = materialise(df.select(x.alias("x")).where("x is not null and not isnan(x)").groupBy("x").agg(F.count(F.lit(1)).alias("c")), "values")
    r = counts.agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("n"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("m")).first()
    if r["d"] < 2:
        raise ValueError("fewer than two distinct values")
    n, middle = r["n"], r["m"]
    y = F.col("x") - F.lit(middle)

    def sums(high: Column, like: Column) -> tuple[np.ndarray, float]:
        """Weight, sum and sum of squares of both components, where ``high`` is the upper one's part; the mean of ``like``."""
        parts = [F.sum(F.col("c") * p * F.pow(y, F.lit(float(k)))) for p in (1 - high, high) for k in range(3)]
        out = counts.agg(F.array(*parts, F.sum(F.col("c") * like)).alias("s")).first()["s"]
        return np.array(out[:6], float).reshape(2, 3), out[6] / n

    cut, new = None, 0.0
    while new != cut:  # 2-means lowers its cost with each new cut, so it ends
        cut = new
        s, _ = sums(F.when(y > F.lit(cut), 1.0).otherwise(0.0), F.lit(0.0))
        new = float((s[:, 1] / s[:, 0]).mean())
    before = -np.inf
    for _ in range(max_iter):
        size = s[:, 0] + 1e-15
        mean = s[:, 1] / size
        var = np.maximum(s[:, 2] / size - mean**2, 0) + 1e-6
        low, high = (F.lit(float(np.log(size[k] / n) - np.log(2 * np.pi * var[k]) / 2)) - F.pow(y - F.lit(float(mean[k])), F.lit(2.0)) / float(2 * var[k]) for k in (0, 1))
        top = F.greatest(low, high)
        like = top + F.log(F.exp(low - top) + F.exp(high - top))
        s, mean_like = sums(F.exp(high - like), like)
        if abs(mean_like - before) < tol:
            break
        before = mean_like
    size = s[:, 0] + 1e-15
    mean = s[:, 1] / size
    deviation = np.sqrt(np.maximum(s[:, 2] / size - mean**2, 0) + 1e-6)
    rows = [(i, float(size[k] / n), float(mean[k] + middle), float(deviation[k])) for i, k in enumerate(np.argsort(mean))]
    return df.sparkSession.createDataFrame(rows, "component int, weight double, mean double, deviation double")


# --- affinities of new genomes ----------------------------------------------------


def affinities(l_norm: DataFrame, p_new: DataFrame) -> DataFrame:
    """``genome, component, affinity``: non-negative least squares of each genome's genes on the weights (gene, component, w).

    The normal equations need only the weights' rank x rank product and, per genome, the sum of its genes' weights: one
    join and aggregation; the active-set solver then sees a vector per genome.  Genes without weights are
    left out; a genome without known genes gets zeros.
    """
    n = int(l_norm.agg(F.max("component").alias("k")).first()["k"]) + 1
    vectors = l_norm.groupBy("gene").agg(*[F.coalesce(F.sum(F.when(F.col("component") == k, F.col("w"))), F.lit(0.0)).alias(f"v{k}") for k in range(n)])
    vectors = materialise(vectors, "weights")
    gram = _gram(vectors, n)
    genomes = p_new.select("genome").distinct()
    sums = p_new.select("gene", "genome").distinct().join(vectors, "gene").groupBy("genome").agg(F.array(*[F.sum(f"v{k}") for k in range(n)]).alias("cross"))
    rows = genomes.join(sums, "genome", "left")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(cross: pd.Series) -> pd.Series:
        return cross.map(lambda c: nnls(gram, np.zeros(n) if c is None else np.asarray(c, float)).tolist())

    return rows.select("genome", F.posexplode(solve("cross")).alias("component", "affinity"))


def nearest_vote(near: DataFrame, k: int = 5) -> DataFrame:
    """``sample, cluster, distance``: the commonest cluster of the k nearest genomes and their mean distance.

    From (sample, genome, distance, cluster), nearest by distance then genome; of equally common clusters the
    one with the nearer member.
    """
    rank = F.row_number().over(Window.partitionBy("sample").orderBy("distance", "genome"))
    top = near.withColumn("r", rank).where(F.col("r") <= k)
    votes = top.groupBy("sample", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r"))
    chosen = votes.groupBy("sample").agg(F.min_by("cluster", F.struct((-F.col("n")).alias("n"), "r")).alias("cluster"))
    return chosen.join(top.groupBy("sample").agg(F.avg("distance").alias("distance")), "sample")
