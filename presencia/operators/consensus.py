"""Agreement of several factor models on which genomes belong together, and clusters of distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.kernels import clustering
from presencia.session import materialise

#: Leaves of a linkage, whose square the driver holds.
MAX_LEAVES = 5000


def top_component(h: DataFrame, model: str = "rank") -> DataFrame:
    """``model, genome, component``: each genome's strongest component, the first of equal ones (and where all are 0)."""
    return h.groupBy(F.col(model).alias("model"), "genome").agg(F.min_by("component", F.struct((-F.col("h")).alias("h"), "component")).alias("component"))


def label_classes(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genomes that all models put together as one class: (class, model, component) and (class, genome)."""
    words = labels.groupBy("genome").agg(F.array_sort(F.collect_list(F.struct("model", "component"))).alias("word"))
    classes = words.groupBy("word").agg(F.min("genome").alias("class"))
    members = words.join(classes, "word").select("class", "genome")
    return classes.select("class", F.inline("word")), members


def consensus(labels: DataFrame, n_models: int) -> DataFrame:
    """``class_1 < class_2, agreement``: the share of models in which the genomes of two classes are together.

    Equal genomes are one class (see :func:`label_classes`); pairs that never meet have no row.
    """
    words, _ = label_classes(labels)
    words = materialise(words, "words")
    a, b = (words.select("model", "component", F.col("class").alias(f"class_{i}")) for i in (1, 2))
    met = a.join(b, ["model", "component"]).where("class_1 < class_2")
    return met.groupBy("class_1", "class_2").agg((F.count(F.lit(1)) / n_models).alias("agreement"))


def dispersion(labels: DataFrame, n_models: int) -> DataFrame:
    """``dispersion``: the mean over all pairs of genomes, each with itself too, of 4 (agreement - 1/2)^2.

    Counted over classes weighted by their genomes; pairs that never meet add 1 each, as does a genome with itself; genomes
    of one class agree in the models that label them.
    """
    words, members = label_classes(labels)
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes.join(words.groupBy("class").agg((F.count(F.lit(1)) / n_models).alias("agreement")), "class"), "sizes")
    n = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    pairs = consensus(labels, n_models)
    s1, s2 = (sizes.select(F.col("class").alias(f"class_{i}"), F.col("n").alias(f"n_{i}")) for i in (1, 2))
    between = pairs.join(s1, "class_1").join(s2, "class_2").select((2 * F.col("n_1") * F.col("n_2")).alias("k"), "agreement")
    cells = between.unionByName(sizes.select((F.col("n") * (F.col("n") - 1)).alias("k"), "agreement"))
    lost = cells.agg(F.coalesce(F.sum(F.col("k") * (1 - 4 * F.pow(F.col("agreement") - 0.5, 2))), F.lit(0.0)).alias("lost"))
    return lost.select((1 - F.col("lost") / float(max(n, 1) ** 2)).alias("dispersion"))


def square(pairs: DataFrame, a: str, b: str, distance: str) -> tuple[list[str], np.ndarray]:
    """Leaves and their distances on the driver, at most MAX_LEAVES; absent pairs are at 0 from themselves and far apart else."""
    ids = [r[0] for r in pairs.select(F.explode(F.array(a, b)).alias("x")).distinct().orderBy("x").limit(MAX_LEAVES + 1).collect()]
    if len(ids) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    rows = pairs.select(a, b, distance).toPandas()  # at most MAX_LEAVES squared
    far = float(rows[distance].max()) if len(rows) else 0.0
    d = np.full((len(ids), len(ids)), far)
    np.fill_diagonal(d, 0)
    i, j = (np.searchsorted(ids, rows[c].to_numpy(dtype=str)) for c in (a, b))
    d[i, j] = rows[distance]
    d[j, i] = rows[distance]
    np.fill_diagonal(d, 0)
    return ids, d


def distance_clusters(pairs: DataFrame, a: str, b: str, distance: str, threshold: float = 0.1, min_size: int = 0) -> DataFrame:
    """``genome, cluster``: Ward clusters of a distance table cut at ``threshold`` times the largest distance.

    With ``min_size``, genomes of smaller clusters go and the rest is clustered again until nothing changes; the
    removed ones have a null cluster.
    """
    ids, d = square(pairs, a, b, distance)
    alive = np.arange(len(ids))
    while True:
        part = d[np.ix_(alive, alive)]
        labels = clustering.cut_tree(clustering.ward(part), threshold * part.max(initial=0)) if len(alive) > 1 else np.ones(len(alive), int)
        sizes = np.bincount(labels, minlength=1)
        keep = sizes[labels] >= min_size
        if keep.all():
            break
        alive = alive[keep]
    found = dict(zip(alive.tolist(), labels.tolist(), strict=True))
    return pairs.sparkSession.createDataFrame([(g, found.get(i)) for i, g in enumerate(ids)], "genome string, cluster int")


#: The thresholds that a sensitivity analysis tries.
THRESHOLDS = [*np.logspace(-3, -1, 10).tolist(), *np.linspace(0.1, 1, 19).tolist()]


def sensitivity(pairs: DataFrame, a: str, b: str, distance: str, thresholds: list[float] = THRESHOLDS) -> tuple[DataFrame, float]:
    """``threshold, num_clusters`` from one linkage cut at each, and the first threshold with the elbow's number of clusters."""
    _, d = square(pairs, a, b, distance)
    return sensitivity_of(pairs.sparkSession, clustering.ward(d), len(d), d.max(initial=0), thresholds)


def sensitivity_of(spark: SparkSession, links: np.ndarray, n: int, largest: float, thresholds: list[float] = THRESHOLDS) -> tuple[DataFrame, float]:
    """:func:`sensitivity` from the links of ``n`` leaves and their largest distance."""
    counts = [int(clustering.cut_tree(links, t * largest).max()) if n else 0 for t in thresholds]
    ordered = sorted(counts)
    elbow = ordered[clustering.elbow_index(np.array(ordered))]
    table = spark.createDataFrame(list(zip(thresholds, counts, strict=True)), "threshold double, num_clusters int")
    return table, thresholds[counts.index(elbow)]


def correlation_distance(pairs: DataFrame, a: str, b: str, distance: str) -> DataFrame:
    """``genome_1 < genome_2, distance``: 1 - Pearson correlation of the rows of the square distance table."""
    ids, d = square(pairs, a, b, distance)
    c = 1 - np.nan_to_num(np.corrcoef(d)) if len(ids) > 1 else np.zeros((len(ids), len(ids)))
    rows = [(ids[i], ids[j], float(c[i, j])) for i in range(len(ids)) for j in range(i + 1, len(ids))]
    return pairs.sparkSession.createDataFrame(rows, "genome_1 string, genome_2 string, distance double")


def cophenetic_correlation(pairs: DataFrame, a: str, b: str, distance: str) -> float | None:
    """The correlation of distances with the heights at which the Ward tree joins the leaves."""
    ids, d = square(pairs, a, b, distance)
    if len(ids) < 3:
        return None
    up = np.triu_indices(len(ids), 1)
    return float(np.corrcoef(clustering.cophenetic(clustering.ward(d))[up], d[up])[0, 1])


def without(pairs: DataFrame, a: str, b: str, removed: DataFrame) -> DataFrame:
    """Distances without those from or to some genomes (column genome)."""
    removed = materialise(removed.select("genome").distinct(), "removed")
    for c in (a, b):  # a row a genome, so that the pairs, their square, are not shuffled
        pairs = pairs.join(F.broadcast(removed.select(F.col("genome").alias(c))), c, "left_anti")
    return pairs


def near_references(pairs: DataFrame, a: str, b: str, distance: str, references: list[str], prob: float = 0.99) -> DataFrame:
    """Distances among genomes that are nearer to the references than a cutoff.

    The cutoff is the mean over references of the ``prob`` quantile of their distances; a genome stays if its
    least distance to a reference is strictly below.
    """
    both = pairs.select(a, b, distance).unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), distance)).distinct()
    to = both.where(F.col(a).isin(references))
    cutoff = to.groupBy(a).agg(F.percentile(distance, F.lit(prob)).alias("q")).agg(F.avg("q").alias("c")).first()["c"]
    kept = to.groupBy(F.col(b).alias("genome")).agg(F.min(distance).alias("d")).where(F.col("d") < F.lit(cutoff))
    for c in (a, b):
        pairs = pairs.join(kept.select(F.col("genome").alias(c)), c, "left_semi")
    return pairs


def tree(x: DataFrame, leaf: str, item: str) -> tuple[list[str], np.ndarray, DataFrame]:
    """Leaves, Ward links and ``cluster, leaf, size`` of a binary table by its leaves' item sets.

    Squared Euclidean distance between two sets is the size of their symmetric difference, from shared
    items per pair; leaves are few (components), at most MAX_LEAVES.
    """
    x = materialise(x.select(F.col(leaf).alias("leaf"), F.col(item).alias("item")).distinct(), "tree")
    sizes = {r["leaf"]: r["n"] for r in x.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).orderBy("leaf").limit(MAX_LEAVES + 1).collect()}
    if len(sizes) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    ids = sorted(sizes)
    a, b = (x.select("item", F.col("leaf").alias(c)) for c in "ab")
    shared = a.join(b, "item").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).toPandas()
    n = np.array([sizes[i] for i in ids], float)
    common = np.zeros((len(ids), len(ids)))
    at = {k: i for i, k in enumerate(ids)}
    for p, q, c in shared.itertuples(index=False):
        common[at[p], at[q]] = common[at[q], at[p]] = c
    d = np.sqrt(np.maximum(n[:, None] + n[None, :] - 2 * common, 0))
    np.fill_diagonal(d, 0)
    links = clustering.ward(d)
    groups = clustering.members(links)
    schema = x.select("leaf").schema
    kind = schema["leaf"].dataType.simpleString()
    table = x.sparkSession.createDataFrame([(c, ids[i], len(g)) for c, g in enumerate(groups) for i in g], f"cluster int, leaf {kind}, size int")
    return ids, links, table


def split_items(x: DataFrame, leaf: str, item: str, clusters: DataFrame) -> DataFrame:
    """``cluster, item`` with four flags: in all or any of the cluster's leaves, and in no other leaf.

    ``total`` (any), ``ubiquitous`` (all), ``exclusive`` (any and none outside), ``ubiquitous_exclusive``.  ``clusters`` is
    ``cluster, leaf, size``, a few rows per leaf.
    """
    x = x.select(F.col(leaf).alias("leaf"), F.col(item).alias("item")).distinct()
    overall = x.groupBy("item").agg(F.count(F.lit(1)).alias("everywhere"))
    inside = x.join(F.broadcast(clusters), "leaf").groupBy("cluster", "item", "size").agg(F.count(F.lit(1)).alias("n"))
    all_, only = F.col("n") == F.col("size"), F.col("n") == F.col("everywhere")
    return inside.join(overall, "item").select(
        "cluster", "item", F.lit(True).alias("total"), all_.alias("ubiquitous"), only.alias("exclusive"), (all_ & only).alias("ubiquitous_exclusive")
    )


def split_sizes(flags: DataFrame) -> DataFrame:
    """The numbers of items in each of the four sets of every cluster that has an item."""
    return flags.groupBy("cluster").agg(*[F.count_if(c).alias(f"{c}_items") for c in ("ubiquitous_exclusive", "exclusive", "total", "ubiquitous")])
