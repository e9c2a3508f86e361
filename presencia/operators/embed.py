"""Maps of genomes by their genes, and density clusters on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.kernels import clustering, embedding
from presencia.operators import sets
from presencia.session import materialise

#: Points of density models: kernels hold their square in one task.
MAX_POINTS = 5000


def neighbours(shape: tuple[int, int], asked: int | None = None) -> int:
    """The number of neighbours: as asked, at most half the smaller side; else 1 % of it; 2 at least."""
    smaller = min(shape)
    if asked is not None and asked > 0.5 * smaller:
        raise ValueError("more neighbours than half the smaller side")
    return max(2, int(asked if asked is not None else 0.01 * smaller))


def genome_map(p: DataFrame, n_neighbors: int | None = None, seed: int = 42) -> DataFrame:
    """``genome, x, y, z`` of a density-preserving embedding by cosine distance of gene content.

    Tasks find each genome's neighbours; one task lays out the graph of these, whose size is the genomes times the neighbours.
    """
    spark, own = p.sparkSession, sets.sets_of(p)
    k = min(neighbours((max(own.n_genes, 4), max(own.n, 4)), n_neighbors), max(own.n - 1, 1))
    if own.n < 5:  # too few for three coordinates
        return spark.createDataFrame([(str(g), 0.0, 0.0, 0.0) for g in own.ids], "genome string, x double, y double, z double")
    near = materialise(sets.nearest(spark, own, k), "neighbours")
    files, ids = near.inputFiles(), own.ids

    def lay_out(_: int):
        rows = sets.stored(files, ["i", "near", "dist"])
        order = np.argsort(rows["i"].to_numpy())
        at, dist = (np.vstack(rows[c].to_numpy())[order] for c in ("near", "dist"))
        y = embedding.of_neighbours(at, dist, seed=seed)
        yield pa.record_batch([pa.array(ids, pa.string()), *[pa.array(y[:, c]) for c in range(3)]], ["genome", *"xyz"])

    return materialise(sets.tasks(spark, lay_out, 1, "genome string, x double, y double, z double"), "map")


def set_distances(p: DataFrame, digits: int | None = None) -> DataFrame:
    """``a < b, distance``: 1 - |common| / |union| of the gene sets of all pairs of genomes, made where they are read; none is shuffled."""
    return sets.distances(p.sparkSession, sets.sets_of(p), digits)


def gram(p: DataFrame, ids: list[str], parts: int = 16) -> np.ndarray:
    """Genes shared by each pair of the given genomes, an exact matrix on the driver.

    Tasks sum dense products of a few hundred genes at a time; their matrices are added row by row.
    """
    n, spark = len(ids), p.sparkSession
    if not n:
        return np.zeros((0, 0))
    index = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "i int, genome string"))  # at most MAX_POINTS rows
    rows = p.join(index, "genome").groupBy("gene").agg(F.collect_set("i").alias("at")).repartition(parts)  # lists of at most MAX_POINTS numbers

    def products(batches):
        total = np.zeros((n, n), np.float32)
        for batch in batches:
            for start in range(0, len(batch), 256):
                lists = batch["at"].iloc[start : start + 256]
                x = np.zeros((len(lists), n), np.float32)
                for k, at in enumerate(lists):
                    x[k, at] = 1
                total = total + x.T @ x if total.max(initial=0) < 2**23 else (total.astype(np.float64) + x.T @ x)
        if total.any():
            for start in range(0, n, 64):
                yield pd.DataFrame({"i": np.arange(start, min(start + 64, n)), "row": list(total[start : start + 64].astype(np.int64))})

    summed = F.aggregate(F.collect_list("row"), F.array_repeat(F.lit(0).cast("bigint"), n), lambda acc, r: F.zip_with(acc, r, lambda a, b: a + b))
    out = np.zeros((n, n))
    for r in rows.mapInPandas(products, "i int, row array<bigint>").groupBy("i").agg(summed.alias("row")).toLocalIterator():
        out[r["i"]] = r["row"]
    return out


def density_models(points: DataFrame, key: str, columns: list[str], max_range: int | None = None) -> DataFrame:
    """``min_cluster_size, min_samples, relative_validity, silhouette, labels`` of a 5 x 5 grid, a task per model.

    Sizes run from 5 to ``max_range`` (100 if absent or less).  The silhouette is -1 unless there are two labels, noise
    counting as one, and more than half of the points are no noise.  ``labels`` follows the keys in order.
    """
    top = max_range if max_range and max_range >= 100 else 100
    if points.limit(MAX_POINTS + 1).count() > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points")
    sizes = F.array(*[F.lit(int(v)) for v in np.linspace(5, top, 5).astype(int)])
    grid = points.withColumn("min_cluster_size", F.explode(sizes)).withColumn("min_samples", F.explode(sizes))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        size, samples = int(rows["min_cluster_size"].iloc[0]), int(rows["min_samples"].iloc[0])
        x = rows[columns].to_numpy(float)
        labels, validity = clustering.hdbscan(x, size, samples)
        good = len(set(labels)) > 1 and (labels != -1).mean() > 0.5
        score = clustering.silhouette(x, labels) if good else -1.0
        return pd.DataFrame({"min_cluster_size": [size], "min_samples": [samples], "relative_validity": [validity], "silhouette": [score], "labels": [labels.tolist()]})

    schema = "min_cluster_size int, min_samples int, relative_validity double, silhouette double, labels array<int>"
    return grid.groupBy("min_cluster_size", "min_samples").applyInPandas(fit, schema)


def density_clusters(points: DataFrame, key: str, columns: list[str], max_range: int | None = None) -> DataFrame:
    """``key, label`` of the model with the best relative validity among those with a silhouette; no row if there is none."""
    models = materialise(density_models(points, key, columns, max_range), "models")
    best = models.where("silhouette > -1").agg(F.max_by("labels", F.struct("relative_validity", -F.col("min_cluster_size"), -F.col("min_samples"))).alias("labels")).first()["labels"]
    keys = [r[0] for r in points.select(key).orderBy(key).collect()]  # at most MAX_POINTS
    kind = points.schema[key].dataType.simpleString()
    return points.sparkSession.createDataFrame(list(zip(keys, best or [], strict=False)), f"{key} {kind}, label int")
