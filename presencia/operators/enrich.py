"""Which functions are over-represented among the genes of each component.

Weights are (gene, component, w), functions (gene, function); a gene is in a component above a cutoff of its weight.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presencia.functions import names


@cache
def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def hypergeometric_tail(n_all: int, n_function: int, n_component: int, k: int) -> float:
    """P(X >= k) for n_component draws from n_all with n_function marked; 1 for k <= 0, 0 beyond what is possible."""
    if k <= max(0, n_component + n_function - n_all):
        return 1.0
    top = min(n_function, n_component)
    if k > top:
        return 0.0
    f = _log_factorials(max(n_all, n_function, n_component))
    i = np.arange(k, top + 1)
    rest = n_all - n_function - n_component + i
    logs = f[n_function] - f[i] - f[n_function - i] + f[n_all - n_function] - f[n_component - i] - f[rest] - f[n_all] + f[n_component] + f[n_all - n_component]
    peak = logs.max()
    return float(min(1.0, np.exp(peak) * np.exp(logs - peak).sum()))


@F.pandas_udf(T.DoubleType())
def _tail(n_all: pd.Series, n_function: pd.Series, n_component: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_tail(*map(int, r)) for r in zip(n_all, n_function, n_component, k, strict=True)])


def exploded_functions(df: DataFrame, column: str = "go", delimiter: str = ", ") -> DataFrame:
    """A row per function of a delimited field; a null field stays one row with null."""
    return df.withColumn(column, F.explode_outer(F.split(column, f"\\Q{delimiter}\\E")))


def frequent_functions(functions: DataFrame, more_than: int = 3) -> DataFrame:
    """``function, n``: functions of more genes than that."""
    return functions.groupBy("function").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def enrichment(weights: DataFrame, functions: DataFrame, products: DataFrame | None = None, cutoff: float = 0.0) -> DataFrame:
    """``component, function, n_all, n_function, n_component, overlap, p_value, logp`` for every pair that shares a gene.

    n_all: distinct genes with a function row; n_function: the function's rows, repeated ones counted as delivered; n_component:
    the component's genes above the cutoff; overlap: distinct genes in both.  Pairs without a shared gene have p = 1 and no
    row, so nothing is crossed.  With ``products`` (gene, product) the shared genes' products are added, joined by ``; `` in order
    of gene and product.  Null genes and functions do not count.
    """
    functions = functions.select("gene", "function").where("gene is not null")
    inside = weights.where(F.col("w") > cutoff).select("gene", "component").distinct()
    n_all = functions.agg(F.countDistinct("gene").alias("n")).first()["n"]
    listed = functions.where("function is not null")
    n_function = listed.groupBy("function").agg(F.count(F.lit(1)).alias("n_function"))
    n_component = inside.groupBy("component").agg(F.count(F.lit(1)).alias("n_component"))
    met = inside.join(listed.distinct(), "gene")
    found = met.groupBy("component", "function").agg(F.count(F.lit(1)).alias("overlap")).join(n_function, "function").join(n_component, "component")
    tail = _tail(F.lit(n_all), F.least("n_function", F.lit(n_all)), F.least("n_component", F.lit(n_all)), "overlap")
    out = found.select("component", "function", F.lit(n_all).cast("bigint").alias("n_all"), "n_function", "n_component", "overlap", tail.alias("p_value"))
    out = out.withColumn("logp", -F.log10("p_value"))
    if products is None:
        return out
    named = met.join(products.select("gene", "product").where("product is not null"), "gene")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gene", "product"))), lambda s: s["product"]), "; ")
    return out.join(named.groupBy("component", "function").agg(text.alias("products")), ["component", "function"], "left")


def named_functions(found: DataFrame, terms: DataFrame) -> DataFrame:
    """With the function's name from (function, name); a term without one goes by itself."""
    return found.join(terms.select("function", "name"), "function", "left").withColumn("name", F.coalesce("name", "function"))


def significant(found: DataFrame, below: float = 0.05, leave_out: tuple[str, ...] = ("SO:0001217",)) -> DataFrame:
    """Pairs with p below the limit, without some functions."""
    return found.where((F.col("p_value") < below) & ~F.col("function").isin(*leave_out))


def component_by_function(found: DataFrame, functions: list[str], value: str = "p_value") -> DataFrame:
    """A wide table of mean values, for export of chosen functions."""
    return found.groupBy("component").pivot("function", functions).agg(F.avg(value))


def component_words(weights: DataFrame, products: DataFrame, cutoff: float = 0.0) -> DataFrame:
    """``component, word, n`` of the product texts of each component's genes."""
    inside = weights.where(F.col("w") > cutoff).select("gene", "component").distinct()
    words = inside.join(products.select("gene", names.product_words(F.col("product")).alias("words")), "gene")
    return words.select("component", F.explode("words").alias("word")).groupBy("component", "word").agg(F.count(F.lit(1)).alias("n"))


def exclusive_genes(l_bin: DataFrame) -> DataFrame:
    """``component, gene``: genes in exactly one component."""
    one = l_bin.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.first("component").alias("component"))
    return one.where("n = 1").select("component", "gene")


def active_histogram(l_bin: DataFrame, genes: DataFrame) -> DataFrame:
    """``n_active, n_genes, cumulative``: genes by their number of components, 0 included."""
    n = genes.select("gene").distinct().join(l_bin.groupBy("gene").agg(F.count(F.lit(1)).alias("n")), "gene", "left")
    counts = n.groupBy(F.coalesce("n", F.lit(0)).alias("n_active")).agg(F.count(F.lit(1)).alias("n_genes"))
    from pyspark.sql.window import Window

    return counts.withColumn("cumulative", F.sum("n_genes").over(Window.orderBy("n_active").rowsBetween(Window.unboundedPreceding, 0)))


def frequency_regression(freq: DataFrame, l_bin: DataFrame) -> DataFrame:
    """``slope, intercept, r2`` of the genes' numbers of components on their frequencies."""
    n = freq.join(l_bin.groupBy("gene").agg(F.count(F.lit(1)).alias("n")), "gene", "left").select("freq", F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.regr_slope("n", "freq").alias("slope"), F.regr_intercept("n", "freq").alias("intercept"), F.regr_r2("n", "freq").alias("r2"))


def gene_order(l_bin: DataFrame, genes: DataFrame, components: list) -> DataFrame:
    """``gene, n_active, component_rank``, the sort key of a heat map: no component first, then single ones in the components' order, then more.

    Genes of several components sort by their whole set of components.
    """
    at = F.array_position(F.array(*[F.lit(p) for p in components]), F.col("component"))
    sets = l_bin.groupBy("gene").agg(F.count(F.lit(1)).cast("int").alias("n_active"), F.array_sort(F.collect_list(at)).alias("ranks"))
    rows = genes.select("gene").distinct().join(sets, "gene", "left")
    return rows.select("gene", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce(F.array_join("ranks", ","), F.lit("")).alias("component_rank"))


def strain_order(a_bin: DataFrame, genomes: DataFrame, components: list[str]) -> DataFrame:
    """``genome, position``: genomes without a component, then by their first component in order with single ones before others.

    Components whose names hold ``unchar`` come last.
    """
    from pyspark.sql.window import Window

    order = [p for p in components if "unchar" not in str(p)] + [p for p in components if "unchar" in str(p)]
    at = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("component"))
    sets = a_bin.groupBy("genome").agg(F.min(at).alias("r"), F.count(F.lit(1)).alias("n"))
    rows = genomes.select("genome").distinct().join(sets, "genome", "left")
    key = [F.coalesce("r", F.lit(0)), (F.coalesce("n", F.lit(0)) > 1), F.col("genome")]
    return rows.select("genome", F.row_number().over(Window.orderBy(*key)).alias("position"))  # a row per genome


def members_by(a: DataFrame, threshold: float, labels: DataFrame, label: str) -> DataFrame:
    """``component, label, n``: genomes at or above a threshold of affinity, counted by a label (null labels too)."""
    return a.where(F.col("h") >= threshold).join(labels, "genome", "left").groupBy("component", label).agg(F.count(F.lit(1)).alias("n"))
