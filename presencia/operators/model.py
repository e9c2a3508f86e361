"""A presence table with its factor models: one object from table to scores, and the checks of a whole set of tables.

Steps are worked out when they are first asked for, written once, and kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presencia.operators import embed, factor
from presencia.operators import presence as pr
from presencia.session import materialise
from presencia.sources import tables as tb


def _only(df: DataFrame, key: str, other: DataFrame, what: str) -> None:
    strange = df.select(key).distinct().join(other.select(key).distinct(), key, "left_anti").limit(5).collect()
    if strange:
        raise ValueError(f"{what}: {[r[key] for r in strange]} are not in the presence table")


def check_columns(df: DataFrame, columns: tuple[str, ...], what: str) -> None:
    """Fail unless the table has these columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks {missing}")


def check_shape(p: DataFrame, genes: int, genomes: int) -> None:
    """Fail unless a presence table has so many genes and genomes."""
    if (found := factor.shape(p)) != (genes, genomes):
        raise ValueError(f"shape {found} is not {(genes, genomes)}")


def check_decomposition(p: DataFrame, w: DataFrame, h: DataFrame) -> None:
    """Fail unless weights and scores belong to the table's genes and genomes and have the same components at every rank."""
    check_columns(w, ("rank", "gene", "component", "w"), "weights")
    check_columns(h, ("rank", "genome", "component", "h"), "scores")
    _only(w, "gene", p, "weights")
    _only(h, "genome", p, "scores")
    own, others = (df.groupBy("rank").agg(F.array_sort(F.collect_set("component")).alias(name)) for df, name in ((w, "cw"), (h, "ch")))
    uneven = own.join(others, "rank", "full").where("not coalesce(cw = ch, false)").limit(5).collect()
    if uneven:
        raise ValueError(f"components differ at ranks {[r['rank'] for r in uneven]}")


@dataclass(frozen=True)
class FactorModel:
    """Factors of a presence table (gene, genome) at several ranks, and all that follows from them."""

    p: DataFrame
    ranks: tuple[int, ...]
    max_iter: int = 10_000
    metric: str = "aic"

    @cached_property
    def presence(self) -> DataFrame:
        return materialise(pr.presence(self.p), "presence")

    @cached_property
    def factors(self) -> tuple[DataFrame, DataFrame]:
        """Normalised (rank, gene, component, w) and (rank, genome, component, h)."""
        w, h = factor.factorise(self.presence, list(self.ranks), self.max_iter)
        w, h = factor.normalised(materialise(w, "weights"), materialise(h, "scores"))
        return materialise(w, "weights"), materialise(h, "scores")

    @cached_property
    def binary(self) -> tuple[DataFrame, DataFrame]:
        """The genes and genomes in the top cluster of each component."""
        w, h = self.factors
        return materialise(factor.binarised(w, "gene", "w").where("top"), "genes_of"), materialise(factor.binarised(h, "genome", "h").where("top"), "genomes_of")

    @property
    def thresholds(self) -> DataFrame:
        """The least weight in each component's top cluster."""
        return factor.thresholds(self.binary[0], "w")

    @property
    def reconstruction(self) -> DataFrame:
        return factor.reconstruction(*self.binary)

    @property
    def error(self) -> DataFrame:
        return factor.reconstruction_error(self.presence, self.reconstruction, list(self.ranks))

    @cached_property
    def scores(self) -> DataFrame:
        """The thirteen scores of every rank."""
        genes, genomes = factor.shape(self.presence)
        counts = factor.confusion(self.presence, *self.binary, list(self.ranks), genes, genomes)
        return materialise(factor.metrics(counts, genes, genomes), "scores")

    @property
    def best(self) -> DataFrame:
        """The best rank by the metric, and its neighbours."""
        return factor.best_rank(self.scores, self.metric, lowest=self.metric == "aic")

    @property
    def map(self) -> DataFrame:
        """A map of the genomes."""
        return embed.genome_map(self.presence)

    def affinities(self, arriving: DataFrame, rank: int) -> DataFrame:
        """Scores of arriving genomes (gene, genome) on the components of one rank; genes that the model does not have are left out."""
        return factor.affinities(self.factors[0].where(F.col("rank") == rank), arriving)

    def save(self, folder: str) -> None:
        """Factors, their binary forms and scores, each in a folder of its name."""
        made = {"presence": self.presence, "weights": self.factors[0], "scores": self.factors[1], "genes_of": self.binary[0], "genomes_of": self.binary[1], "metrics": self.scores}
        tb.save_tables(made, folder, {"ranks": list(self.ranks), "max_iter": self.max_iter, "metric": self.metric})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> FactorModel:
        """A saved model; nothing is fitted again."""
        made, meta = tb.load_tables(spark, folder)
        model = cls(made["presence"], tuple(meta["ranks"]), meta["max_iter"], meta["metric"])
        model.__dict__.update(presence=made["presence"], factors=(made["weights"], made["scores"]), binary=(made["genes_of"], made["genomes_of"]), scores=made["metrics"])
        return model


@dataclass(frozen=True)
class Dataset:
    """A presence table with what belongs to it; every table is optional but the first, and checked against it."""

    p: DataFrame
    genes: DataFrame | None = None
    genomes: DataFrame | None = None
    w: DataFrame | None = None
    h: DataFrame | None = None
    new: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    def check(self) -> Dataset:
        """Fail at the first table that does not fit: columns, ids beyond the presence table, repeated ids, uneven components."""
        check_columns(self.p, ("gene", "genome"), "the presence table")
        for df, key in ((self.genes, "gene"), (self.genomes, "genome")):
            if df is not None:
                check_columns(df, (key,), f"the table of {key}s")
                _only(df, key, self.p, f"the table of {key}s")
                twice = df.groupBy(key).count().where("count > 1").limit(5).collect()
                if twice:
                    raise ValueError(f"{[r[key] for r in twice]} are more than once in the table of {key}s")
        if (self.w is None) != (self.h is None):
            raise ValueError("weights and scores come together")
        if self.w is not None:
            check_decomposition(self.p, self.w, self.h)
        if self.new is not None:
            check_columns(self.new, ("gene", "genome"), "arriving genomes")
            both = self.new.select("genome").distinct().join(self.p.select("genome").distinct(), "genome", "left_semi").limit(5).collect()
            if both:
                raise ValueError(f"arriving genomes {[r['genome'] for r in both]} are in the presence table already")
        return self
