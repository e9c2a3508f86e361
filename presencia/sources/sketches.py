"""Sketches of genomes by their least k-mer hashes, and distances between them (after Ondov et al. 2016)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def kmer_hashes(seq: str, k: int) -> np.ndarray:
    """Distinct hashes of a sequence's canonical k-mers (k up to 31), those with other symbols left out."""
    code = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(code) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    forward, backward, bad = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(k):
        part = code[i : i + n].astype(np.uint64)
        bad |= part > 3
        forward = (forward << np.uint64(2)) | (part & np.uint64(3))
        backward |= (np.uint64(3) - (part & np.uint64(3))) << np.uint64(2 * i)
    x = np.minimum(forward, backward)[~bad] + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.unique((x ^ (x >> np.uint64(31))) >> np.uint64(1))


def sketches(contigs: DataFrame, k: int = 21, size: int = 1000) -> DataFrame:
    """``genome, sketch``: the ``size`` least distinct hashes of a genome's k-mers, in order.

    A contig gives at most ``size`` hashes, so a genome's contigs combine in small lists.
    """

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"genome": b["genome"], "h": [kmer_hashes(s or "", k)[:size].astype(np.int64) for s in b["seq"]]})

    rows = contigs.select("genome", "seq").mapInPandas(least, "genome string, h array<bigint>")
    flat = rows.select("genome", F.explode("h").alias("h")).distinct()
    return flat.groupBy("genome").agg(F.slice(F.array_sort(F.collect_list("h")), 1, size).alias("sketch"))


@F.pandas_udf(T.IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        s = max(len(x), len(y))
        union = np.union1d(x, y)[:s]
        out.append(int(np.isin(union, x).astype(int) @ np.isin(union, y)))
    return pd.Series(out, dtype="int32")


def distances(sketched: DataFrame, k: int = 21) -> DataFrame:
    """``genome1 < genome2, distance, shared, sketch`` of the pairs with a common hash; all others are at distance 1.

    Hashes of the union's least ones that both have give the Jaccard index j, and -ln(2 j / (1 + j)) / k the distance.  Pairs
    are found by an equi join on hashes.
    """
    flat = sketched.select("genome", F.explode("sketch").alias("h"))
    a, b = flat.withColumnRenamed("genome", "genome1"), flat.withColumnRenamed("genome", "genome2")
    pairs = a.join(b, "h").where("genome1 < genome2").select("genome1", "genome2").distinct()
    s1, s2 = (sketched.select(F.col("genome").alias(f"genome{i}"), F.col("sketch").alias(f"s{i}")) for i in (1, 2))
    rows = pairs.join(s1, "genome1").join(s2, "genome2").select("genome1", "genome2", _shared("s1", "s2").alias("shared"), F.greatest(F.size("s1"), F.size("s2")).alias("sketch"))
    j = F.col("shared") / F.col("sketch")
    d = F.when(F.col("shared") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.log(2 * j / (1 + j)) / k)))
    return rows.select("genome1", "genome2", d.alias("distance"), "shared", "sketch")
