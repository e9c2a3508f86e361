"""Several values packed in one field, split into one row per value.

A field is cut into pieces: runs of ordinary characters, and single other
characters.  Its *skeleton* has one character per piece, ``a`` for a run and the
character itself otherwise, so piece i stands at position i of the skeleton.  The
splitting rule is resolved once per distinct skeleton (a list of piece ranges)
and applied to the fields by position.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from presencia.operators.skew import salted_lookup
from presencia.session import materialise

#: Characters of an unquoted value, as the inside of a character class.
ORDINARY = "A-Za-z0-9:._-"
#: Rules broadcast at most: the most frequent skeletons, in rows and in characters.
MAX_RULES, MAX_RULE_CHARS = 50_000, 8_000_000

RULE = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("len", T.IntegerType()), T.StructField("quoted", T.BooleanType())])
)


def skeleton(field: Column) -> Column:
    """The field's delimiter skeleton."""
    return F.regexp_replace(field, f"[{ORDINARY}]+", "a")


def resolve(skel: str) -> list[tuple[int, int, bool]]:
    """The rule of one skeleton: (first piece from 1, pieces, quoted) of each value.

    A double quote opens a stretch that ends at the next one that is not doubled.  If there is none, it ends at the
    first quote of the last doubled pair, and without such a pair the quote is a separator like any other.
    """
    rule, i, n = [], 0, len(skel)
    while i < n:
        if skel[i] == "a":
            rule.append((i + 1, 1, False))
        elif skel[i] == '"':
            pair, j = -1, skel.find('"', i + 1)
            while j >= 0 and skel[j + 1 : j + 2] == '"':
                pair, j = j, skel.find('"', j + 2)
            end = j if j >= 0 else pair
            if end >= 0:
                rule.append((i + 2, end - i - 1, True))
                i = end
        i += 1
    return rule


@F.pandas_udf(RULE)
def _resolved(skels: pd.Series) -> pd.Series:
    return skels.map(lambda s: [{"start": a, "len": b, "quoted": c} for a, b, c in resolve(s)])


def _values(pieces: Column, rule: Column) -> Column:
    return F.transform(
        rule,
        lambda r: F.when(
            r["quoted"], F.replace(F.array_join(F.slice(pieces, r["start"], r["len"]), ""), F.lit('""'), F.lit('"'))
        ).otherwise(F.get(pieces, r["start"] - 1)),
    )


def unpack(df: DataFrame, field: str, keep: list[str], max_rules: int = MAX_RULES, max_chars: int = MAX_RULE_CHARS) -> DataFrame:
    """``keep`` columns with ``pos`` (from 1) and ``val``, one row per value of ``field``.

    Null and empty fields, and fields of separators only, give no rows; repeated
    values are kept; an empty quoted stretch is an empty value; an unclosed quote is
    read as :func:`resolve` says.  Columns beyond ``keep`` and ``field`` are not read.

    Scale: the skeletons are counted with map-side combining; if their rules exceed MAX_RULES or
    MAX_RULE_CHARS, the most frequent ones within both are broadcast, long ones too, and the rows of the rest
    join their rules by a shuffle in which hot skeletons are dealt over sub-keys.
    """
    rows = df.where(F.col(field).isNotNull() & (F.col(field) != "")).select(
        F.struct(*keep).alias("_keep"), F.col(field).alias("_field"), skeleton(F.col(field)).alias("_skel")
    )
    counts = rows.groupBy("_skel").agg(F.count(F.lit(1)).alias("_n"))
    rules = materialise(counts.select("_skel", "_n", _resolved("_skel").alias("_rule")), "rules")
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_skel")).alias("c")).first()
    if size["n"] <= max_rules and (size["c"] or 0) <= max_chars:
        ruled = rows.join(F.broadcast(rules.drop("_n")), "_skel")
    else:
        first = rules.select(F.md5("_skel").alias("_id"), "_n", F.length("_skel").alias("_len")).orderBy(F.desc("_n"), "_id").limit(max_rules)
        upto = F.sum("_len").over(Window.orderBy(F.desc("_n"), "_id"))  # of at most MAX_RULES rows
        first = first.withColumn("_c", upto).where(F.col("_c") <= max_chars).select("_id")
        often = materialise(rules.withColumn("_id", F.md5("_skel")).join(F.broadcast(first), "_id", "left_semi").drop("_id", "_n"), "rules_often")
        rest = materialise(rules.join(F.broadcast(often.select("_skel")), "_skel", "left_anti"), "rules_rest")
        others = rows.join(F.broadcast(often.select("_skel")), "_skel", "left_anti")
        ruled = rows.join(F.broadcast(often), "_skel").unionByName(
            salted_lookup(others, rest, ["_skel"], "_n", F.col("_field"), stored=True).drop("_n")
        )
    pieces = F.regexp_extract_all("_field", F.lit(f"[{ORDINARY}]+|[^{ORDINARY}]"), F.lit(0))
    # pieces as a column of their own, or the lambda would cut the field anew for each value
    return (
        ruled.where(F.size("_rule") > 0).select("_keep", "_rule", pieces.alias("_pieces"))
        .select("_keep", F.posexplode(_values(F.col("_pieces"), F.col("_rule"))).alias("_p", "_val"))
        .select("_keep.*", (F.col("_p") + 1).alias("pos"), F.col("_val").alias("val"))
    )
