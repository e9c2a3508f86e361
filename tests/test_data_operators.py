"""The general data operators against plain versions, on small and awkward inputs."""

from __future__ import annotations

import random
import re
import statistics
import time
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presencia.operators import badlines, packed, profile, quantiles, references, skew

T0 = datetime(2023, 1, 1)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- skew -------------------------------------------------------------------------


def test_salted_lookup_splits_hot_keys_without_loss(spark):
    rows = [(0, i) for i in range(500)] + [(k, k) for k in range(1, 50)] + [(None, 7)]
    big = spark.createDataFrame(rows, "k int, v int")
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    joined = skew.salted_lookup(big, small, ["k"], "n", F.col("v"), hot_rows=60)
    assert got(joined.select("k", "v", "n")) == sorted(((k, v, 500 if k == 0 else 1) for k, v in rows if k is not None), key=repr)
    assert skew.salted_lookup(big.limit(0), small.limit(0), ["k"], "n", F.col("v")).count() == 0


def test_salted_lookup_with_more_hot_keys_than_buckets(spark, monkeypatch):
    monkeypatch.setattr(skew, "BUCKETS", 3)
    big = spark.range(400).select((F.col("id") % 20).alias("k"), F.col("id").alias("v"))
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    joined = skew.salted_lookup(big, small, ["k"], "n", F.col("v"), hot_rows=5)
    assert got(joined) == sorted(((i % 20, i, 20) for i in range(400)), key=repr)


def test_a_hot_key_makes_no_long_task(spark):
    n = 400_000  # 200,000 keys, and one with a tenth of the rows
    big = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.lit(0)).otherwise(1 + F.col("id") % 200_000).alias("k"), F.col("id").alias("v"))
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.salted_lookup(big, small, ["k"], "n", F.col("v"), hot_rows=1000)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == n
    assert max(sizes) <= 2 * statistics.median(sizes)


# --- references -------------------------------------------------------------------


def _brute(children, parents):
    out = []
    for row_id, key, t, load in children:
        if key is None:
            continue
        own = [p for p in parents if p[0] == key]
        if any(s is not None and t is not None and s <= t and (g is None or g > t) for _, s, g in own):
            continue
        reason = "missing" if not own else "late" if all(s is not None and t is not None and s > t for _, s, g in own) else "deleted"
        out.append(("c", load, row_id, reason))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_orphans_as_by_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(references, "BIN_ROWS", 10)
    rnd = random.Random(seed)
    day = lambda: None if rnd.random() < 0.03 else T0 + timedelta(days=rnd.randrange(40))
    keys = ["hot"] * 6 + [f"k{i}" for i in range(30)] + [None]
    parents = [(rnd.choice(keys), s := day(), None if rnd.random() < 0.3 else (s or T0) + timedelta(days=rnd.randrange(6))) for _ in range(150)]
    parents += parents[:10]
    children = [(i, rnd.choice(keys), day(), rnd.randrange(1, 4)) for i in range(300)]
    children += children[:5]
    up = spark.createDataFrame(parents, "tag string, loaded timestamp_ntz, gone timestamp_ntz").withColumn("key", F.lit("clash"))
    kids = spark.createDataFrame(children, "row_id long, ref string, loaded timestamp_ntz, load_no int").withColumns({"target": F.lit(1), "t": F.lit(2)})
    found = references.orphans(
        [references.Child("c", "p", kids, F.col("ref"), F.col("loaded"), F.col("load_no"), F.col("row_id"))],
        [references.Parent("p", up, F.col("tag"), F.col("loaded"), F.col("gone"))],
    )
    assert got(found) == _brute(children, parents)
    assert sum(r["n_rows"] for r in references.orphans_by_period(found).collect()) == len(_brute(children, parents))


def test_orphans_of_empty_tables(spark):
    kids = spark.createDataFrame([(1, "a", T0, 1)], "row_id long, ref string, loaded timestamp_ntz, load_no int")
    up = spark.createDataFrame([], "tag string, loaded timestamp_ntz")
    child = lambda df: [references.Child("c", "p", df, F.col("ref"), F.col("loaded"), F.col("load_no"), F.col("row_id"))]
    parent = [references.Parent("p", up, F.col("tag"), F.col("loaded"))]
    assert got(references.orphans(child(kids), parent)) == [("c", 1, 1, "missing")]
    assert references.orphans(child(kids.limit(0)), parent).count() == 0


# --- packed -----------------------------------------------------------------------

FIELDS = [
    (1, "GO:1, GO:2;GO:2"), (2, None), (3, ""), (4, " ;, "), (5, '"a ""b"" c",d'), (6, '""'), (7, 'x"y z"w'), (8, "open \"a b c"), (9, '"a" "b'), (10, "a，b\tc\nd"),
    (11, "['GO:1', 'GO:2']"), (12, "é a-b_c.d"), (13, "x," * 5000), (14, '"' + "long " * 4000 + '"'), (14, "a"), (15, '"""'), (16, '"a"""b'), (17, '"a""a'), (18, '"a""b""c d'), (19, '""""'), (20, '"" "'),
]


def _unpacked(field):
    found = re.findall(r'"(?:[^"]|"")*"|[A-Za-z0-9:._-]+', field or "")
    return [v[1:-1].replace('""', '"') if v[0] == '"' else v for v in found]


@pytest.mark.parametrize(("max_rules", "max_chars"), [(1000, 10**6), (3, 10**6), (1000, 20), (0, 0)])
def test_unpack_as_by_a_plain_reader(spark, monkeypatch, max_rules, max_chars):
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    df = spark.createDataFrame(FIELDS, "id int, f string").withColumns({"pos": F.lit("x"), "_skel": F.lit("y")})
    want = sorted(((i, p, v) for i, f in FIELDS for p, v in enumerate(_unpacked(f), 1)), key=repr)
    assert got(packed.unpack(df, "f", ["id"], max_rules, max_chars)) == want


def test_unpack_random_fields_and_empty_table(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice('ab1:;, "|\t') for _ in range(rnd.randrange(14)))) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, f string")
    assert got(packed.unpack(df, "f", ["id"])) == sorted(((i, p, v) for i, f in rows for p, v in enumerate(_unpacked(f), 1)), key=repr)
    assert packed.unpack(df.limit(0), "f", ["id"]).count() == 0


# --- quantiles --------------------------------------------------------------------


def _quantile(xs, p):
    xs, at = sorted(xs), (len(xs) - 1) * p
    lo = int(at)
    hi = min(lo + 1, len(xs) - 1)
    return xs[lo] + (xs[hi] - xs[lo]) * (at - lo)


@pytest.mark.parametrize(("few", "bins", "brackets"), [(4096, 1024, 100_000), (5, 4, 100_000), (5, 4, 0)])
def test_quantiles_refine_to_the_exact_value(spark, monkeypatch, few, bins, brackets):
    for k, v in {"FEW": few, "BINS": bins, "MAX_BRACKETS": brackets}.items():
        monkeypatch.setattr(quantiles, k, v)
    rnd = random.Random(1)
    rows = [("hot", rnd.choice([7, rnd.randrange(-(10**9), 10**9)])) for _ in range(700)]
    rows += [(k, rnd.randrange(20)) for k in "abc" for _ in range(30)] + [("one", 3), ("none", None), (None, 5), (None, 9), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v long").withColumns({"lo": F.lit("clash"), "n_rows": F.lit(1)})
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for r in quantiles.exact_quantiles(df, ["k"], "v", probs).collect():
        xs = [v for k, v in rows if k == r["k"] and v is not None]
        assert r["n_rows"] == sum(k == r["k"] for k, _ in rows)
        assert r["n_values"] == len(xs)
        assert r["quantiles"] == (pytest.approx([_quantile(xs, p) for p in probs]) if xs else None)


def test_quantiles_by_weight_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 5, 1), ("b", 2, 2), ("b", 4, 2)], "k string, v long, w long")
    r = {x["k"]: x["quantiles"][0] for x in quantiles.exact_quantiles(df, ["k"], "v", [0.5], weight="w").collect()}
    assert r == {"a": 1.0, "b": statistics.median([2, 2, 4, 4])}
    empty = quantiles.exact_quantiles(df.limit(0), ["k"], "v", [0.5])
    assert empty.count() == 0
    assert quantiles.heavy_keys(df.limit(0), "k", 0.02).count() == 0


@pytest.mark.parametrize(("few", "bins"), [(4096, 1024), (5, 256)])
def test_heavy_keys_at_exactly_the_share(spark, monkeypatch, few, bins):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", bins)
    rows = [("a",)] * 2 + [("b",)] + [(None,)] * 97
    df = spark.createDataFrame(rows, "k string").withColumn("code", F.lit(1))
    assert got(quantiles.heavy_keys(df, "k", 0.02)) == [("a", 2)]
    assert got(quantiles.heavy_keys(df, "k", 1.0)) == []
    many = spark.range(1000).select(F.when(F.col("id") < 300, F.col("id") % 10).otherwise(F.col("id")).cast("string").alias("k"))
    assert got(quantiles.heavy_keys(many, "k", 0.03)) == [(str(k), 30) for k in range(10)]
    assert got(quantiles.heavy_keys(many.where("k = '1'"), "k", 1.0)) == [("1", 30)]


# --- profiles ---------------------------------------------------------------------

RULES = [profile.Rule("size", 1, 100), profile.Rule("state", allowed=("ok", "new"))]


def _catalogue(seed):
    rnd = random.Random(seed)
    rows = []
    for load in range(1, 6):
        for feed in "ab":
            sizes = [5] if (load, feed) == (4, "a") else [rnd.randrange(1, 90)] + [rnd.randrange(1, 90 if load != 3 else 400) for _ in range(3)]
            states = ["ok"] if load == 2 else ["ok", "new", "bad"] if load == 5 else ["ok", "ok", "new", None]
            rows += [(feed, load, rnd.choice(sizes) if rnd.random() > 0.1 * load else None, rnd.choice(states), "extra") for _ in range(60)]
    rows += [(None, 1, 3, "ok", "x"), ("c", 1, None, None, "x"), ("a", None, 3, "ok", "x")]
    return pd.DataFrame(rows, columns=["feed", "load_no", "size", "state", "value"]).astype({"size": "Int64", "load_no": "Int32"})


def _write(df, path, **kw):
    schema = pa.schema([("feed", pa.string()), ("load_no", pa.int32()), ("size", pa.int64()), ("state", pa.string()), ("value", pa.string())])
    pq.write_table(pa.Table.from_pandas(df, schema, preserve_index=False), path, **kw)


def _findings(df):
    out = set()
    groups = {k: g for k, g in df.groupby(["feed", "load_no"])}
    for (feed, load), g in groups.items():
        b = groups.get((feed, load - 1))
        for col in ("size", "state"):
            x, n = g[col].dropna(), len(g)
            if b is not None and g[col].isna().mean() - b[col].isna().mean() > 0.117:
                out.add((feed, load, col, "nulls"))
            bad = (~x.between(1, 100)) if col == "size" else ~x.isin(["ok", "new"])
            if bad.sum() > 0.019 * len(x):
                out.add((feed, load, col, "range" if col == "size" else "pattern"))
            if len(x) >= 2 and x.nunique() == 1:
                out.add((feed, load, col, "constant"))
            if b is not None and len(x) and len(y := b[col].dropna()):
                if col == "size" and max(x.median(), y.median()) > 1.453 * min(x.median(), y.median()):
                    out.add((feed, load, col, "shift"))
                if col == "state" and x.value_counts(normalize=True).sub(y.value_counts(normalize=True), fill_value=0).abs().sum() / 2 > 0.193:
                    out.add((feed, load, col, "shift"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("layout", ["mixed", "by_load", "constant_chunks"])
def test_load_findings_from_footers_or_scans(spark, tmp_path, layout):
    df = _catalogue(3)
    (tmp_path := tmp_path / "a folder").mkdir()
    if layout == "mixed":
        _write(df.sample(frac=1, random_state=1), tmp_path / "part-0.parquet", row_group_size=97)
    else:
        keys = ["feed", "load_no"] if layout == "by_load" else ["feed", "load_no", "size", "state"]
        for i, (_, g) in enumerate(df.groupby(keys, dropna=False)):
            _write(g, tmp_path / f"part-{i}.parquet", compression=["snappy", "zstd", "none"][i % 3])
    found = profile.load_findings(spark, str(tmp_path), "feed", "load_no", RULES)
    assert got(found) == _findings(df)
    table = spark.read.parquet(str(tmp_path))
    opened = profile.counted_chunks(spark, table, ["feed", "load_no"], ["size", "state"]).where("open")
    if layout == "mixed":
        assert opened.count() == 2 * len(range(0, len(df), 97))
    if layout == "constant_chunks":  # rows without a feed or load have no single key value
        assert opened.select("path").distinct().count() <= sum(g["feed"].isna().any() or g["load_no"].isna().any() for _, g in df.groupby(keys, dropna=False))


def test_only_open_chunks_are_read(spark, tmp_path):
    schema = pa.schema([("feed", pa.string()), ("load_no", pa.int32()), ("size", pa.int64()), ("state", pa.string())])
    groups = [("a", 1, [5] * 400, ["ok", "new"] * 200), ("a", 2, [5, 500] * 200, ["ok"] * 400), ("a", 2, [700] * 400, ["bad"] * 400)]
    with pq.ParquetWriter(tmp_path / "x.parquet", schema) as w:
        for feed, load, sizes, states in groups:
            w.write_table(pa.table({"feed": [feed] * 400, "load_no": [load] * 400, "size": sizes, "state": states}, schema))
    table = spark.read.parquet(str(tmp_path))
    chunks = profile.profile_chunks(spark, table, ["size", "state"], RULES)
    opened = chunks.where("open").select("row_group", "column_name", "bytes").collect()
    assert [tuple(r)[:2] for r in opened] == [(1, "size")]  # sizes in and out of range: how many is not known
    meta = pq.ParquetFile(tmp_path / "x.parquet").metadata
    assert opened[0]["bytes"] == meta.row_group(1).column(2).total_compressed_size
    assert chunks.agg(F.sum("bytes")).first()[0] == sum(meta.row_group(g).column(c).total_compressed_size for g in range(3) for c in (2, 3))
    out = {r["column_name"]: tuple(r)[1:] for r in profile.column_profile(spark, str(tmp_path), RULES).collect()}
    assert out == {"size": (1200, 0, 3, 5.0, 700.0, 600), "state": (1200, 0, 3, None, None, 400)}
    held = profile.counted_chunks(spark, table, ["feed", "load_no"], ["size", "state"]).where("open")
    assert got(held.select("row_group", "column_name")) == [(0, "state"), (1, "size")]
    assert ("a", 2, "size", "shift") in got(profile.load_findings(spark, str(tmp_path), "feed", "load_no", RULES))


@pytest.mark.parametrize("dictionary", [True, False])
def test_columns_of_every_type(spark, tmp_path, dictionary):
    day, nan = date(2024, 2, 1), float("nan")
    cols = {
        "x": pa.array([0.0, -0.0, 2.5, None, nan, nan], pa.float64()), "f": pa.array([0.5, None, 1.5, 0.5, 0.5, 0.5], pa.float32()),
        "b": pa.array([True, False, None, True, True, True]), "d": pa.array([day, None, day, day, day, day + timedelta(3)]),
        "t": pa.array([T0, None, T0, T0, T0 + timedelta(1), T0], pa.timestamp("us")), "ms": pa.array([T0, None] * 3, pa.timestamp("ms")),
        "n": pa.array([None] * 6, pa.int32()), "l": pa.array([1 << 60, -5, 3, 3, None, 3]), "s": pa.array(["", "é", None, "é", "x" * 9000, "a"]),
        "m": pa.array([Decimal("1.50"), None, Decimal("2.25"), None, None, None]), "raw": pa.array([b"1"] * 6), "many": pa.array([[1]] * 6),
    }
    pq.write_table(pa.table(cols), tmp_path / "x.parquet", use_dictionary=dictionary, row_group_size=4)
    named = list(profile.profiled(spark.read.parquet(str(tmp_path)).schema))
    assert named == [c for c in cols if c not in ("raw", "many")]
    rules = [profile.Rule("x", 0, 2), profile.Rule("l", low=0), profile.Rule("s", allowed=("a", "é"))]
    out = {r["column_name"]: tuple(r)[1:] for r in profile.column_profile(spark, str(tmp_path), rules, named).collect()}
    micros = int(T0.replace(tzinfo=timezone.utc).timestamp()) * 10**6
    days = (day - date(1970, 1, 1)).days
    assert out == {
        "x": (6, 1, 3, 0.0, 2.5, 3), "f": (6, 1, 2, 0.5, 1.5, 0), "b": (6, 1, 2, 0.0, 1.0, 0), "d": (6, 1, 2, days, days + 3, 0),
        "t": (6, 1, 2, micros, micros + 86400 * 10**6, 0), "ms": (6, 3, 1, micros, micros, 0), "n": (6, 6, 0, None, None, 0),
        "l": (6, 1, 3, -5.0, float(1 << 60), 1), "s": (6, 1, 4, None, None, 2), "m": (6, 4, 2, 1.5, 2.25, 0),
    }
    with pytest.raises(ValueError, match="raw"):
        profile.column_profile(spark, str(tmp_path), [], ["raw"])


@pytest.mark.parametrize("layout", ["mixed", "clean"])
def test_column_profile(spark, tmp_path, layout):
    df = _catalogue(4)
    if layout == "clean":
        df = df[df["state"].isin(["ok", "new"]) & df["size"].between(1, 100)]
    for i in range(3):
        _write(df.iloc[i::3], tmp_path / f"part-{i}.parquet")
    out = {r["column_name"]: r for r in profile.column_profile(spark, str(tmp_path), RULES).collect()}
    for col in ("size", "state"):
        x = df[col].dropna()
        bad = (~x.between(1, 100)) if col == "size" else ~x.isin(["ok", "new"])
        assert (out[col]["n_rows"], out[col]["n_nulls"], out[col]["n_distinct"], out[col]["n_violations"]) == (len(df), df[col].isna().sum(), x.nunique(), bad.sum())
    assert (out["size"]["lo"], out["size"]["hi"]) == (df["size"].min(), df["size"].max())


def test_profiles_of_an_empty_table(spark, tmp_path):
    _write(_catalogue(3).head(0), tmp_path / "part-0.parquet")
    assert profile.load_findings(spark, str(tmp_path), "feed", "load_no", RULES).count() == 0
    assert [tuple(r)[1:4] for r in profile.column_profile(spark, str(tmp_path), RULES).collect()] == [(0, 0, 0)] * 2


def test_dictionaries_are_read_without_data_pages(spark, tmp_path):
    from presencia.sources.parquet_pages import column_chunks

    df = pd.DataFrame({"s": ["b", "a", None, "é" * 300] * 500, "n": pd.array([3, None, -7, 3] * 500, "Int64"), "u": [f"v{i}" for i in range(2000)]})
    df.to_parquet(tmp_path / "a.parquet", row_group_size=1000, use_dictionary=["s", "n"])
    rows = column_chunks(spark, [f"file://{tmp_path}/a.parquet"], ["s", "n", "u"]).collect()
    by = {(r["row_group"], r["column_name"]): r for r in rows}
    values = lambda g, c, x: {v[x] for v in by[g, c]["candidates"]}
    assert values(0, "s", "t") == {"a", "b", "é" * 300} and by[0, "s"]["candidates_exact"] and by[0, "s"]["nulls"] == 250
    assert values(1, "n", "l") == {3, -7} and (by[1, "n"]["lo"], by[1, "n"]["hi"]) == (-7, 3)
    assert by[0, "u"]["candidates"] is None and not by[0, "u"]["candidates_exact"]


# --- lines ------------------------------------------------------------------------

GOOD = "1.1\tA b\tWGS\t1\t100\t90\t5\t1\t50\t1.5\t99.0\t40.1"
LINES = [
    GOOD, None, "", "\t" * 11, GOOD.replace("A b", '"A\t""b"""'), GOOD.replace("A b", 'A "b"'), GOOD.replace("A b", '"A b'), GOOD.replace("A b", '"A" b'), GOOD + "\tx",
    GOOD.replace("100", "-1"), GOOD.replace("100", "9223372036854775807"), GOOD.replace("100", "9223372036854775808"), GOOD.replace("100", "000000000000000000000000012"), GOOD.replace("\t50\t", "\tnull\t"),
    GOOD.replace("1.5", "100"), GOOD.replace("1.5", "100.1"), GOOD.replace("1.5", "5."), GOOD.replace("1.5", "1e1"), GOOD.replace("1.5", "100.00"), GOOD.replace("100", "１２"), GOOD.replace("100", '"100"'),
    GOOD.replace("40.1", '"40.1'), GOOD.replace("A b", "a\nb"), GOOD.replace("A b", "x" * 200_000), GOOD.replace("\t90\t", "\tmany\t"), GOOD[:-5], '"' + GOOD, GOOD.replace("100", " 100"), GOOD.replace("A b", '""'),
]
REASONS = {
    1: "column_count", 2: "column_count", 6: "broken_quoting", 7: "broken_quoting", 8: "column_count", 9: "invalid_value", 11: "invalid_value", 13: "invalid_value", 15: "invalid_value", 16: "invalid_value",
    17: "invalid_value", 19: "invalid_value", 21: "broken_quoting", 25: "column_count", 26: "broken_quoting", 27: "invalid_value",
}


def test_every_line_loads_or_has_its_reason(spark):
    rows = [(i, x) for i, x in enumerate(LINES)] * 3
    df = spark.createDataFrame(rows, "line_id long, line string").withColumn("reason", F.lit("clash")).repartition(2)
    out = badlines.read_lines(df, "line_id", "line", badlines.CATALOGUE)
    assert len(rows) == out.count()
    assert {r["line_id"]: r["reason"] for r in out.collect() if r["reason"]} == REASONS
    names = {r["line_id"]: r for r in out.collect()}
    assert names[4]["genome_name"] == 'A\t"b"' and names[5]["genome_name"] == 'A "b"' and names[22]["genome_name"] == "a\nb"
    assert names[3]["genome_length"] is None and names[10]["genome_length"] == 9223372036854775807 and names[12]["genome_length"] == 12
    assert names[24]["patric_cds"] is None and names[28]["genome_name"] is None
    assert badlines.read_lines(df.limit(0), "line_id", "line", badlines.CATALOGUE).count() == 0


def test_bulk_and_strict_reading_agree(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(3000):
        fields = GOOD.split("\t")
        if rnd.random() < 0.3:
            k = rnd.randrange(12)
            fields[k] = rnd.choice(['"x\ty"', '"', 'a"', '"a"b', "", "7", "-7", "1.25", "101", '"7"', '""""'])
        rows.append((i, "\t".join(fields)))
    out = badlines.read_lines(spark.createDataFrame(rows, "line_id long, line string"), "line_id", "line", badlines.CATALOGUE)
    assert {r["line_id"]: r["reason"] for r in out.collect()} == {i: badlines.diagnose(x, badlines.CATALOGUE)[0] for i, x in rows}


def _arrow_schema():
    kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in badlines.CATALOGUE.schema("id").fields])


def test_few_blocks_are_parsed_and_faster_than_strictly(monkeypatch):
    rnd, calls, bulk = random.Random(3), [], badlines._bulk
    monkeypatch.setattr(badlines, "_bulk", lambda *a: calls.append(1) or bulk(*a))
    bad = ['"x', "\t", "-7"]
    rows = [GOOD if rnd.random() > 0.09 else GOOD.replace("100", rnd.choice(bad)) for _ in range(6000)]
    schema = _arrow_schema()
    ids, lines = pa.array(range(6000)), pa.array(rows)
    took = []
    for _ in range(3):
        calls.clear()
        began = time.perf_counter()
        batches = [b for i in range(0, 6000, badlines.BLOCK) for b in badlines._parse(ids[i : i + badlines.BLOCK], lines[i : i + badlines.BLOCK], badlines.CATALOGUE, schema)]
        took.append(time.perf_counter() - began)
    began = time.perf_counter()
    strict = badlines._strict(ids, lines, badlines.CATALOGUE, schema)
    assert min(took) < time.perf_counter() - began
    assert len(calls) == 3
    key = lambda t: t.sort_by("id").to_pylist()
    assert key(pa.Table.from_batches(batches)) == key(pa.Table.from_batches([strict]))


def test_blocks_are_bisected_where_the_parser_fails(monkeypatch):
    bulk = badlines._bulk
    monkeypatch.setattr(badlines, "STRICT", 2)
    monkeypatch.setattr(badlines, "_bulk", lambda lines, layout: None if "7.7" in "".join(lines.to_pylist()) else bulk(lines, layout))
    rows = [GOOD.replace("1.1", f"{i}.7") for i in range(50)]
    schema = _arrow_schema()
    out = pa.Table.from_batches(list(badlines._parse(pa.array(range(50)), pa.array(rows), badlines.CATALOGUE, schema)))
    assert out.sort_by("id")["genome_id"].to_pylist() == [f"{i}.7" for i in range(50)]
    assert out["reason"].null_count == 50
