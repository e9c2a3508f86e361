"""All similar pairs between set-valued records, by banded minwise hashing and an exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presencia.operators.skew import salted_lookup
from presencia.session import materialise

#: Bands and rows: at similarity s a pair is missed with (1 - s**ROWS)**BANDS, 1.0e-5 at 0.8 and less above.
BANDS, ROWS = 256, 14
#: Sets in a bucket above which it is split by prefix items; sets that one task pairs at once.
HOT_BUCKET, PART_SETS = 1000, 1000
#: Records of one set, and links of one set, that one task joins at once.
PART_RECORDS, PART_LINKS = 2000, 2000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed multipliers of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_hashes(items: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """One row of ``bands`` bucket hashes per set; ``starts`` are the sets' offsets into ``items``."""
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(starts), b + 1, np.uint64)
        for s in seeds[b * rows : (b + 1) * rows]:
            x = (items ^ s) * np.uint64(0x9FB21C651E98DF25)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9FB21C651E98DF25)
            h = _mix(h * np.uint64(31) + np.minimum.reduceat(x, starts))
        out[:, b] = h
    return out


def _signed(bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = batch.column(1)
                items = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                sizes = np.diff(lists.offsets.to_numpy())
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                hashes = band_hashes(items, starts, bands, rows, seed).view(np.int64)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.reshape(-1)),
                        pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)),
                        pa.array(np.repeat(sizes.astype(np.int32), bands)),
                    ],
                    names=["bucket", "set", "size"],
                ) if n else pa.RecordBatch.from_pylist([], schema=pa.schema([("bucket", pa.int64()), ("set", pa.int64()), ("size", pa.int32())]))

    return run


def _paired(rows: DataFrame, keys: list[str], count: str, num: int, den: int) -> DataFrame:
    """Distinct pairs of sets that share a key and may be similar by their sizes; hot keys in parts."""
    parts = F.ceil(F.col(count) / PART_SETS).cast("int")
    left = rows.select(*keys, F.col("set").alias("a"), F.col("size").alias("size_a"), F.pmod(F.xxhash64("set"), parts).cast("int").alias("part"))
    right = rows.select(*keys, F.col("set").alias("b"), F.col("size").alias("size_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    near = (den * F.least("size_a", "size_b") >= num * F.greatest("size_a", "size_b"))
    return left.join(right, [*keys, "part"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _prefix_split(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of hot buckets by (bucket, prefix item): similar sets share an item of their prefixes.

    With items in one order for all (rarest first), sets of similarity num / den
    agree within their first size - ceil(size * num / den) + 1 items, so this loses nothing.
    """
    hot = sets.join(rows.select("set").distinct(), "set", "left_semi")
    items = hot.select("set", F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    ranked = salted_lookup(items, often, ["item"], "n", F.col("set"))
    prefix = (
        ranked.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("i"))
        .withColumn("i", F.expr(f"slice(i, 1, size(i) - cast(ceil(size(i) * {num} / {den}) as int) + 1)"))
        .select("set", F.explode("i.item").alias("item"))
    )
    keyed = materialise(rows.select("bucket", "set", "size").join(prefix, "set"), "prefix_rows")
    shared = keyed.groupBy("bucket", "item").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    return salted_lookup(keyed, shared, ["bucket", "item"], "count", F.col("set"))


def similar_sets(df: DataFrame, record: str, item: str, num: int = 4, den: int = 5, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs of distinct sets with |common| / |union| >= num / den, and the records of each set.

    Returns (``set_1, set_2, common, size_1, size_2``), each pair once, and (``set, record``): equal sets are one
    set, so copies are not expanded here.  Null records and items are left out, repeated
    items count once, a record without items has no set.  Items go by 64-bit hashes, sets are told apart by 128 bits
    and numbered.

    Scale: items of a record combine map-side; a bucket's sets are counted with
    map-side combining and only buckets of two sets or more go on; buckets above HOT_BUCKET
    sets are split by prefix items without loss and all pairing is done in parts of
    PART_SETS; candidates are deduplicated before sets are joined for the exact check.
    """
    held = df.select(F.col(record).alias("record"), F.col(item).alias("item")).na.drop().distinct()
    records = held.groupBy("record").agg(F.sort_array(F.collect_list(F.xxhash64("item"))).alias("items"))
    records = materialise(records.withColumns({"h1": F.xxhash64("items"), "h2": F.xxhash64(F.lit(1), "items")}), "records")
    sets = records.groupBy("h1", "h2").agg(F.first("items").alias("items"), F.count(F.lit(1)).alias("n_records"))
    sets = materialise(sets.withColumn("set", F.monotonically_increasing_id()), "sets")  # numbers hold, since they are written
    members = salted_lookup(records.select("h1", "h2", "record"), sets.select("h1", "h2", "set", "n_records"), ["h1", "h2"], "n_records", F.col("record"), stored=True)
    # by the number of executors' cores, since hashing is long for few bytes
    tasks = sets.sparkSession.sparkContext.defaultParallelism * 4
    hashed = materialise(
        sets.repartition(tasks, "set").select("set", "items").mapInArrow(_signed(bands, rows, seed), "bucket bigint, set bigint, size int"), "buckets"
    )
    shared = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    within = materialise(salted_lookup(hashed, shared, ["bucket"], "count", F.col("set")), "shared_buckets")
    pairs = _paired(within.where(F.col("count") <= HOT_BUCKET), ["bucket"], "count", num, den)
    if (within.agg(F.max("count").alias("m")).first()["m"] or 0) > HOT_BUCKET:
        split = materialise(_prefix_split(within.where(F.col("count") > HOT_BUCKET), sets, num, den), "prefixes")
        pairs = pairs.unionByName(_paired(split, ["bucket", "item"], "count", num, den)).distinct()
    a, b = (sets.select(F.col("set").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    common = F.size(F.array_intersect("items_a", "items_b"))
    checked = (
        pairs.join(a, "a").join(b, "b")
        .select(F.col("a").alias("set_1"), F.col("b").alias("set_2"), common.alias("common"), F.size("items_a").alias("size_1"), F.size("items_b").alias("size_2"))
        .where(den * F.col("common") >= num * (F.col("size_1") + F.col("size_2") - F.col("common")))
    )
    return checked, members.select("set", "record")


def similar_records(df: DataFrame, record: str, item: str, num: int = 4, den: int = 5) -> DataFrame:
    """All pairs ``record_1 < record_2`` of similar records, copies included.

    The records of a set are cut into parts of PART_RECORDS and its links dealt over sub-keys of PART_LINKS, so that neither a set
    with many copies nor one that is similar to many makes a long task; the output itself grows with the copies.
    """
    checked, members = similar_sets(df, record, item, num, den)
    members = materialise(members, "members")
    links = checked.select("set_1", "set_2")
    copies = members.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    own = copies.where("n > 1").select(F.col("set").alias("set_1"), F.col("set").alias("set_2"))
    links = materialise(links.unionByName(own), "links")
    degrees = links.select(F.explode(F.array("set_1", "set_2")).alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("degree"))
    up = lambda c, by: F.ceil(F.col(c) / by).cast("int")
    sizes = materialise(copies.join(degrees, "set").select("set", "n", "degree", up("n", PART_RECORDS).alias("parts"), up("degree", PART_LINKS).alias("deals")), "sizes")
    kept = salted_lookup(members, sizes, ["set"], "n", F.col("record"), stored=True)
    kept = kept.withColumn("part", F.pmod(F.xxhash64("record"), F.col("parts")).cast("int")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    for x, other in (("1", "set_2"), ("2", "set_1")):
        of = sizes.select(F.col("set").alias(f"set_{x}"), F.col("degree").alias("_degree"), F.col("parts").alias(f"parts_{x}"), F.col("deals").alias(f"deals_{x}"))
        links = salted_lookup(links, of, [f"set_{x}"], "_degree", F.col(other), stored=True).drop("_degree")
    pairs = links.withColumn("part_1", each("parts_1")).withColumn("part_2", each("parts_2"))
    pairs = pairs.withColumns({f"deal_{x}": F.pmod(F.xxhash64(f"set_{o}", f"part_{o}"), F.col(f"deals_{x}")).cast("int") for x, o in ("12", "21")})
    pairs = pairs.select("set_1", "set_2", "part_1", "part_2", "deal_1", "deal_2")
    for x in "12":
        of = kept.select(*[F.col(c).alias(f"{c}_{x}") for c in ("set", "part", "deal")], F.col("record").alias(f"r_{x}"))
        pairs = pairs.join(of, [f"{c}_{x}" for c in ("set", "part", "deal")])
    found = pairs.where((F.col("set_1") != F.col("set_2")) | (F.col("r_1") < F.col("r_2")))
    return found.select(F.least("r_1", "r_2").alias("record_1"), F.greatest("r_1", "r_2").alias("record_2"))


def similar_classes(df: DataFrame, record: str, item: str, num: int = 4, den: int = 5) -> DataFrame:
    """One row per record: its ``class_id`` (least record of equal sets), ``n_copies`` and ``n_links`` to other sets."""
    checked, members = similar_sets(df, record, item, num, den)
    links = checked.select(F.explode(F.array("set_1", "set_2")).alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("n_links"))
    classes = members.groupBy("set").agg(F.min("record").alias("class_id"), F.count(F.lit(1)).alias("n_copies")).join(links, "set", "left")
    classes = classes.withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return salted_lookup(members, classes, ["set"], "n_copies", F.col("record")).drop("set")
