"""What a Parquet file says about its columns without its data being read, and the values of single chunks.

Footers give exact null counts and extrema; dictionary pages give the distinct
candidates of a chunk whose data pages all refer to the dictionary.  A value is
(l, d, t): integers, booleans (0 and 1), dates (days) and times (microseconds) as a BIGINT l,
other numbers as a DOUBLE d, texts as t; the other two are null.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = "l bigint, d double, t string"
CHUNKS = (
    "path string, row_group int, n_rows bigint, column_name string, bytes bigint, nulls bigint, lo bigint, hi bigint, "
    f"candidates array<struct<{VALUE.replace(' ', ':').replace(',:', ',')}>>, candidates_exact boolean"
)
_VALUE = pa.struct([("l", pa.int64()), ("d", pa.float64()), ("t", pa.string())])
_CHUNKS = pa.schema([
    ("path", pa.string()), ("row_group", pa.int32()), ("n_rows", pa.int64()), ("column_name", pa.string()), ("bytes", pa.int64()), ("nulls", pa.int64()),
    ("lo", pa.int64()), ("hi", pa.int64()), ("candidates", pa.list_(_VALUE)), ("candidates_exact", pa.bool_()),
])
#: Fixed values of the Parquet format: data page encodings that refer to the dictionary.
DICTIONARY_ENCODINGS = (2, 8)
#: Dictionaries above this size are not decoded; the chunk then counts as insufficient.
MAX_DICTIONARY_BYTES = 4 << 20


def _varint(buf: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = buf[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _zigzag(buf: memoryview, at: int) -> tuple[int, int]:
    value, at = _varint(buf, at)
    return (value >> 1) ^ -(value & 1), at


def _skip_or_read(buf: memoryview, at: int, kind: int) -> tuple[object, int]:
    """A value of the compact protocol's type ``kind``; structs become {field id: value}."""
    if kind in (1, 2):
        return kind == 1, at
    if kind == 3:
        return buf[at], at + 1
    if kind in (4, 5, 6):
        return _zigzag(buf, at)
    if kind == 7:
        return None, at + 8
    if kind == 8:
        size, at = _varint(buf, at)
        return None, at + size
    if kind in (9, 10):
        size, inner = buf[at] >> 4, buf[at] & 15
        at += 1
        if size == 15:
            size, at = _varint(buf, at)
        for _ in range(size):
            _, at = (None, at + 1) if inner in (1, 2) else _skip_or_read(buf, at, inner)
        return None, at
    if kind != 12:
        raise ValueError(f"type {kind} does not occur in page headers")
    fields, last = {}, 0
    while True:
        head = buf[at]
        at += 1
        if not head:
            return fields, at
        if head >> 4:
            last += head >> 4
        else:
            last, at = _zigzag(buf, at)
        fields[last], at = _skip_or_read(buf, at, head & 15)


def _page_header(file: pa.NativeFile, at: int, end: int) -> tuple[dict, int]:
    """The header of the page at an offset, and the offset of its body."""
    for size in (256, 1 << 16):  # statistics of long strings can make a header long
        file.seek(at)
        buf = memoryview(file.read(min(size, end - at)))
        try:
            fields, used = _skip_or_read(buf, 0, 12)
            return fields, at + used
        except IndexError:
            continue
    raise ValueError("page header too long")


#: Fixed values of the Parquet format: little-endian numbers by physical type.
_FIXED = {"INT32": ("i", 4), "INT64": ("q", 8), "FLOAT": ("f", 4), "DOUBLE": ("d", 8)}


def kind_of(kind: pa.DataType) -> str | None:
    """Which of l, d and t holds a type's values; none for binary and nested ones."""
    if pa.types.is_integer(kind) or pa.types.is_boolean(kind) or pa.types.is_date32(kind) or pa.types.is_timestamp(kind):
        return "l"
    if pa.types.is_floating(kind) or pa.types.is_decimal(kind):
        return "d"
    return "t" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else None


def as_value(values: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    """A column as BIGINT, DOUBLE or text."""
    kind = values.type
    if pa.types.is_timestamp(kind):
        return values.cast(pa.timestamp("us", kind.tz), safe=False).cast(pa.int64())
    if pa.types.is_date32(kind):
        return values.cast(pa.int32()).cast(pa.int64())
    if pa.types.is_boolean(kind):
        return values.cast(pa.int8()).cast(pa.int64())
    if kind_of(kind) == "d":
        return pc.add(values.cast(pa.float64()), 0.0)  # one zero
    return values.cast(pa.int64() if kind_of(kind) == "l" else pa.string())


def _scale(kind: pa.DataType) -> int | None:
    """Microseconds, days or units in one stored integer; none where stored values cannot be taken as they are."""
    if pa.types.is_timestamp(kind):
        return {"s": 1_000_000, "ms": 1000, "us": 1}.get(kind.unit)
    return None if pa.types.is_decimal(kind) or pa.types.is_unsigned_integer(kind) else 1


def _plain(kind: str, body: memoryview, count: int) -> list | None:
    if kind == "BYTE_ARRAY":
        out, at = [], 0
        for _ in range(count):
            (size,) = struct.unpack_from("<i", body, at)
            out.append(bytes(body[at + 4 : at + 4 + size]).decode("utf-8"))
            at += 4 + size
        return out
    if kind in _FIXED:
        code, width = _FIXED[kind]
        return list(struct.unpack(f"<{count}{code}", body[: width * count]))
    return None


def _candidates(file: pa.NativeFile, col: pq.ColumnChunkMetaData) -> tuple[list | None, bool]:
    """The dictionary of a chunk, and whether all its data pages refer to it."""
    if not col.has_dictionary_page or not col.dictionary_page_offset:
        return None, False
    at, end = col.dictionary_page_offset, col.dictionary_page_offset + col.total_compressed_size
    head, body = _page_header(file, at, end)
    if head[2] > MAX_DICTIONARY_BYTES:
        return None, False
    file.seek(body)
    raw = file.read(head[3])
    if col.compression != "UNCOMPRESSED":
        raw = pa.Codec(col.compression.lower()).decompress(raw, head[2])
    values = _plain(col.physical_type, memoryview(raw), head[7][1])
    at, left = body + head[3], col.num_values
    while left > 0:
        head, body = _page_header(file, at, end)
        page = head.get(5) or head.get(8)
        if not page or page[2 if 5 in head else 4] not in DICTIONARY_ENCODINGS:
            return values, False
        left -= page[1]
        at = body + head[3]
    return values, values is not None


def _chunk(file: pa.NativeFile, col: pq.ColumnChunkMetaData, kind: pa.DataType) -> tuple:
    """(nulls, lo, hi, candidates, whether they are exact) of one chunk, null where the file does not say."""
    stats, scale, of = (col.statistics if col.is_stats_set else None), _scale(kind), kind_of(kind)
    nulls = stats.null_count if stats and stats.has_null_count else None
    lo = hi = values = None
    exact = False
    if of == "l" and scale and stats and stats.has_min_max and col.physical_type in ("INT32", "INT64", "BOOLEAN"):
        lo, hi = int(stats.min_raw) * scale, int(stats.max_raw) * scale
    if scale and of and (col.physical_type in _FIXED or of == "t"):
        try:
            values, exact = _candidates(file, col)
        except (ValueError, KeyError, IndexError, struct.error, pa.ArrowException):
            values, exact = None, False
        if values is not None and of == "l":
            values = [v * scale for v in values]
        elif values is not None and of == "d":
            values = list({v + 0.0: None for v in values})
    if not exact and lo is not None and (lo == hi or col.physical_type == "BOOLEAN"):
        values, exact = sorted({lo, hi}), True
    if not exact and nulls == col.num_values:
        values, exact = [], True
    return nulls, lo, hi, None if values is None else [{of: v} for v in values], exact


def _read(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, inner = pafs.FileSystem.from_uri(path)
            rows = []
            with fs.open_input_file(inner) as file:
                held = pq.ParquetFile(file)
                meta, schema = held.metadata, held.schema_arrow
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        col = group.column(c)
                        name = col.path_in_schema
                        if name in columns:
                            found = _chunk(file, col, schema.field(name).type)
                            rows.append((path, g, group.num_rows, name, col.total_compressed_size, *found))
            yield pa.RecordBatch.from_pylist([dict(zip(_CHUNKS.names, r, strict=True)) for r in rows], _CHUNKS)


def column_chunks(spark: SparkSession, files: list[str], columns: list[str]) -> DataFrame:
    """One row per file, row group and column: what is known without reading data.

    ``nulls``, ``lo`` and ``hi`` are null where the footer does not hold them
    exactly (extrema of texts may be cut and those of floating numbers hide NaN, so they are never taken);
    ``candidates`` holds every non-null value of the chunk if ``candidates_exact``; ``bytes`` is its stored size.
    """
    tasks = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(tasks, "path")
    return listed.mapInArrow(lambda it: _read(it, columns), CHUNKS)


#: Rows of a row group that are counted at once.
SCAN_ROWS = 1 << 17


def _count(batches: Iterator[pa.RecordBatch], keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            fs, inner = pafs.FileSystem.from_uri(r["path"])
            with fs.open_input_file(inner) as file:
                held = pq.ParquetFile(file)
                for part in held.iter_batches(SCAN_ROWS, row_groups=[r["row_group"]], columns=[*keys, *r["columns"]], use_threads=False):
                    groups = {k: part.column(k).cast(schema.field(k).type) for k in keys}
                    for c in r["columns"]:
                        v = as_value(part.column(c))
                        counted = pa.table({**groups, "_v": v}).group_by([*keys, "_v"], use_threads=False).aggregate([([], "count_all")])
                        of = {pa.int64(): "l", pa.float64(): "d", pa.string(): "t"}[v.type]
                        n = counted.num_rows
                        value = {x: counted["_v"] if x == of else pa.nulls(n, _VALUE.field(x).type) for x in "ldt"}
                        rows = {k: counted[k] for k in keys} | {"column_name": pa.array([c] * n, pa.string())} | value | {"n": counted["count_all"]}
                        yield from pa.table(rows).cast(schema).combine_chunks().to_batches()


def chunk_counts(chunks: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by ``keys``, ``column_name`` and value (null included) of single chunks (path, row_group, column_name), which alone are read.

    The keys' chunks of the same row groups are read too.  Counts are per part of a chunk, to be summed.
    """
    spark = table.sparkSession
    kinds = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64()}
    fields = [(k, kinds[table.schema[k].dataType]) for k in keys]
    schema = pa.schema([*fields, ("column_name", pa.string()), *[(f.name, f.type) for f in _VALUE], ("n", pa.int64())])
    named = "".join(f"`{k}` {table.schema[k].dataType.simpleString()}, " for k in keys)
    groups = chunks.groupBy("path", "row_group").agg(F.sort_array(F.collect_list("column_name")).alias("columns"))
    dealt = groups.repartition(spark.sparkContext.defaultParallelism * 4, "path", "row_group")
    return dealt.mapInArrow(lambda it: _count(it, keys, schema), f"{named}column_name string, {VALUE}, n bigint")
