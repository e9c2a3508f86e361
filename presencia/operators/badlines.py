"""Delimited lines that fail to parse, set apart with the reason while the rest loads.

Blocks of lines go through a columnar parser.  A block with lines that it cannot take is
bisected until these stand alone, by running counts of what columnar checks find, so that no part is parsed in
vain; the rest of the block is parsed at once, and lines with invalid values fall out of it
by a mask.  Only the lines set apart are read character by character to name the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines that are parsed at once, and their size in characters at most.
BLOCK, BLOCK_CHARS = 2048, 4 << 20
#: Lines that are read strictly at once if the parser fails on them.
STRICT = 32
BIGINT_MAX = (1 << 63) - 1


@dataclass(frozen=True)
class Layout:
    """Fields in order, the types they load as, and the patterns of the checked ones.

    ``integers`` must be ASCII digits within BIGINT, ``percents`` ASCII digits with an
    optional point and more digits, at most 100; either may be empty.
    """

    fields: tuple[str, ...]
    bigints: tuple[str, ...]
    doubles: tuple[str, ...]
    integers: tuple[str, ...]
    percents: tuple[str, ...]

    def schema(self, line_id: str) -> T.StructType:
        kinds = {**dict.fromkeys(self.bigints, T.LongType()), **dict.fromkeys(self.doubles, T.DoubleType())}
        return T.StructType(
            [T.StructField(line_id, T.LongType()), T.StructField("reason", T.StringType())]
            + [T.StructField(f, kinds.get(f, T.StringType())) for f in self.fields]
        )


#: Fixed patterns, as TESTDATA states the values (a number of 19 digits and more is left to the strict reader).
FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
INTEGER = r"^(?:0*[0-9]{1,18})?$"
PERCENT = r"^(?:0*[0-9]{1,2}(?:\.[0-9]+)?|0*100(?:\.0+)?)?$"
NUMBER = r"^-?[0-9]+(?:\.[0-9]+)?$"
_PERCENT = re.compile(PERCENT[1:-1])


def diagnose(line: str | None, layout: Layout) -> tuple[str | None, list[str]]:
    """The first reason that holds, or none, and the fields: the strict reading of one line."""
    if line is None:
        return "column_count", []
    fields, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            end = at + 1
            while True:
                end = line.find('"', end)
                if end < 0:
                    return "broken_quoting", []
                if line[end + 1 : end + 2] != '"':
                    break
                end += 2
            fields.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
            if at < len(line) and line[at] != "\t":
                return "broken_quoting", []
        else:
            end = line.find("\t", at)
            end = len(line) if end < 0 else end
            fields.append(line[at:end])
            at = end
        if at >= len(line):
            break
        at += 1
    if len(fields) != len(layout.fields):
        return "column_count", fields
    named = dict(zip(layout.fields, fields, strict=True))
    for f in layout.integers:
        if (x := named[f]) and not (x.isascii() and x.isdigit() and int_within(x)):
            return "invalid_value", fields
    for f in layout.percents:
        if not _PERCENT.fullmatch(named[f]):
            return "invalid_value", fields
    return None, fields


def int_within(digits: str) -> bool:
    """Whether ASCII digits of any number fit a BIGINT."""
    significant = digits.lstrip("0")
    return len(significant) < 19 or (len(significant) == 19 and int(significant) <= BIGINT_MAX)


def _typed(columns: list[pa.Array], layout: Layout) -> list[pa.Array]:
    """Text columns as their types; unchecked values that are no numbers become null."""
    out = []
    for name, col in zip(layout.fields, columns, strict=True):
        if name in layout.bigints:
            fits = pc.match_substring_regex(col, r"^-?[0-9]{1,18}$") if name not in layout.integers else pc.not_equal(col, "")
            col = pc.if_else(fits, col, pa.scalar(None, pa.string())).cast(pa.int64())
        elif name in layout.doubles:
            col = pc.if_else(pc.match_substring_regex(col, NUMBER), col, pa.scalar(None, pa.string())).cast(pa.float64())
        else:
            col = pc.if_else(pc.equal(col, ""), pa.scalar(None, pa.string()), col)
        out.append(col)
    return out


def _parseable(lines: pa.Array, layout: Layout) -> np.ndarray:
    """Which lines the columnar parser reads as they are meant: whole fields, as many as there should be, on one line."""
    tabs = pc.equal(pc.count_substring(lines, "\t"), len(layout.fields) - 1)
    quoted = pc.match_substring(lines, '"')
    if pc.any(quoted).as_py():
        whole = pc.match_substring_regex(lines.filter(quoted), f"^{FIELD}(?:\t{FIELD}){{{len(layout.fields) - 1}}}$")
        tabs = pc.replace_with_mask(tabs, quoted, whole)
    broken = pc.match_substring_regex(lines, "[\n\r\x00]")
    return np.asarray(pc.and_not(tabs, broken))


def _isolate(failed: np.ndarray, lo: int, hi: int) -> Iterator[int]:
    """The failing lines of lo..hi by bisection; ``failed[i]`` is how many of the first i lines fail."""
    if failed[lo] == failed[hi]:
        return
    if hi - lo == 1:
        yield lo
        return
    mid = (lo + hi) // 2
    yield from _isolate(failed, lo, mid)
    yield from _isolate(failed, mid, hi)


def _bulk(lines: pa.Array, layout: Layout) -> list[pa.Array] | None:
    """The lines as text columns, or None if the parser fails all the same."""
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_buffer()
    try:
        table = pacsv.read_csv(
            pa.BufferReader(data),
            read_options=pacsv.ReadOptions(column_names=list(layout.fields), use_threads=False, block_size=data.size + 1),
            parse_options=pacsv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(layout.fields, pa.string()), strings_can_be_null=False, check_utf8=False),
        )
    except pa.ArrowInvalid:
        return None
    return [c.combine_chunks() for c in table.columns] if table.num_rows == len(lines) else None


def _valid(columns: list[pa.Array], layout: Layout) -> np.ndarray:
    """Which rows certainly hold valid values."""
    ok = np.ones(len(columns[0]), bool)
    for names, pattern in ((layout.integers, INTEGER), (layout.percents, PERCENT)):
        for name in names:
            ok &= np.asarray(pc.match_substring_regex(columns[layout.fields.index(name)], pattern))
    return ok


def _strict(ids: pa.Array, lines: pa.Array, layout: Layout, schema: pa.Schema) -> pa.RecordBatch:
    """Lines set apart, each with its reason, or typed if it is valid though the fast path could not tell."""
    read = [diagnose(x, layout) for x in lines.to_pylist()]
    reasons = pa.array([r for r, _ in read], pa.string())
    fields = [f if r is None else [""] * len(layout.fields) for r, f in read]
    values = _typed([pa.array([f[k] for f in fields], pa.string()) for k in range(len(layout.fields))], layout)
    return pa.RecordBatch.from_arrays([ids, reasons, *values], schema=schema)


def _parse(ids: pa.Array, lines: pa.Array, layout: Layout, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The lines of a block: valid ones typed, the others with their reasons."""
    if not len(lines):
        return
    texts = pc.fill_null(lines, "")
    failed = np.concatenate([[0], np.cumsum(~_parseable(texts, layout))])
    apart = np.zeros(len(lines), bool)
    apart[list(_isolate(failed, 0, len(lines)))] = True
    rest = np.flatnonzero(~apart)
    columns = _bulk(texts.take(pa.array(rest)), layout) if len(rest) else None
    if columns is not None:
        valid = _valid(columns, layout)
        apart[rest[~valid]] = True
        kept = pa.array(valid)
        held = ids.take(pa.array(rest[valid]))
        typed = _typed([c.filter(kept) for c in columns], layout)
        yield pa.RecordBatch.from_arrays([held, pa.nulls(len(held), pa.string()), *typed], schema=schema)
    elif len(rest) > STRICT:  # the parser does not do as the checks said
        half = len(rest) // 2
        for part in (rest[:half], rest[half:]):
            yield from _parse(ids.take(pa.array(part)), lines.take(pa.array(part)), layout, schema)
    else:
        apart[rest] = True
    if apart.any():
        alone = pa.array(np.flatnonzero(apart))
        yield _strict(ids.take(alone), lines.take(alone), layout, schema)


def read_lines(df: DataFrame, line_id: str, line: str, layout: Layout) -> DataFrame:
    """Every line as a typed row with null ``reason``, or as nulls with the reason why it cannot load.

    Reasons, the first that holds: ``broken_quoting``, ``column_count``,
    ``invalid_value``.  A null line has no columns, an empty one a single column, so both
    are ``column_count``.  Line breaks inside a line are ordinary characters.
    Repeated lines each give a row; an empty table gives none.

    Scale: map-only, without a shuffle; a task holds one block of at most BLOCK lines.
    """
    out = layout.schema(line_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}
        schema = pa.schema([(f.name, kinds[f.dataType]) for f in out.fields])
        for batch in batches:
            ids, lines = batch.column(0), batch.column(1).cast(pa.string())
            sizes = pc.fill_null(pc.binary_length(lines), 0).to_pylist()
            start = chars = 0
            ready = []
            for i, size in enumerate(sizes):
                if i > start and (i - start >= BLOCK or chars + size > BLOCK_CHARS):
                    ready += _parse(ids[start:i], lines[start:i], layout, schema)
                    start, chars = i, 0
                chars += size
            ready += _parse(ids[start:], lines[start:], layout, schema)
            yield from pa.Table.from_batches(ready, schema=schema).combine_chunks().to_batches()  # in the order of the parts

    return df.select(F.col(line_id).cast("bigint"), F.col(line).cast("string")).mapInArrow(run, out)


#: The genome catalogue's lines: the fields in their fixed order.
CATALOGUE = Layout(
    fields=(
        "genome_id", "genome_name", "genome_status", "taxon_id", "genome_length", "patric_cds", "contigs",
        "contig_l50", "contig_n50", "checkm_contamination", "checkm_completeness", "gc_content",
    ),
    bigints=("genome_length", "patric_cds", "contigs", "contig_l50", "contig_n50"),
    doubles=("checkm_contamination", "checkm_completeness", "gc_content"),
    integers=("genome_length", "contig_n50"),
    percents=("checkm_contamination",),
)
