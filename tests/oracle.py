"""Runs queries against their SQL: python tests/oracle.py [SF] [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings locus_map annotations "
    "cluster_to_go_functions genome_summary genome_summary_raw eval_items mix_targets"
).split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


def _cell(x: object) -> object:
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.9g}")
    if isinstance(x, list | tuple):
        return tuple(map(_cell, x))
    return x


def rows(names: list[str], data: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name: str, query, sql: str | None, sf_dir: str, con) -> str:
    """Empty if both agree, else how they differ."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return ""
    rel = con.sql(sql)
    if sorted(rel.columns) != sorted(df.columns):
        return f"columns {df.columns} and {rel.columns}"
    want = rows(rel.columns, rel.fetchall())
    if got == want:
        return ""
    only, other = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
    return f"{len(got)} and {len(want)} rows; only here {only}; only in SQL {other}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from tests.conftest import session

    spark, (sf, *names) = session(), sys.argv[1:] or ["sf0.01"]
    con, bad = views(str(DATA / sf)), 0
    for n, q in e.queries().items():
        if names and not any(n.startswith(x) for x in names):
            continue
        began = time.time()
        try:
            said = compare(spark, n, q, e.oracle_sql().get(n), str(DATA / sf), con)
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += bool(said)
        print(f"{n}: {said or 'same' if n in e.oracle_sql() or said else 'ran'} {time.time() - began:.1f}s", flush=True)
    sys.exit(bad)
