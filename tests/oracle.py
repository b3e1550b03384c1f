"""Compare a query with its SQL in DuckDB over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.001"


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def normal(rows, order) -> list[tuple[str, ...]]:
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in rows)


def compare(spark, query, sql: str, sf_dir: str = SF_DIR) -> None:
    df = query(spark, sf_dir)
    found = connection(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    a = normal(df.collect(), [df.columns.index(c) for c in sorted(names)])
    b = normal(found.fetchall(), [names.index(c) for c in sorted(names)])
    assert len(a) == len(b)
    assert a == b
