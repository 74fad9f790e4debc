"""Hold a registered query against its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    want = con.sql(sql)
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: kinds[k] for c, k in df.dtypes} == types
    a = sorted(tuple(map(repr, (r[c] for c in cols))) for r in df.collect())
    b = sorted(tuple(map(repr, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
    assert a == b
