"""Comparing a DataFrame with what DuckDB gives for the same tables."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def duck(sql: str, folder: str = SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def same(df, sql: str, folder: str = SF) -> None:
    names, want = duck(sql, folder)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = sorted(([r[c] for c in order] for r in df.collect()), key=str)
    b = sorted(([r[names.index(c)] for c in order] for r in want), key=str)
    assert a == b
