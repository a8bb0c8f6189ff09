"""Compares a query with its SQL in DuckDB, as sorted rows of text."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def cells(row) -> tuple:
    return tuple(None if v is None else repr(v) if isinstance(v, float) else str(v) for v in row)


def both(spark, query, sql: str, sf_dir: str = SF) -> tuple[list[tuple], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((cells(r) for r in df.select(*(f"`{n}`" for n in names)).collect()), key=repr)
    theirs = sorted((cells(r) for r in con.execute("select " + ", ".join(f'"{n}"' for n in names) + f" from ({sql})").fetchall()), key=repr)
    return ours, theirs
