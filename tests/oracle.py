"""Comparison of a query's rows with DuckDB's, order aside."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(x):
    if x is None or isinstance(x, bool):
        return str(x)
    if isinstance(x, int | float | decimal.Decimal):
        return f"{float(x):.6f}"
    return str(x)


def rows(columns, values):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(shown(r[i]) for i in at) for r in values)


def check(spark, con, sf_dir, make, sql):
    df = make(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    done = con.execute(sql)
    columns = [c[0] for c in done.description]
    assert sorted(df.columns) == sorted(columns)
    want = rows(columns, done.fetchall())
    assert got == want
    return got
