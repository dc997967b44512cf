"""A query's rows against those that its SQL gives in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(v):
    if v is None or v != v:
        return None
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(cell(r[k]) for k in order)) for r in data)


def check(name, spark, sf_dir, queries, oracles):
    got = queries[name](spark, sf_dir)
    con = connect(sf_dir)
    con.execute(oracles[name])
    names = [d[0] for d in con.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, con.fetchall())
