"""Runs a registered query and its SQL on DuckDB over one data folder and compares rows as the driver does."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(map(cell, v))
        if isinstance(v, dict):
            return tuple(sorted((k, cell(x)) for k, x in v.items()))
        return v

    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def differs(spark, con, query, sql, folder):
    """None, or what differs."""
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return None
    only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} and {len(want)} rows; only here {only[0]}; only there {only[1]}"
