"""Rows of a query against those of its SQL."""

import glob
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None:
        return "null"
    if isinstance(x, float):
        return f"{x + 0.0:.9g}"
    if isinstance(x, bool) or not hasattr(x, "as_tuple"):
        return str(x)
    return f"{float(x):.9g}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(row[i]) for i in order) for row in data)


def differences(df, con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs, ours = rows(names, cursor.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(wrong)} of {len(ours)} rows, like {wrong[:2]}" if wrong else ""
