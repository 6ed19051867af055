"""Compare a registered query with its SQL on the same Parquet tables."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def key(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(key(r[i]) for i in order) for r in values), sorted(columns)


def differences(df, con, sql):
    got, got_columns = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, want_columns = rows([d[0] for d in cur.description], cur.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} against {want_columns}"
    if got != want:
        extra, lost = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} rows against {len(want)}; only here {sorted(extra)[:3]}; missing {sorted(lost)[:3]}"
    return ""
