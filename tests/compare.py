"""Run a query and its SQL on the same tables and compare rows, order aside."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(v):
    if hasattr(v, "asDict"):
        v = list(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in at) for r in data), key=repr)


def differences(spark_df, connection, sql, show=3):
    """None if equal, else a description."""
    got = rows(spark_df.columns, spark_df.collect())
    r = connection.execute(sql)
    names = [d[0] for d in r.description]
    want = rows(names, r.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    if got != want:
        only = [x for x in got if x not in set(want)][:show], [x for x in want if x not in set(got)][:show]
        return f"{len(got)} and {len(want)} rows; only in one: {only[0]} {only[1]}"
    return None
