"""Order-insensitive comparison of a query's rows with its SQL oracle's."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if hasattr(x, "item") and not hasattr(x, "tolist"):
        x = x.item()
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql):
    """None if equal, or a text that tells the difference."""
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    want = rows(names, out.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} against {names}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want, strict=True):
        if any(abs(x - y) > 2e-4 if isinstance(x, float) and isinstance(y, (int, float)) else x != y for x, y in zip(a, b, strict=True)):
            return f"{a} against {b}"
    return None
