"""A query against its SQL in DuckDB: names, row count and values, whatever the row order."""

import datetime as dt
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir, tables=TABLES):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, dt.date) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, query, text, sf_dir):
    """None, or what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(text)
    names = [x[0] for x in cur.description]
    expected = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    bad = [(a, b) for a, b in zip(got, expected, strict=True) if a != b and not near(a, b)]
    return f"{len(bad)} of {len(got)} rows, such as {bad[0]}" if bad else None


def near(a, b):
    return all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 for x, y in zip(a, b, strict=True))
