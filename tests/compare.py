"""Run a registered query on Spark and its SQL counterpart on another engine and compare."""

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def engine(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() and abs(v) < 2**53 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    out = [tuple(plain(r[i]) for i in at) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def difference(spark_df, con, sql):
    """None when both results are equal, else a short text."""
    left_cols = spark_df.columns
    cur = con.execute(sql)
    right_cols = [d[0] for d in cur.description]
    if sorted(left_cols) != sorted(right_cols):
        return f"columns {sorted(set(left_cols) ^ set(right_cols))}"
    left = rows_of(left_cols, [tuple(r) for r in spark_df.collect()])
    right = rows_of(right_cols, cur.fetchall())
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    if left == right:
        return None
    for a, b in zip(left, right):
        if not all(same(x, y) for x, y in zip(a, b)):
            bad = [(c, x, y) for c, x, y in zip(sorted(left_cols), a, b) if not same(x, y)]
            return f"values {bad[:4]}"
    return None
