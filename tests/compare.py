"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return str(v)


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def kind(t: str) -> str:
    t = t.lower()
    for k, names in {
        "int": ("int", "long", "hugeint"), "float": ("double", "float"), "bool": ("bool",),
        "text": ("string", "varchar"),
    }.items():
        if any(n in t for n in names):
            return k
    return t


def compare(spark, con, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, sf)
    got_rows = df.collect()
    took = time.time() - t0
    rel = con.sql(sql)
    got = rows_of(df.columns, got_rows)
    want = rows_of(rel.columns, rel.fetchall())
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(rel.columns)}")
    else:
        theirs = dict(zip(rel.columns, map(str, rel.types)))
        for name, t in df.dtypes:
            if kind(t) != kind(theirs[name]):
                problems.append(f"type of {name}: {t} != {theirs[name]}")
        if len(got) != len(want):
            problems.append(f"{len(got)} rows, SQL {len(want)}")
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        if bad:
            problems.append(f"{len(bad)} rows differ, columns {sorted(df.columns)}, first {bad[0]}")
    return len(got), took, problems
