"""Running a query and its SQL side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.01"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(data: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else round(v, 9) + 0.0
    return "null" if v is None else v


def rows(values):
    return sorted((tuple(plain(v) for v in row) for row in values), key=repr)


def check(spark, con, query, sql, data: str = DATA):
    df = query(spark, data)
    names = sorted(df.columns)
    found = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert names == sorted(kinds)
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    order = [d[0] for d in found.description]
    theirs = rows(tuple(r[order.index(c)] for c in names) for r in found.fetchall())
    ours = rows(tuple(r[c] for c in names) for r in df.collect())
    assert ours == theirs
    assert ours
