"""Compares a registered query with its SQL on the same tables."""

import math
import os

import duckdb


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return str(x)


def same(spark, sf_dir, name):
    from vireo.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    a = sorted(tuple(value(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(value(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert len(a) == len(b) and a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
