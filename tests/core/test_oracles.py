"""Every registered query of the engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from vireo.plans.catalog import QUERIES, SQL


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return str(x)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    a = sorted(tuple(cell(r[c]) for c in sorted(names)) for r in got.collect())
    b = sorted(tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall())
    assert len(a) == len(b)
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_probed_clusters_hold_the_exact_neighbours(spark, sf_dir):
    """Recall at 5 of the registered index settings against the exact search."""
    from vireo.operators import clusters
    from vireo.plans import catalog

    points = catalog._points(spark, sf_dir).persist()
    index, near = catalog._index(points), catalog._exact(points).select("qid", "ref_id")
    for probes, least in ((2, 0.9), (8, 0.99)):
        ranked = clusters.rank_probes(catalog._asked(points), index.centroids, probes).select("qid", "cid")
        found = near.join(index.members.select("ref_id", "cid"), "ref_id").join(ranked, ["qid", "cid"])
        assert found.count() >= least * near.count()
