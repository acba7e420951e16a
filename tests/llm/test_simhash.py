import random

import numpy as np
import pytest

from tests.llm import brute
from vireo.llm import simhash
from vireo.llm.components import connected_components


def test_every_word_has_one_or_six_keys_and_two_errors_share_one():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 3000)
    k, n = simhash.golay_keys(v)
    assert set(n.tolist()) <= {1, 6}
    for _ in range(3):
        u = v ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
        ku, nu = simhash.golay_keys(u)
        assert all(set(a[:x]) & set(b[:y]) for a, x, b, y in zip(k.tolist(), n, ku.tolist(), nu))


def test_four_errors_share_a_key():
    rng = random.Random(2)
    fp = [rng.getrandbits(64) for _ in range(2000)]
    other = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for x in fp]
    keys = lambda xs: [set(), *[set() for _ in xs[1:]]]
    a, b = keys(fp), keys(other)
    for found, xs in ((a, fp), (b, other)):
        for r, k in zip(*map(np.ndarray.tolist, simhash.fuzzy_keys(np.array(xs, np.uint64)))):
            found[r].add(k)
    assert all(x & y for x, y in zip(a, b))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one two three", "a b c d", "Ä ä É x y z" * 50, "x " * 700, "\x0bA\x0cb\x1cc d e f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute.simhash(text)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp string")


def check(spark, rows):
    got = simhash.near_duplicates(docs_of(spark, [(d, t, "x", "y") for d, t in rows])).collect()
    fp = [(d, brute.simhash(t)) for d, t in rows]
    least = {}
    for d, x in fp:
        least[x] = min((y for y in (least.get(x), d) if y is not None), default=None)
    comp = brute.components(least, lambda a, b: (a ^ b).bit_count() <= 4)
    smallest = {}
    for x, c in comp.items():
        smallest[c] = min((y for y in (smallest.get(c), least[x]) if y is not None), default=None)
    want = sorted(((d, x, smallest[comp[x]]) for d, x in fp), key=str)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == want


def test_planted_and_odd_rows(spark):
    rng = random.Random(3)
    rows = []
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(12)]
    for i in range(260):
        w = base[i % 12].split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "short"), (None, "short"), (5003, "short"), (5004, "x" * 300000), (None, None)]
    check(spark, rows)


def test_empty_and_test_table(spark, sf_dir):
    check(spark, [])
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, rows)


def test_tight_group_links_as_a_tree():
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 1 << 11, 900).astype(np.uint64))
    a, b = simhash._tree(fp, 4)
    assert len(a) == len(fp) - 1 and len(set(b)) == len(b)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7000, None), (5, 5)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(200)}) == 1
    assert got[0] != got[1000] and len(got) == 501
