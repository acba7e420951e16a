import random
from collections import defaultdict

import pytest

from tests.llm import brute
from vireo.llm.mixing import mix, mixed


def targets(size, cycle=(1, 2, 3)):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total, full, out = sum(size.values()), set(), {}
    while True:
        left = total - sum(3 * size[s] for s in full)
        w = sum(weight[s] for s in size if s not in full)
        out = {s: 3.0 * size[s] if s in full else left * weight[s] / w for s in size}
        over = {s for s in size if s not in full and out[s] > 3 * size[s]}
        if not over:
            return out
        full |= over


def check(spark, rows, near):
    df = spark.createDataFrame([(d, t, s, 9, "x") for d, t, s in rows], "doc_id long, text string, source string, size int, odds string")
    got = mix(df).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(brute.words(t))
    want, took = targets(size) if rows else {}, defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        took[r.source] += r.taken
    for s in size:
        assert abs(took[s] - want[s]) <= max(near * want[s], 1), (s, took[s], want[s])
    again = mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_test_table(spark, sf_dir):
    check(spark, [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()], 0.05)


def test_hot_small_and_null_sources(spark):
    rng = random.Random(1)
    say = lambda n: "w " * n
    rows = [(i, say(rng.randrange(1, 300)), "hot") for i in range(3000)]
    rows += [(10_000 + i, say(rng.randrange(1, 9)), rng.choice(["a", "b", "ä", "Z", None])) for i in range(500)]
    rows += [(20_000, None, "empty"), (20_001, "", "empty"), (None, say(5), "a"), (3, say(7), "b"), (3, say(9), "b"), (20_002, say(4), "single")]
    check(spark, rows, 0.02)
    check(spark, [(i, say(10), "only") for i in range(50)], 0)
    check(spark, [], 0)
    check(spark, [(1, None, None), (2, "", "x")], 0)


def test_rows_of_the_mix(spark):
    rows = [(i, f"{i} w x " * (1 + i % 5), rng, i) for i in range(300) for rng in [["a", "b", None][i % 3]]] + [(7, "same", "a", 1), (7, "same", "a", 1), (None, "no id", None, None), (9, None, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    want = sorted(str((r.doc_id, r.source)) for r in mix(docs).collect() for _ in range(r.copies))
    got = mixed(docs)
    assert got.columns == docs.columns and sorted(str((r.doc_id, r.source)) for r in got.collect()) == want


def test_chance_is_in_proportion_to_size(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i // 3 % 7), f"s{i % 3}") for i in range(21_000)], "doc_id long, text string, source string")
    got = mix(docs).groupBy("source", "size").agg({"copies": "avg"}).collect()
    mean = {(r[0], r[1]): r[2] for r in got}
    # targets are 1/2, 1 and 3/2 of the sources' sizes; a chance is rate * size
    rate = 0.5 * sum(range(1, 8)) / sum(x * x for x in range(1, 8))
    for x in range(1, 8):
        assert abs(mean[("s0", x)] - rate * x) < 0.06 and mean[("s1", x)] == 1 and abs(mean[("s2", x)] - 1 - rate * x) < 0.06


def test_equal_rows_are_drawn_each_for_itself(spark):
    rows = [(7, "w w w", "a")] * 2000 + [(i, "x y", "b") for i in range(1500)] + [(None, "t t", "c")] * 3000
    check(spark, rows, 0.0011)
    docs = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "doc_id long, text string, source string, _mix_copy2 int")
    got = {r.source: r["count"] for r in mixed(docs).groupBy("source").count().collect()}
    want = {r.source: r["sum(copies)"] for r in mix(docs).groupBy("source").sum("copies").collect()}
    assert got == want


def test_one_very_long_document(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(50, 400), "a") for i in range(400)] + [(900, "w " * 60_000, "a")] + [(1000 + i, "w " * 300, s) for i in range(300) for s in "bc"]
    check(spark, rows, 0.0011)


def test_ranges_of_a_hot_source(spark, monkeypatch):
    from vireo.llm import mixing

    docs = spark.createDataFrame([(i, "w " * (1 + i * i % 97), "abc"[i * i % 7 % 3]) for i in range(3000)], "doc_id long, text string, source string")
    whole = sorted(map(str, mix(docs).collect()))
    monkeypatch.setattr(mixing, "RANKED", 20)
    assert sorted(map(str, mix(docs).collect())) == whole


@pytest.mark.parametrize("name", ["op2_pareto_mixing"])
def test_oracle(spark, sf_dir, name):
    from tests.llm.oracle import same

    same(spark, sf_dir, name)
