import gzip
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vireo.functions import features as X
from vireo.functions.features import FEATURES, QUANTS
from vireo.operators import clusters, ivf, nearest, report
from vireo.operators.nearest import nearest_exact, nearest_sql, top_k, votes
from vireo.plans.catalog import QUERIES, bodies
from vireo.plans.engine import BuildConfig, Engine, build_config, prepare_references, prepare_transactions, search_config, timeout_micros
from vireo.sources import binary
from vireo.sources.requests import parse_requests, read_payloads, read_references
from vireo.sources.shared import scratch

LEGIT = {
    "id": "tx-1329056812", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]}, "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23}, "last_transaction": None,
}
LAST = {"timestamp": "2026-03-11T18:40:53Z", "km_from_current": 10.0}


def changed(**parts):
    out = json.loads(json.dumps(LEGIT))
    for k, v in parts.items():
        out[k] = {**out[k], **v} if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def parsed(spark, requests):
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(requests)]
    return parse_requests(spark.createDataFrame(rows, "qid long, body string"))


def vectors_of(spark, requests, encoding="i16"):
    return prepare_transactions(parsed(spark, requests).select("qid", "request.*"), encoding=encoding).orderBy("qid").collect()


def test_documented_example(spark):
    row = vectors_of(spark, [LEGIT])[0]
    want = [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006]
    assert all(abs(row[f] - w) < 1e-4 for f, w in zip(FEATURES, want))
    assert [row[q] for q in QUANTS] == [41, 1667, 500, 7826, 3333, -10000, -10000, 292, 1500, 0, 10000, 0, 1500, 60]
    u8 = vectors_of(spark, [LEGIT], "u8")[0]
    assert [u8[q] for q in QUANTS] == [129, 149, 134, 227, 170, 0, 0, 132, 147, 128, 255, 128, 147, 129]


def test_edges_of_features(spark):
    rows = vectors_of(spark, [
        changed(transaction={"requested_at": "2026-03-11T23:30:00-03:00"}),
        changed(last_transaction={**LAST, "timestamp": "2026-03-12T18:45:53Z"}),
        changed(customer={"avg_amount": 0}), changed(customer={"avg_amount": -5}),
        changed(transaction={"amount": -3}), changed(merchant={"mcc": "05411"}), changed(last_transaction=LAST),
    ])
    assert abs(rows[0].f3 - 2 / 23) < 1e-6 and abs(rows[0].f4 - 3 / 6) < 1e-6
    assert rows[1].f5 == 0 and abs(rows[1].f6 - 0.01) < 1e-7
    assert rows[2].f2 == rows[3].f2 == 1 and rows[4].f0 == 0 and rows[5].f12 == 0.5
    assert abs(rows[6].f5 - 5 / 1440) < 1e-7


def test_clamped_minus_zero_is_zero(spark):
    rows = spark.createDataFrame([(x,) for x in (-0.0, 0.0, float("nan"), -1.0, 0.5, 2.0, float("inf"), float("-inf"))], "x float")
    got = np.array([r.y for r in rows.select(X.clamp01(F.col("x")).alias("y")).collect()])
    assert got.tolist() == [0, 0, 0, 0, 0.5, 1, 1, 0] and not np.signbit(got).any()


def test_broken_bodies_are_invalid(spark):
    text = json.dumps(LEGIT)
    good = [text, json.dumps(changed(extra=[1])), json.dumps({k: v for k, v in LEGIT.items() if k != "last_transaction"}), json.dumps(changed(last_transaction=LAST)), json.dumps(changed(transaction={"amount": 5}))]
    bad = [
        "", "not json", text + " x", text.replace('"installments": 2', '"installments": 300'), text.replace('"installments": 2', '"installments": 2.0'), text.replace('"installments": 2', '"installments": "2"'),
        text.replace('"installments": 2', '"installments": true'), text.replace('"id": "tx-1329056812"', '"id": 5'), text.replace('"id": "tx', '"id": "a", "id": "tx'), text.replace('"mcc"', '"mc"'),
        text.replace('"MERC-003"', "null"), text.replace("2026-03-11T18:45:53Z", "2026-03-11"), text.replace("2026-03-11T18:45:53Z", "2026-03-11T18:45:53"), json.dumps(changed(last_transaction={"timestamp": LAST["timestamp"]})),
        "[1]", "null", text.replace("41.12", "NaN"),
    ]
    got = {r.qid: r.valid for r in parsed(spark, good + bad).collect()}
    assert [got[i] for i in range(len(good) + len(bad))] == [True] * len(good) + [False] * len(bad)
    engine = Engine(spark, BuildConfig("exact"))
    engine.build(spark.createDataFrame([(0, [0.5] * 14, "fraud")], "ref_id long, vector array<float>, label string"))
    rows = engine.score_bodies(spark.createDataFrame([(0, text), (1, "no"), (2, None)], "qid long, body string")).orderBy("qid").collect()
    assert [(r.status, r.votes, r.response) for r in rows] == [("ok", 1, X.RESPONSES[1]), ("invalid", 0, X.RESPONSES[0]), ("invalid", 0, X.RESPONSES[0])]


def test_responses():
    assert X.RESPONSES[0] == '{"approved":true,"fraud_score":0.0}' and X.RESPONSES[2] == '{"approved":true,"fraud_score":0.4}'
    assert X.RESPONSES[3] == '{"approved":false,"fraud_score":0.6}' and X.RESPONSES[5] == '{"approved":false,"fraud_score":1.0}'


def test_distance_does_not_overflow(spark):
    one = spark.range(1).select(*[F.lit(32000).alias(q) for q in QUANTS], *[F.lit(0).alias(f"r{q}") for q in QUANTS])
    assert one.select(X.squared_distance([F.col(q) for q in QUANTS], [F.col(f"r{q}") for q in QUANTS])).first()[0] == 14 * 32000**2
    q, r = [10000, 0, -10000, 500, 900, *range(1, 10)], [9000, 1, -9000, 400, 800, *range(9, 0, -1)]
    pair = spark.createDataFrame([(*q, *r)], [*[f"a{i}" for i in range(14)], *[f"b{i}" for i in range(14)]])
    assert pair.select(X.squared_distance([F.col(f"a{i}") for i in range(14)], [F.col(f"b{i}") for i in range(14)])).first()[0] == 2020241


def refs_of(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)], "ref_id long, vector array<float>, label string")


def asked(spark, vectors, encoding="i16"):
    rows = spark.createDataFrame([(i, [float(x) for x in v], "legit") for i, v in enumerate(vectors)], "ref_id long, vector array<float>, label string")
    return prepare_references(rows, encoding).withColumnRenamed("ref_id", "qid").drop("label")


def test_six_references_score_three_fifths(spark):
    dims = [(d, label) for d, label in zip((0, 0.02, 0.04, 0.06, 0.08), ("legit", "fraud", "fraud", "fraud", "legit"))]
    engine = Engine(spark, BuildConfig("exact")).build(refs_of(spark, [([d] + [0] * 13, label) for d, label in dims] + [([1] * 14, "fraud")]))
    assert len(engine) == 6 and engine.ready()
    assert engine.vote(asked(spark, [[0] * 14], "u8")).first().votes == 3


def test_few_no_and_tied_references(spark):
    q = asked(spark, [[0] * 14])
    empty = prepare_references(refs_of(spark, []))
    assert votes(q, nearest_exact(q, empty)).first().votes == 0
    three = prepare_references(refs_of(spark, [([0.1] * 14, "fraud")] * 3))
    assert votes(q, nearest_exact(q, three)).first().votes == 3
    ties = prepare_references(refs_of(spark, [([0.1] * 14, "fraud" if i < 4 else "legit") for i in range(40)])).repartition(7)
    got = nearest_exact(q, ties).orderBy("place").collect()
    assert [r.ref_id for r in got] == [0, 1, 2, 3, 4] and votes(q, nearest_exact(q, ties)).first().votes == 4
    index = Engine(spark, BuildConfig(clusters=4)).build(refs_of(spark, []))
    assert index.vote(q).first().votes == 0 and len(index.index.centroids) == 1


def random_index(spark, n=1500, k=24, seed=5):
    rng = random.Random(seed)
    rows = [([rng.choice([rng.random() ** 3, -1.0]) if d in (5, 6) else round(rng.random() ** 2, 2) for d in range(14)], rng.choice(["fraud", "legit", "legit"])) for _ in range(n)]
    engine = Engine(spark, BuildConfig(clusters=k, sample=400, iterations=4)).build(refs_of(spark, rows))
    return engine, asked(spark, [[rng.random() ** 2 for _ in range(14)] for _ in range(60)])


def test_kernel_is_the_sql_and_blocks_do_not_matter(spark):
    engine, q = random_index(spark)
    keys = lambda df: sorted(map(tuple, df.select("qid", "place", "ref_id", "dist", "label").collect()))
    want = keys(nearest_sql(q, engine.references))
    assert keys(nearest_exact(q, engine.references)) == want == keys(nearest_exact(q, engine.references.repartition(9), block=17))


def test_exact_search_compares_few_pairs(spark):
    rng = np.random.default_rng(3)
    n = 6000
    refs = rng.integers(0, 10_000, (n, 14)) * (rng.random(14) < 0.3)
    refs[n // 2 :] = refs[: n // 2]  # copies, so that ids decide
    refs[:9] = 77
    ids, labels = rng.permutation(n), rng.integers(0, 2, n)
    asked = np.r_[refs[::20], refs[:3] + 1]
    tree = nearest._Tree(refs, ids, labels, 5)
    dist, ref, label, row = tree.search(asked)
    assert tree.compared < 0.3 * len(asked) * n
    d = ((asked[:, None, :] - refs[None]) ** 2).sum(2)
    for i in range(len(asked)):
        at = np.lexsort((ids, d[i]))[:5]
        own = np.flatnonzero(row == i)
        own = own[np.lexsort((ref[own], dist[own]))][:5]
        assert ref[own].tolist() == ids[at].tolist() and dist[own].tolist() == d[i][at].tolist() and label[own].tolist() == labels[at].tolist()


def test_points_with_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(nearest, "_ODD", np.zeros(64, np.int64))
    points = np.array([[1, 2], [3, 4], [1, 2], [3, 5]])
    assert len(set(nearest._classes(points).tolist())) == 3
    assert sorted(nearest._first_of_equal(points, np.array([9, 8, 7, 6]), 1).tolist()) == [1, 2, 3]


def test_many_blocks_give_the_rows_of_one(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 60, (900, 14))
    rows = spark.createDataFrame([(i, int(i % 2), *map(int, v)) for i, v in enumerate(values)], "ref_id long, label int, " + ", ".join(f"{q} int" for q in QUANTS))
    asked = rows.where("ref_id % 20 = 0").withColumnRenamed("ref_id", "qid")
    want = sorted(nearest_sql(asked, rows).collect())
    assert sorted(nearest_exact(asked, rows, block=40).select(*nearest_sql(asked, rows).columns).collect()) == want


def test_parts_of_blocks_go_between_tasks(spark):
    """A task sends a row for each block, not for each point; parts hold the numbers as they were."""
    rng = np.random.default_rng(5)
    points = rng.integers(-10_000, 10_001, (400, 14))
    rows = [(int(1 << 40) + i, int(i % 2), *map(int, p)) for i, p in enumerate(points)]
    refs = spark.createDataFrame(rows, "ref_id long, label long, " + ", ".join(f"{q} int" for q in QUANTS)).repartition(3)
    nodes = nearest._planes(points, 4)
    parts = nearest._blocked(refs, nodes, 5).toArrow()
    assert parts.num_rows <= 3 * 4 and sum(parts["n"].to_pylist()) == 400
    ids, got, column = nearest._opened(parts)
    assert sorted(zip(ids.tolist(), column("labels").tolist(), got.tolist())) == [(r[0], r[1], list(r[2:])) for r in rows]
    for numbers in ([], [0], [-128, 127], [128], [-32769], [1 << 31], [np.iinfo(np.int64).max]):
        n = np.array(numbers, np.int64)
        assert nearest._numbers(pa.array([nearest._bytes(n)] * min(1, len(n))), [len(n)] * min(1, len(n))).tolist() == numbers


def test_merchant_is_that_of_the_json(spark):
    """Text that is cut without a parser gives what the parser gives."""
    from vireo.plans.adapters import _merchant

    texts = ['{"k": 7}', '{"k": 0}', '{"k": 999999999}', '{"k": 2147483647}', '{"k": 07}', '{"k": -3}', '{"k":5}', '{"k": 5}\n', ' {"k": 5}', '{"k": "5"}', '{"k": 5, "j": 1}', '{"j": 5}', '{"k": null}', '{"k": }', "{", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, props string")
    got = df.select("i", _merchant(F.col("props")).alias("a"), F.get_json_object("props", "$.k").cast("int").alias("b")).collect()
    assert all(r.a == r.b for r in got), [(texts[r.i], r.a, r.b) for r in got if r.a != r.b]
    assert sum(r.a is not None for r in got) >= 9


def test_scored_bodies_make_the_transactions_once(spark, sf_dir, monkeypatch):
    from vireo.plans import catalog

    made, real = [], catalog.transactions
    monkeypatch.setattr(catalog, "transactions", lambda *a: made.append(a) or real(*a))
    assert catalog.score_bodies(spark, sf_dir).count() > 0
    assert len(made) == 1


def test_points_of_leaves_are_those_of_nested_transactions(spark, sf_dir):
    from vireo.plans import adapters, catalog

    flat = catalog._points(spark, sf_dir).select("qid", "label", *FEATURES, *QUANTS)
    t = adapters.transactions(spark, sf_dir)
    other = X.with_quants(t.select("qid", X.label_code(F.col("label")).alias("label"), *X.vector()))
    assert sorted(flat.collect()) == sorted(other.collect())
    kept = catalog._whole(catalog._points(spark, sf_dir)).select("qid", "label", *QUANTS)
    assert sorted(kept.collect()) == sorted(flat.select("qid", "label", *QUANTS).collect())


def test_events_meet_by_user_only(spark, sf_dir, monkeypatch):
    """Rows are not dealt by merchant if merchants are few, and are right if they are many."""
    from vireo.plans import adapters

    few = adapters._events(spark, sf_dir)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(user_id" in plan and plan.count("Sort [") == 1
    monkeypatch.setattr(adapters, "_MOST_SHOPS", 3)
    many = adapters._events(spark, sf_dir)
    assert "Exchange hashpartitioning(k" in many._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(df.withColumn("known", F.sort_array("known")).select(sorted(df.columns)).collect(), key=lambda r: r.event_id)
    assert rows(few) == rows(many)


def test_events_without_time_user_or_merchant(spark, tmp_path):
    """The day of an event without a time has the user's other such events."""
    from vireo.plans import adapters

    rows = [(0, None, 1, "view", 1.0, '{"k": 2}'), (1, None, 1, "purchase", 2.0, '{"k": 3}'), (2, "2024-01-01 00:00:00", 1, "view", 4.0, '{"k": 3}'),
            (3, "2024-01-02 00:00:00", 1, "view", 5.0, '{"k": 2}'), (4, "2024-01-02 00:00:00.000001", 1, "error", 6.0, '{"k": 2}'),
            (5, "2024-01-02 00:00:00", None, "view", 7.0, '{"k": 2}'), (6, "2024-01-02 00:00:01", 1, "purchase", 8.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.qid: r for r in adapters.transactions(spark, str(tmp_path)).collect()}
    assert {i: r.customer.tx_count_24h for i, r in got.items()} == {0: 2, 1: 2, 2: 1, 3: 2, 4: 2}
    assert all(r.customer.known_merchants == ["M3"] for r in got.values())
    assert got[2].customer.avg_amount == pytest.approx(26 / 6) and got[2].merchant.avg_amount == 3.0 and got[3].merchant.avg_amount == 4.75


def test_points_are_packed_whole(spark):
    for kind, ends in (("short", (-(2**15), 2**15 - 1)), ("int", (-(2**31), 2**31 - 1))):
        rows = [[v if j == i else other for j in range(14)] for i in range(14) for v in ends for other in (0, -1)]
        df = spark.createDataFrame(rows, ", ".join(f"{q} {kind}" for q in QUANTS))
        words, bits = X.packed(df)
        assert len(words) == (4 if kind == "short" else 7)
        back = df.select(*words).select(*X.unpacked(bits))
        assert back.dtypes == df.dtypes and [list(r) for r in back.collect()] == rows


def test_search_takes_short_and_int_points_alike(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(2)), *map(int, rng.integers(-10_000, 10_001, 14))) for i in range(400)]
    refs = spark.createDataFrame(rows, "ref_id long, label int, " + ", ".join(f"{q} int" for q in QUANTS))
    short = refs.select("ref_id", "label", *[F.col(q).cast("short").alias(q) for q in QUANTS])
    asked = lambda df: df.where("ref_id % 20 = 0").withColumnRenamed("ref_id", "qid")
    found = [sorted(nearest_exact(asked(q), r, block=100).collect()) for q in (refs, short) for r in (refs, short)]
    assert len(found[0]) == 100 and all(f == found[0] for f in found)


def test_written_bodies_need_no_python(spark, monkeypatch):
    """Bodies as request_text makes them are judged without Python, others by it."""
    from vireo.sources import requests

    asked = F.udf(lambda text: False if text is None else None, "boolean")  # null for what Python is asked
    text = json.dumps(changed(last_transaction=LAST), separators=(",", ":"))
    request = parsed(spark, [text]).select("request.*")
    body = request.select(requests.request_text(request.columns).alias("body")).first().body
    other = ['{"extra":1,' + body[1:], body.replace('"installments":2', '"installments":2,"installments":2'), body + " x", "not json"]
    df = spark.createDataFrame(list(enumerate([body, *other])), "qid long, body string")
    monkeypatch.setattr(requests, "_strict", asked)
    assert [r.valid for r in requests.parse_requests(df).orderBy("qid").collect()] == [True, None, None, None, False]


def test_layout_and_repair(spark):
    engine, q = random_index(spark)
    rows = engine.index.clusters.orderBy("cid").collect()
    assert [r.offset for r in rows] == [sum(x.n for x in rows[:i]) for i in range(len(rows))] and sum(r.n for r in rows) == 1500
    m = engine.index.members.join(engine.index.clusters, "cid")
    outside = " or ".join(f"{x} < {lo} or {x} > {hi}" for x, lo, hi in zip(QUANTS, clusters.LOW, clusters.HIGH))
    assert m.where(outside).count() == 0
    exact = votes(q, nearest_exact(q, engine.references))
    exact_rows = {r.qid: r.votes for r in exact.collect()}
    search = lambda **c: {r.qid: (r.votes, r.status) for r in ivf.search(q, engine.index, ivf.SearchConfig(**c)).collect()}
    repaired, fast, two = search(probes=1, repair=True), search(probes=2), search(probes=2, full_probes=8)
    assert {k: v[0] for k, v in repaired.items()} == exact_rows
    assert all(two[k] == fast[k] for k in fast if fast[k][0] not in (2, 3))
    assert {k: v[0] for k, v in search(probes=64).items()} == exact_rows
    none, some, all_ = search(probes=2, budget=0), search(probes=2, full_probes=8, budget=150), search(probes=2, full_probes=8, budget=10**9)
    assert set(none.values()) == {(0, "timed_out")} and all_ == two
    assert all(v in (fast[k], two[k], (0, "timed_out")) for k, v in some.items())
    got = report.compare_scores(exact, ivf.search(q, engine.index, ivf.SearchConfig(probes=2))).first()
    assert got.payloads == 60 and got.score_mismatches == sum(exact_rows[k] != fast[k][0] for k in fast)


def test_every_row_is_compared(spark, sf_dir):
    got = QUERIES["compare_scores"](spark, sf_dir).first()
    assert got.payloads == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_equal_points_are_compared_as_often_as_they_are(spark):
    a = spark.createDataFrame([(0, 1), (1, 3), (2, 5)], "qid long, votes int")
    b = spark.createDataFrame([(0, 1), (1, 2), (2, 4)], "qid long, votes int")
    copies = spark.createDataFrame([(0, 4), (1, 3), (2, 2)], "qid long, copies long")
    assert tuple(report.compare_scores(a, b, copies).first()) == (9, 5, 3, 1, 23, 18)
    assert tuple(report.compare_scores(a, b).first()) == (3, 2, 1, 1, 9, 7)
    assert tuple(report.compare_scores(a.limit(0), b, copies).first()) == (0,) * 6


def test_save_load_and_binary(spark):
    engine, q = random_index(spark, 300, 6)
    want = sorted(map(tuple, engine.vote(q).collect()))
    path = scratch(spark, "index")
    engine.save(path)
    assert sorted(map(tuple, Engine(spark, BuildConfig(clusters=6)).load(path).vote(q).collect())) == want
    members = engine.index.members.orderBy("cid", "ref_id").select("cid", "label", *QUANTS).collect()
    back = binary.read_ivf(spark, binary.write_ivf(engine.index, scratch(spark, "ivf")))
    assert np.array_equal(back.centroids, engine.index.centroids)
    assert sorted(map(tuple, back.clusters.collect())) == sorted(map(tuple, engine.index.clusters.collect()))
    assert list(map(tuple, back.members.orderBy("ref_id").select("cid", "label", *QUANTS).collect())) == list(map(tuple, members))
    u8 = prepare_references(refs_of(spark, [([0.1 * (i % 9)] * 14, "fraud" if i % 3 else "legit") for i in range(100)]), "u8").drop(*FEATURES)
    file = binary.write_exact(u8, scratch(spark, "exact"))
    rows = lambda df: sorted(map(tuple, df.select("ref_id", "label", *QUANTS).collect()))
    assert rows(binary.read_exact(spark, file, binary.MAGIC)) == rows(u8)
    for wrong in (lambda: binary.read_exact(spark, file, b"OTHER00\0").count(), lambda: binary.read_ivf(spark, file)):
        with pytest.raises(Exception):
            wrong()


def test_reference_and_payload_files(spark, tmp_path):
    rows = [{"vector": [0, 0, 0, 0, 0, -1, -1, 0, 0, 0, 1, 0, 0.15, 0], "label": "legit"}, {"vector": [1, 1, 1, 1, 1, -1, -1, 1, 1, 1, 0, 1, 0.85, 1], "label": "fraud"}]
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(rows, f)
    refs = read_references(spark, str(tmp_path / "r.json.gz"))
    assert [(r.ref_id, r.label) for r in refs.orderBy("ref_id").collect()] == [(0, "legit"), (1, "fraud")]
    engine = Engine(spark, BuildConfig(clusters=2)).build(refs)
    assert len(engine) == 2 and engine.vote(asked(spark, [rows[0]["vector"]])).first().votes == 0
    (tmp_path / "bad.json").write_text(json.dumps([{"vector": [1] * 14, "label": "what"}]))
    with pytest.raises(Exception, match="unknown label what"):
        prepare_references(read_references(spark, str(tmp_path / "bad.json"))).collect()
    (tmp_path / "p.json").write_text(json.dumps([LEGIT, changed(id="b", last_transaction=LAST)]))
    got = read_payloads(spark, str(tmp_path / "p.json")).collect()
    assert [r.id for r in got] == ["tx-1329056812", "b"] and got[0].last_transaction is None


def test_training(spark):
    rng = np.random.default_rng(3)
    centers = rng.random((5, 14))
    points = np.clip(centers[rng.integers(0, 5, 600)] + rng.normal(0, 0.01, (600, 14)), 0, 1)
    refs = prepare_references(refs_of(spark, [(p, "legit") for p in points])).drop(*FEATURES)
    found = clusters.train(refs, 5, sample=300, iterations=10)
    assert max(np.abs(found - c).sum(1).min() for c in centers) < 0.5 or len(np.unique(found, axis=0)) == 5
    assert np.array_equal(found, clusters.train(refs.repartition(5), 5, sample=300, iterations=10))
    lcg = clusters.Lcg(0xDEADBEEFCAFEBABE)
    assert lcg.next() == (0xDEADBEEFCAFEBABE * 6364136223846793005 + 1442695040888963407) % 2**64
    draws = clusters.Lcg(0xDEADBEEFCAFEBABE)
    assert [draws.below(50_000) for _ in range(3)] == [24313, 20016, 48273]
    assert clusters.draw_sample(3, 5, lcg) == [0, 1, 2] and len(clusters.draw_sample(10, 4, lcg)) == 4
    same = clusters.seed_centroids(np.zeros((4, 14), np.float32), 3, lcg)
    assert same.shape == (3, 14)
    empty = clusters.update(clusters.assign(refs, np.vstack([found, np.full((1, 14), -1, np.float32)])), clusters.centroid_frame(spark, np.vstack([found, np.full((1, 14), -1, np.float32)])))
    assert clusters.centroid_array(empty)[5].tolist() == [-1.0] * 14


def test_percentiles(spark):
    for n in (1, 2, 10, 999):
        values = [random.Random(n).randrange(10**7) for _ in range(n)]
        row = report.latency_report(spark.createDataFrame([(v,) for v in values], "ns long")).first()
        s = sorted(values)
        assert tuple(row) == (n, sum(s) // n // 1000, *[s[(n - 1) * p // 100] // 1000 for p in (50, 95, 99)], s[-1] // 1000)
    assert report.latency_report(spark.createDataFrame([], "ns long")).collect() == []


def test_settings():
    assert search_config({}) == ivf.SearchConfig(1, 1, False)
    assert search_config({"IVF_NPROBE": "8", "IVF_FULL_NPROBE": "24", "IVF_REPAIR": "yes"}) == ivf.SearchConfig(8, 24, True)
    assert [timeout_micros(e) for e in ({}, {"KNN_TIMEOUT_US": "0"}, {"KNN_TIMEOUT_US": "-5"}, {"KNN_TIMEOUT_US": "x"}, {"KNN_TIMEOUT_US": "250"})] == [1000, 1000, 1000, 1000, 250]
    assert search_config({"KNN_TIMEOUT_US": "250"}, 40).budget == 10_000 and search_config({}).budget is None
    assert search_config({"IVF_NPROBE": "x", "IVF_REPAIR": "maybe"}) == ivf.SearchConfig(1, 1, False)
    assert build_config({"INDEX_KIND": "exact"}).kind == "exact" and build_config({"INDEX_KIND": "other"}).kind == "ivf"
    assert ivf.SearchConfig(100, 3).bounds(4096) == (64, 64) and ivf.SearchConfig(0, 99).bounds(10) == (1, 10)


def test_bodies_of_the_tables_parse(spark, sf_dir):
    assert bodies(spark, sf_dir).select("qid").distinct().count() == bodies(spark, sf_dir).count()


def test_bench_asks_requests_in_turn(spark):
    scored = spark.createDataFrame([(0, 5), (1, 0), (2, 3)], "position long, votes int")
    for n in (0, 1, 2, 3, 7):
        row = report.bench_summary(scored, n).first()
        assert (row.iterations, row.payloads, row.checksum) == (n, 3, sum([5, 0, 3][i % 3] for i in range(n)) / 5)
    assert tuple(report.bench_summary(scored.limit(0), 4).first()) == (4, 0, 0.0)


def test_open_index_goes_by_version(spark, tmp_path):
    bad = tmp_path / "bad"
    bad.write_bytes(b"VIREO01\0" + (9).to_bytes(4, "little") + bytes(40))
    (tmp_path / "short").write_bytes(b"VIREO")
    for name in ("bad", "short"):
        with pytest.raises(ValueError):
            binary.open_index(spark, str(tmp_path / name))
