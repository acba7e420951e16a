import hashlib
import random
from collections import Counter

import numpy as np

from vireo.llm import cws


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(3)
    worst = []
    for k in range(30):
        base = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(400)]
        other = [w if rng.random() > k / 30 else f"v{rng.randrange(200)}" for w in base]
        a, b = " ".join(base), " ".join(other)
        worst.append(cws.likeness(cws.signature(a.encode(), 1024), cws.signature(b.encode(), 1024)) - jaccard(a, b))
    assert max(map(abs, worst)) < 0.07 and abs(np.mean(worst)) < 0.012


def test_memory_does_not_change_samples():
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(300)}".encode() for _ in range(50)] for _ in range(100)]
    small, large = cws.Sampler(16, remember=20), cws.Sampler(16)
    assert all(np.array_equal(small(t), large(t)) for t in texts)


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(float("inf") if r[0] is None else r[0]), 0))
    out = []
    for i, (d, t) in enumerate(rows):
        t, follow = t or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t) // 3
        new = t[: len(t) - n] + follow[:n]
        sig = [cws.signature(x.encode()) for x in (t, new, follow)]
        code = ["".join(f"{v:04x}" for v in s) for s in sig]
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), *code[:2], np.mean(sig[0] == sig[1]), np.mean(sig[0] == sig[2])))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fingerprint int")
    got = cws.compare_neighbours(df).drop("edited_text").collect()
    assert sorted(map(tuple, got), key=str) == (brute(rows) if rows else [])


def test_neighbours(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, rows)
    check(spark, rows[:1])
    check(spark, [])
    odd = [(None, "no id at all"), (2**62, "é漢" * 40 + " a b c"), (-5, None), (3, ""), (8, "same"), (8, "same"), (9, "x" * 200000), (10, " \n "), (11, "ab")]
    check(spark, odd)
    same = cws.fingerprints(spark.createDataFrame([(1, "a b b"), (2, "a b b"), (3, None), (4, "")], "doc_id long, text string"))
    got = {r.doc_id: r.fingerprint for r in same.collect()}
    assert got[1] == got[2] != got[3] == got[4]


def test_edited_is_nearer_than_next(spark, sf_dir):
    got = cws.compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("n_chars > 500").selectExpr("avg(near_edited) e", "avg(near_next) n").first()
    assert got.e > got.n + 0.2
