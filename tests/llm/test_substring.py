import random

from tests.llm import brute
from vireo.llm.substring import _long_paths, _shared_places, dedup_passages


def check(spark, rows, window=50):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, rid string, n_words int")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_passages(df, window=window).collect()]
    assert sorted(got, key=str) == sorted(brute.passages(rows, window), key=str)


def test_planted_passages(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage = [say(n) for n in (49, 50, 51, 120, 400)]
    rows = []
    for i in range(150):
        parts = [say(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passage), say(rng.randrange(0, 60))]
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", "\t  "]).join(parts)))
    copy = say(200)
    rows += [(5, copy), (4, copy), (6, copy), (6, copy + " tail"), (6, copy), (None, copy), (None, copy)]
    rows += [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "a " * 3000), (10**7 + 3, "a " * 60), (10**7 + 4, "a b " * 40)]
    rows += [(10**7 + 5, copy.replace(" ", "  \x0b")), (10**7 + 6, "é" + copy)]
    check(spark, rows)


def test_paths_end_at_branches(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, apart = say(400).split(), say(300)

    def lengths(texts):
        base = spark.createDataFrame(list(enumerate(texts)), "did long, text string").selectExpr("did", "did as rid", "text")
        return sorted(r.length for r in _long_paths(_shared_places(base, 50, 16), 50, 16).collect())

    whole = [f"{say(90)} {' '.join(passage)} {say(90)}" for _ in range(3)]
    (one,) = lengths(whole)
    assert 400 - 2 * 34 <= one <= 400
    assert lengths([*whole, apart]) == [one]
    left, right = lengths([*whole, f"{say(70)} {' '.join(passage[:200])} {say(70)}"])
    assert left + right <= 400 and min(left, right) >= 200 - 2 * 34
    assert lengths([apart, say(200)]) == []


def test_frequent_passage_between_different_words(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    line, ends = say(47), [say(3) for _ in range(9)]
    check(spark, [(i, f"{say(20)} {rng.choice(ends)} {line} {rng.choice(ends)} {say(20)}") for i in range(300)])
    check(spark, [(rng.randrange(40), f"{say(rng.randrange(9))} {'la di ' * rng.randrange(20, 70)}{say(30)}") for _ in range(120)])


def test_empty_and_test_table(spark, sf_dir):
    check(spark, [])
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, rows)
    check(spark, rows[:80] + rows[:30], window=20)


def test_oracle(spark, sf_dir):
    from tests.llm.oracle import same

    same(spark, sf_dir, "op9_passage_dedup")
