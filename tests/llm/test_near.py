import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from tests.llm import brute
from vireo.llm.near import near_copies, unlike, wide_parities

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """Bases, copies with a few words changed at similarities around 0.8, and short or common texts."""
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts, shared = [], say(40)
    for n in (8, 30, 60, 120, 300):
        for _ in range(6):
            base = say(n) + (shared if rng.random() < 0.5 else [])
            texts.append(base)
            for _ in range(4):
                copy = list(base)
                for at in rng.sample(range(len(copy)), max(1, len(copy) * rng.randint(1, 5) // 200)):
                    copy[at] = "changed"
                texts.append(copy)
    hot = say(200)
    for _ in range(60):
        texts.append(hot[: rng.randint(150, 200)])
    texts += [[], [], ["one"], ["One"], shared, shared[:33], shared[:32]]
    return [" ".join(t) for t in texts]


def test_groups_are_those_of_exact_similarity(spark):
    texts = planted()
    comp = brute.components(list(range(len(texts))), lambda a, b: brute.jaccard(texts[a], texts[b]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == comp


def test_wide_parities_never_exceed_what_sets_do_not_share():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 512, 513, 3000, 9000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for drop, add in ((0, 0), (n // 10, n // 9), (n // 2, 0), (n, 40), (0, 2 * n)):
            b = np.union1d(a[drop:], rng.integers(0, 2**64, add, dtype=np.uint64))
            apart = len(np.setxor1d(a, b))
            assert unlike(wide_parities(a), wide_parities(b)) <= apart
            assert unlike(wide_parities(b), wide_parities(a)) % 2 == apart % 2


def test_stage_drops_near_copies_at_0_8(spark, sf_dir):
    texts = planted()
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()}
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if brute.jaccard(texts[a], texts[b]) >= 0.8]
    assert len(near) > 100 and not [p for p in near if got >= set(p)]
