import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vireo.llm import orc_tokens, packing
from vireo.llm.common import scratch
from vireo.llm.tokens import Encoder, default_vocabulary

PATH = default_vocabulary()
ODD = [None, "", " ", "  ", "\n \n", "a  b", " a", "a ", "it's  'S\t x", "<|endoftext|> a <|endoftext|>", "é   ß\x1c y\x85 z", "漢字 かな", "x" * 5000, "1 22 333 " * 900, "퟿ 😀 👩‍👩‍👧"]


def test_encoder_is_the_library():
    rng = random.Random(6)
    letters = " \n\t\r\x0b\x1c\x85\xa0    ab1é'sß!.,漢<|>"
    texts = [x or "" for x in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    got = Encoder(PATH)([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [brute.encoded(t, PATH, 9)[:-1] for t in texts]
    small = Encoder(PATH, remember=40)
    assert all(small([t.encode()])[0].tolist() == brute.encoded(t, PATH, 9)[:-1] for t in texts[:300])


def test_orc_round_trip(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()] + [(5000 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, "no id"), (7, "again"), (7, "again")]
    random.Random(1).shuffle(rows)
    path = scratch(spark, "orc-test")
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, first int, tokens string")
    orc_tokens.write_token_orc(df, path, row_stride=1000)
    back = orc_tokens.read_token_orc(spark, path)
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = brute.encoded(t, PATH, 0)
        want.append((d, start, len(ids), brute.crc(ids)))
        start += len(ids)
    got = [tuple(r) for r in orc_tokens.digest(back).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(map(str, (r.tokens for r in back.where("id = 3").collect()))) == [str(brute.encoded(dict(rows)[3], PATH, 0))]
    plan = back.where("id = 3")._jdf.queryExecution().toString()
    assert "EqualTo(id,3)" in plan
    with pytest.raises(Exception):
        orc_tokens.write_token_orc(df, path)


def test_orc_empty(spark):
    path = scratch(spark, "orc-test")
    orc_tokens.write_token_orc(spark.createDataFrame([], "doc_id long, text string"), path)
    assert orc_tokens.digest(orc_tokens.read_token_orc(spark, path)).collect() == []


def verify(rows, got, capacity=2048):
    """Every id in one piece, gapless sequences, little padding."""
    docs = defaultdict(list)
    for d, t in rows:
        docs[d].append(brute.encoded(t, PATH, 1))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        by_doc[r.doc_id].append((r.start, ids, r.doc_tokens))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert sorted(map(str, by_doc)) == sorted(map(str, docs))
    for d, texts in docs.items():
        if len(texts) == 1:
            pieces = sorted(by_doc[d])
            assert [x for _, p, _ in pieces for x in p] == texts[0]
            assert all(at == sum(len(p) for _, p, _ in pieces[:i]) and n == len(texts[0]) for i, (at, _, n) in enumerate(pieces))
        else:
            assert sorted(x for _, p, _ in by_doc[d] for x in p) == sorted(x for t in texts for x in t)
    for pieces in by_seq.values():
        pieces.sort()
        assert [at for at, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= capacity
    used = sum(len(x) for t in docs.values() for x in t)
    return len(by_seq) * capacity - used


def test_pack(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(5000 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, "no id"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, ids string")
    assert verify(rows, packing.pack(df).collect()) < 2048
    assert verify(rows, packing.pack(df, group_bytes=60_000).collect()) < 2048 * 12
    assert packing.pack(df.limit(0)).collect() == []


def test_sequences_keep_their_ids_when_partitions_are_joined(spark):
    df = spark.createDataFrame([(i, f"some words {i} " * (1 + i % 60)) for i in range(900)], "doc_id long, text string")
    got = packing.pack(df, group_bytes=40_000).coalesce(1).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert len({r.sequence_id >> 32 for r in got}) > 5


def test_equal_rows_are_dealt_to_all_groups(spark):
    df = spark.range(20_000).selectExpr("cast(null as long) doc_id", "'the same words in every row' text")
    sizes = [r["sum(length)"] for r in packing.pack(df, group_bytes=50_000).groupBy((F.col("sequence_id") / 2**32).cast("int").alias("g")).sum("length").collect()]
    assert len(sizes) > 5 and max(sizes) < 2 * min(sizes)


def test_plan_balances_cost():
    rng = random.Random(2)
    sizes = [rng.choice([1, 5, 60, 300, 900, 2047, 2048, 2049, 5000]) for _ in range(3000)]
    pieces = packing.plan(sizes, 2048)
    assert sum(p[2] for p in pieces) == sum(sizes)
    load, cost = defaultdict(int), defaultdict(float)
    for _, _, n, s, at in pieces:
        assert at == load[s]
        load[s] += n
        cost[s] += packing.attention_cost(n, 1, 1 / 1024)
    assert len(load) == -(-sum(sizes) // 2048)
    mixed = [c for s, c in cost.items() if sum(p[3] == s for p in pieces[:0]) == 0 and load[s] == 2048]
    assert max(mixed) <= 2048 + 4096
    assert packing.plan([], 2048) == [] and packing.plan([0, 0], 4) == []


def test_plan_takes_the_cheapest_of_all_with_room_and_cuts_only_without():
    rng = random.Random(4)
    for _ in range(3):
        sizes = [min(2047, int(rng.lognormvariate(6, 0.8)) + 1) for _ in range(800)]
        bins = -(-sum(sizes) // 2048)
        room, cost, done = [2048] * bins, [0.0] * bins, [0] * len(sizes)
        for d, at, take, seq, off in packing.plan(sizes, 2048):
            left = sizes[d] - at
            assert at == done[d] and off == 2048 - room[seq]
            fit = [(cost[i], i) for i in range(bins) if room[i] >= left]
            assert (take, seq) == ((left, min(fit)[1]) if fit else (max(room), seq)) and room[seq] >= take
            room[seq] -= take
            cost[seq] += packing.attention_cost(take, 1.0, 1.0 / 1024)
            done[d] += take
        assert done == sizes
