from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from vireo.llm import mixing, pii, quality
from vireo.llm.tokens import default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_dedup_keeps_the_smallest_of_each_group(spark, sf_dir, docs):
    got = rows_of(corpus_pipeline.near_dedup(spark, docs, sf_dir))
    rows = rows_of(docs)
    comp = brute.near_groups({r[0]: r[1] for r in rows})
    assert got == [r for r in rows if comp[r[0]] == r[0]]


def test_dedup_of_odd_rows(spark, sf_dir):
    rows = [(1, "same text here", "en", "a", 1), (1, "same text here", "en", "a", 1), (2, "same text here", "en", "b", 1), (None, "same text here", None, None, None), (3, None, "x", "y", 0), (4, "", "x", "y", 0), (None, "another one of these", None, None, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "same text here"), ("3", None), ("None", "another one of these")]


def test_run_is_the_stages_in_turn(spark, sf_dir, docs):
    """Brute force from the filtered and redacted texts on: groups, copies and pieces."""
    judged = quality.line_first(docs).collect()
    rows = [(r.doc_id, r.q_clean_text, r.lang, r.source, len(r.q_clean_text)) for r in judged if r.q_kept]
    comp = brute.near_groups({r[0]: r[1] for r in rows})
    rows = [r for r in rows if comp[r[0]] == r[0]]
    red = {}
    for r in pii.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect():
        text, out, at = r.text, "", 0
        for s, no, e in r.p_spans:
            if s >= at:
                out += text[at:s] + f"[{pii.KINDS[no].upper()}]"
            at = max(at, e)
        red[r.doc_id] = out + text[at:]
    rows = [(r[0], red[r[0]], *r[2:]) for r in rows]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = Counter()
    for d, t, *_ in rows:
        want.update({(d, x): copies[d] for x in set(enumerate(brute.encoded(t, default_vocabulary(), 1)))})
    got, room = Counter(), Counter()
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        got.update((r.doc_id, x) for x in enumerate(ids, r.start))
        room[r.sequence_id] += r.length
    assert got == +want
    assert max(room.values()) <= 2048 and len(room) * 2048 - sum(room.values()) < 2048


def test_stage_columns(spark, sf_dir, docs):
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf_dir)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert out.collect() == []


def test_clean_documents_stay(spark, sf_dir, docs):
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir).select("doc_id", F.col("text").alias("kept"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    long = docs.where(F.size(F.split("text", r"\s+")) >= 60).join(labels, "doc_id")
    assert long.join(kept, "doc_id", "left_anti").count() <= 0.03 * long.count()
