import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vireo.llm import quality


def expected(text):
    text = text or ""
    w = brute.words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    cover = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if brute.words(x)]
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed)


def rows_of(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, q_kept string, q_words_ int")
    got = quality.line_first(df)
    assert got.columns[:2] == ["doc_id", "text"] and "q_words_" in got.columns
    return {r.doc_id: r for r in got.collect()}


def test_phrases_are_whole_words_of_four_languages(spark):
    plain = ["The catalog in print is old and long", "A design in blue, a dialog in the hall", "We design up to ten and redesign in time", "unimpressum heißt nichts weiter hier so"]
    bad = ["Please log in to read all of this", "SIGN UP now for the whole of the news", "Impressum und Kontakt finden Sie unten links", "Lisez nos mentions légales avant de continuer", "Lea el aviso legal y las condiciones antes"]
    rows = spark.createDataFrame([(x,) for x in plain + bad], "line string")
    got = rows.select("line", quality.line_fails(F.col("line")).alias("bad")).collect()
    assert {r.line for r in got if r.bad} == set(bad)


CLEAN = "".join("The " + " ".join(f"{w}{i}" for w in "quick brown fox jumps over lazy dogs while others sleep".split()) + ".\n" for i in range(8))
ODD = [None, "", " \n\t", "one", "a b c", "a b c " * 40, "x" * 100000, "w\n" * 500, "é ü\x0bß\x0c" * 60, "😀 漢字 " * 30, "a\x85b c d " * 30, "\r\n".join(["line here"] * 70), " ".join(f"w{i % 60}" for i in range(5000))]


def test_counts_against_brute_force(spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = rows_of(spark, texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.q_base_failed) == expected(t), repr(t)[:80]
        assert not (r.q_kept and r.q_base_failed)


def test_clean_stays_and_junk_goes(spark):
    words = " ".join(f"word{i}x" for i in range(120))
    texts = [
        CLEAN, words, words.replace(" ", "\n", 3), "Titel\n" + CLEAN, CLEAN.upper(), " | ".join(words.split()), "### ".join(words.split()),
        "Home | About | Contact\n" + CLEAN + "All rights reserved.\n", "漢字。" * 20 + "\n" + CLEAN, "\n\n\n".join(f"word{i}y" for i in range(80)), words.replace(" ", ", ") + "\n\n",
    ]
    got = rows_of(spark, texts)
    assert [got[i].q_kept for i in range(len(texts))] == [True, True, True, True, False, False, False, True, True, False, True]
    assert got[0].q_clean_text == CLEAN and got[7].q_clean_text == CLEAN
    assert got[3].q_clean_text == CLEAN


def test_empty(spark):
    assert rows_of(spark, []) == {}


@pytest.mark.parametrize("name", ["op8_line_first"])
def test_oracle(spark, sf_dir, name):
    pytest.importorskip("duckdb")
    from tests.llm.oracle import same

    same(spark, sf_dir, name)


def test_labelled_quality(spark, sf_dir):
    """Rejections follow the labels: nearly all clean labelled documents stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    r = quality.line_first(docs).where("not q_base_failed").selectExpr("avg(if(quality = 1, cast(q_kept as int), null)) clean", "avg(if(quality = 0, cast(q_kept as int), null)) bad").first()
    assert r.clean > 0.97 and (r.bad is None or r.bad < 0.6)
