"""Quality rules, lines first: bad lines go, then documents that lose too much text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vireo.llm.common import SPACE, once, spare, words_array

#: Fixed value: phrases that mark a short line as boilerplate (lower case), in the languages of
#: the corpus: English, German, French, Spanish.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "log in", "lorem ipsum",
    "privacy policy", "share this", "sign in", "sign up", "subscribe", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "impressum", "jetzt anmelden", "nutzungsbedingungen",
    "accepter les cookies", "cliquez ici", "conditions d'utilisation", "mentions légales", "politique de confidentialité", "se connecter", "tous droits réservés",
    "aceptar cookies", "aviso legal", "haga clic aquí", "iniciar sesión", "política de privacidad", "términos de uso", "todos los derechos reservados",
)
#: They count as whole words only.
_KNOWN = r"(?:\A|[^\p{L}])(?:" + "|".join(BOILERPLATE) + r")(?:[^\p{L}]|\z)"
#: Fixed value: characters that sentences rarely hold.
SYMBOLS = "[#*$%&|<>]"
#: Fixed value: how a sentence may end, closing quotes and brackets included.
TERMINAL = "[.!?:;…。！？।؟]['\")\\]”’»]*[\\x20\\x09-\\x0D]*\\z"


def line_fails(line: Column, symbol_share: float = 0.1, boilerplate_words: int = 20) -> Column:
    """Whether a line with a word breaks a rule. Punctuation: symbols are over symbol_share of
    its characters, or it is all capitals. Navigation: two or more bars, bullets or arrows, or
    one or two words without a sentence's end. Boilerplate: a known phrase in a line of at
    most boilerplate_words words."""
    few = lambda n: ~line.rlike(rf"\A{SPACE}*+(?:[^\x20\x09-\x0D]++{SPACE}++){{{n}}}[^\x20\x09-\x0D]")  # noqa: E731  at most n words
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) > F.length(line) * F.lit(symbol_share)
    capitals = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}\p{Lu}")
    menu = line.rlike(r"[|»›•→·][^\n]*[|»›•→·]") | (few(2) & ~line.rlike(TERMINAL))
    known = F.lower(line).rlike(_KNOWN) & few(boilerplate_words)
    return symbols | capitals | menu | known


def _repeat_words(hashes: Column) -> Column:
    """Words in three-word windows found twice or more: windows are sorted by hash with their
    places; those equal to a neighbour count, and their places are merged."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    with_pairs = F.transform(
        F.array(pairs),
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda p, i: F.when(i > 0, F.get(s, i - 1)["h"] == p["h"]).otherwise(F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == p["h"], F.lit(False))),
                lambda p: p["i"],
            )
        ),
    )
    covered = F.transform(with_pairs, lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(F.get(covered, F.lit(0)))


def line_first(docs: DataFrame, text_col: str = "text", min_words: int = 50, most_repeated: float = 0.5, most_lost: float = 0.5) -> DataFrame:
    """docs with q_* columns: counts of the whole text, the text without failing lines, and the
    verdicts q_base_failed and q_kept.

    q_base_failed: fewer than min_words words, or more than most_repeated of them in three-word
    windows that the text has twice. q_kept: base did not fail, and the failing lines hold at
    most most_lost of the characters of all lines with a word. Lines without a word are
    kept and count for nothing.

    Null text counts as empty and fails. Any length of text is judged whole in its row: no
    row meets another, so ties, repeated rows and hot sources do not matter. Windows are
    compared by 64-bit hashes. An empty table stays empty. All columns of docs are returned;
    one that is named like a result is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [spare(docs, f"q_{x}_") for x in ("words", "hashes", "lines")]
    out = docs.withColumn(names[0], once(words_array(text)))
    words = F.col(names[0])
    hashes = F.when(F.size(words) >= 3, F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn(names[1], once(hashes))
    line = lambda x: F.struct(x.alias("line"), x.rlike(r"[^\x20\x09-\x0D]").alias("full"), (x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x)).alias("bad"))
    out = out.withColumn(names[2], once(F.transform(F.split(text, "\n", -1), line)))
    lines = F.col(names[2])
    full = F.transform(F.filter(lines, lambda x: x["full"]), lambda x: x["line"])
    chars = lambda keep: F.aggregate(F.filter(lines, keep), F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"]))
    out = (
        out.withColumn("q_n_words", F.size(words).cast("long"))
        .withColumn("q_word_chars", F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)))
        .withColumn("q_n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("q_n_dup_lines", (F.size(full) - F.size(F.array_distinct(full))).cast("long"))
        .withColumn("q_n_repeat_words", once(_repeat_words(F.col(names[1]))))
        .withColumn("q_line_chars", chars(lambda x: x["full"]))
        .withColumn("q_lost_chars", chars(lambda x: x["bad"]))
        .withColumn("q_clean_text", F.when(F.exists(lines, lambda x: x["bad"]), F.array_join(F.transform(F.filter(lines, lambda x: ~x["bad"]), lambda x: x["line"]), "\n")).otherwise(text))
    )
    failed = (F.col("q_n_words") < min_words) | (F.col("q_n_repeat_words") > F.lit(most_repeated) * F.col("q_n_words"))
    out = out.withColumn("q_base_failed", failed)
    out = out.withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_lost_chars") <= F.lit(most_lost) * F.col("q_line_chars")))
    return out.drop(*names)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g),
g3 AS (SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS k FROM g2 WHERE n > 1),
rep AS (SELECT r, sum(k) AS n_repeat_words FROM g3 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l2 AS (
  SELECT r, line,
    len(regexp_extract_all(line, '[#*$%&|<>]')) > length(line) * CAST(0.1 AS DOUBLE)
    OR (NOT regexp_matches(line, '\p{Ll}') AND regexp_matches(line, '\p{Lu}\p{Lu}'))
    OR regexp_matches(line, '[|»›•→·][^\n]*[|»›•→·]')
    OR (NOT regexp_matches(line, '\A[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){2}[^\x20\x09-\x0D]') AND NOT regexp_matches(line, '[.!?:;…。！？।؟][''")\]”’»]*[\x20\x09-\x0D]*\z'))
    OR (regexp_matches(lower(line), '@KNOWN@')
        AND NOT regexp_matches(line, '\A[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){20}[^\x20\x09-\x0D]')) AS bad
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
ls AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) AS line_chars, sum(CASE WHEN bad THEN length(line) ELSE 0 END) AS lost_chars FROM l2 GROUP BY r),
c AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, coalesce(lost_chars, 0) AS lost_chars
  FROM w LEFT JOIN rep USING (r) LEFT JOIN ls USING (r)
),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars <= 0.5 * line_chars AS kept FROM v
""".replace("@KNOWN@", _KNOWN.replace("'", "''"))
