"""Personal data: strict patterns, and generous candidates that boosted trees accept."""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm import gbt
from vireo.llm.common import once, spare
from vireo.llm.spans import apart, let, matches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"

#: The strict patterns for Java's engine. Possessive repeats and the looks behind change no
#: match: they keep long runs from being tried from each of their characters, and repeats
#: of groups from using the stack.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

_HEX = "[0-9A-Fa-f]{1,4}"

#: Candidates: what might be personal data, whatever surrounds it. Of card and phone, runs of
#: digits and separators: every part of a run with DIGITS digits is a candidate.
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\x20?(?:@|[\[(]at[\])]|\x20at\x20)\x20?[A-Za-z0-9-]{{1,63}}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:{{1,2}}){{2,7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::{_HEX}(?::{_HEX}){{0,6}})(?![0-9A-Za-z:])",
    "card": r"[0-9][\x20._/0-9-]{11,}+",
    "phone": r"\(?[0-9][().\x20/0-9-]{6,}+",
}
DIGITS = {"card": (12, 19), "phone": (7, 15)}
_CUES = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|address|addr|ping",
    "card": "card|visa|amex|credit|debit|payment|pan",
    "phone": "tel|phone|call|mobile|cell|fax|whatsapp|ring",
}
_AGAINST = "order|invoice|isbn|version|ref|page|section|serial|time|date|sku|part|mac|hash|total|since|between"
FEATURES = ("kind", "length", "digits", "separators", "groups", "dots", "luhn", "brackets", "date_like", "decimal_like", "grouped_like", "full_hex", "double_colon", "zero_first", "number_before", "number_after", "cue", "against")


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    flipped = F.split(F.reverse(digits), "")
    value = lambda x, i: let(x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    total = F.aggregate(F.transform(F.filter(flipped, lambda x: x != ""), value), F.lit(0), lambda a, x: a + x)
    return (F.length(digits) > 0) & (total % 10 == 0)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"\A{_PART}\.{_PART}\.{_PART}\.{_PART}\z")
    if kind == "card":
        return luhn_ok(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _likely(kind: str, text: Column) -> Column:
    """A cheap test that every text with a strict match passes."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": text.contains("+")}[kind]


def _likely_wide(kind: str, text: Column) -> Column:
    """A cheap test that every text with a candidate passes."""
    return {
        "email": text.contains("@") | text.contains("at)") | text.contains("at]") | text.contains(" at "),
        "ip": text.contains("::") | text.rlike("[0-9A-Fa-f]:{1,2}[0-9A-Fa-f]{1,4}:"),
        "card": text.rlike(r"[0-9](?:[\x20._/-]{0,2}[0-9]){11}"),
        "phone": text.rlike(r"[0-9](?:[().\x20/-]{0,2}[0-9]){6}"),
    }[kind]


def _concat(arrays: list[Column]) -> Column:
    return reduce(F.concat, arrays)


def _base(kind: str, text: Column) -> Column:
    no = KINDS.index(kind)
    found = matches(text, BASE[kind], _likely(kind, text))
    return F.transform(F.filter(found, lambda x: _valid(kind, x["m"])), lambda x: F.struct(x["start"], F.lit(no).alias("no"), x["end"]))


def _features(kind: str, text: Column, x: Column) -> Column:
    m, no = x["m"], KINDS.index(kind)
    from_ = F.greatest(x["start"] - 24, F.lit(0))
    context = F.lower(F.substr(text, (from_ + 1).cast("int"), (x["start"] - from_).cast("int")))
    follows = F.substr(text, (x["end"] + 1).cast("int"), F.lit(3))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    word = lambda words: context.rlike(rf"(?:\A|[^a-z])(?:e-?)?(?:{words})")
    values = {
        "kind": F.lit(float(no)),
        "length": F.length(m).cast("double"),
        "digits": F.length(_digits(m)).cast("double"),
        "separators": F.regexp_count(m, F.lit("[^0-9A-Za-z]")).cast("double"),
        "groups": F.regexp_count(m, F.lit("[0-9A-Fa-f]+")).cast("double"),
        "dots": F.regexp_count(m, F.lit(r"\.")).cast("double"),
        "luhn": flag(luhn_ok(_digits(m))),
        "brackets": flag(m.rlike(r"[(\[]")),
        "date_like": flag(m.rlike(r"(?:19|20)[0-9]{2}[./\x20-][01]?[0-9][./\x20-][0-3]?[0-9](?:[^0-9]|\z)|(?:\A|[^0-9])[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}")),
        "decimal_like": flag(m.rlike(r"\A[0-9]{1,3}(?:[.\x20][0-9]{3})+\z|\A[0-9]+\.[0-9]+\z")),
        "grouped_like": flag(m.rlike(r"\A\(?[0-9]{3}\)?[.\x20/-]{0,2}[0-9]{3}[.\x20-][0-9]{4}\z|\A[0-9]{4}([\x20._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\z")),
        "full_hex": flag(m.rlike(r"\A(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\z|\A[0-9A-Fa-f]{3,4}:.*::")),
        "double_colon": flag(m.contains("::")),
        "zero_first": flag(m.rlike(r"\A\(?0")),
        "number_before": flag(context.rlike(r"[0-9][().\x20_/-]{0,2}\z")),
        "number_after": flag(follows.rlike(r"\A[().\x20_/-]{0,2}[0-9]")),
        "cue": flag(word(_CUES[kind])),
        "against": flag(word(_AGAINST)),
    }
    return F.struct(x["start"], F.lit(no).alias("no"), x["end"], F.struct(*[values[f].alias(f) for f in FEATURES]).alias("f"))


def _describe(kind: str, text: Column):
    return lambda x: _features(kind, text, x)


def _parts(kind: str, text: Column, runs: Column) -> Column:
    """Of runs of digits and separators every part that starts and ends with whole groups of
    digits, has an admissible number of them and no more than two separators in turn."""
    least, most = DIGITS[kind]

    def of_run(r):
        m, phone = r["m"], kind == "phone"
        beside = lambda at, what: F.substr(text, at.cast("int"), F.lit(1)).rlike(what)
        tied = (r["start"] > 0) & beside(r["start"], "[0-9A-Za-z+]") if phone else F.lit(False)
        goes_on = beside(r["end"] + 1, "[0-9A-Za-z]") if phone else F.lit(False)

        def part(g, e):
            opened = F.when((g["start"] > 0) & (F.substr(m, g["start"].cast("int"), F.lit(1)) == "("), 1).otherwise(0) if phone else F.lit(0)
            return let(g["start"] - opened, lambda s: F.struct(s.alias("s"), e["end"].alias("e"), F.substr(m, (s + 1).cast("int"), (e["end"] - s).cast("int")).alias("m")))

        def fits(x, tied, goes_on):
            n = F.length(_digits(x["m"]))
            enough = (n >= least) & (n <= (F.when(x["m"].startswith("00"), most + 2).otherwise(most) if phone else most))
            return enough & ~x["m"].rlike("[^0-9]{3}") & ~(tied & (x["s"] == 0)) & ~(goes_on & (x["e"] == F.length(m)))

        pairs = lambda groups: F.flatten(F.transform(groups, lambda g, i: F.transform(F.slice(groups, i + 1, most + 2), lambda e: part(g, e))))
        every = let(matches(m, "[0-9]++", F.lit(True)), pairs)
        chosen = let(F.struct(tied.alias("t"), goes_on.alias("g")), lambda o: F.filter(every, lambda x: fits(x, o["t"], o["g"])))
        return F.transform(chosen, lambda x: F.struct((r["start"] + x["s"]).alias("start"), (r["start"] + x["e"]).alias("end"), x["m"].alias("m")))

    return F.flatten(F.transform(runs, of_run))


def candidates(text: Column, base: Column) -> Column:
    """Wide spans of every kind that touch no strict span, with their features; they overlap."""
    out = []
    for kind in KINDS:
        found = matches(text, WIDE[kind], _likely_wide(kind, text))
        if kind in DIGITS:
            found = _parts(kind, text, found)
        found = let(found, lambda wide: apart(wide, base))
        out.append(F.transform(found, _describe(kind, text)))
    return _concat(out)


def examples(n: int = 3000, seed: int = 5) -> list[tuple[str, int, int, int, int]]:
    """Made sentences (text, kind, label, start, end), with the place of personal data in
    unusual form, or of what only looks like it; other numbers may follow."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 8)))

    def luhn(k: int, good: bool) -> str:
        d = [rng.randrange(10) for _ in range(k - 1)]
        s = sum(x if i % 2 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d)))
        return "".join(map(str, d)) + str((10 - s % 10 + (0 if good else rng.randint(1, 9))) % 10)

    def spaced(d: str, seps: str) -> str:
        s = rng.choice(seps)
        return s.join(d[i : i + 4] for i in range(0, len(d), 4))

    cue = {k: v.split("|") for k, v in _CUES.items()}
    against = _AGAINST.split("|")
    out = []
    for i in range(n):
        kind = KINDS[i % 4]
        label = rng.random() < 0.5
        if kind == "phone":
            area = rng.choice("23456789") + num(2)
            body = rng.choice([f"({area}) {num(3)}-{num(4)}", f"{area}-{num(3)}-{num(4)}", f"{area}.{num(3)}.{num(4)}", f"0{num(3)} {num(6)}", f"0{num(2)}/{num(7)}", f"00{num(2)} {num(3)} {num(6)}"]) if label else rng.choice(
                [f"{rng.randint(1900, 2029)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1950, 2029)}", f"{rng.randint(1, 999)}.{num(3)}.{num(3)}", f"{num(4)} {num(4)}", num(rng.randint(7, 12)), f"{num(1)} {num(2)} {num(3)} {num(2)}", f"{rng.randint(1900, 2000)} - {rng.randint(1900, 2000)}"])
        elif kind == "card":
            body = spaced(luhn(16, True), "._/") if label else rng.choice([spaced(luhn(16, False), "._/"), f"{num(4)}.{num(4)}.{num(4)}", num(rng.randint(13, 19)), f"{rng.randint(1900, 2029)}/{num(2)}/{num(2)} {num(2)}.{num(2)}.{num(2)}", f"97{num(1)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}"])
        elif kind == "ip":
            h = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
            body = rng.choice([":".join(h(4) for _ in range(8)), f"2001:{h(3)}::{h(4)}", f"fe80::{h(4)}:{h(4)}:{h(4)}:{h(4)}", f"fe80::{h(rng.randint(1, 4))}", f"::{h(1)}", f"2001:{h(3)}:{h(4)}::{h(1)}"]) if label else rng.choice([f"{num(2)}:{num(2)}:{num(2)}", ":".join(h(2) for _ in range(6)), f"{num(1)}:{num(2)}:{num(3)}", f"{h(1)}::{h(2)}"])
        else:
            at, dot = rng.choice([("(at)", "."), ("[at]", "."), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]")])
            body = f"{word()}{rng.choice(['.', '', '_'])}{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}" if label else f"{word()}{rng.choice(['@', ' @ ', ' at '])}{word()}{rng.choice(['.', '. '])}{num(1)}"
        before = rng.choice(cue[kind]) if rng.random() < (0.55 if label else 0.12) else rng.choice(against) if rng.random() < (0.04 if label else 0.5) else word()
        start = f"{word()} {word()} {before}{rng.choice([' ', ': ', ' is '])}"
        tail = rng.choice([f" {rng.randint(1, 12):02}/{num(2)}", f" {rng.randint(1990, 2039)}", f" {rng.randint(1990, 2039)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"]) if kind in DIGITS and rng.random() < 0.35 else ""
        out.append((f"{start}{body}{tail} {word()} {word()}.", KINDS.index(kind), int(label), len(start), len(start) + len(body)))
    return out


def train(spark: SparkSession, n: int = 3000, precision: float = 0.98) -> tuple[gbt.Boosted, list[float], list[float]]:
    """Trees for candidates, the margin for each kind at which held-out examples reach the
    precision, and the recall there. Fitted on the n made examples, half of them held out."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(examples(n))], "i int, text string, no int, label int, from int, to int")
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint>>")
    found = rows.select("i", "no", "label", "from", "to", F.explode(candidates(F.col("text"), none)).alias("c")).where("c.no = no")
    got = found.select("i", "no", F.when((F.col("c.start") == F.col("from")) & (F.col("c.end") == F.col("to")), F.col("label")).otherwise(0).alias("label"), *[F.col(f"c.f.{f}").alias(f) for f in FEATURES]).orderBy("i", "c.start", "c.end").collect()
    x = np.array([[r[f] for f in FEATURES] for r in got], dtype=float)
    y, no, half = (np.array([f(r) for r in got]) for f in (lambda r: r.label, lambda r: r.no, lambda r: r.i // 4 % 2))
    model = gbt.fit(list(FEATURES), x[half == 0], y[half == 0])
    margin = np.round(model.margins(x), 6)
    limits, recall = [], []
    for k in range(len(KINDS)):
        own = (half == 1) & (no == k)
        limits.append(gbt.threshold(margin[own], y[own], precision))
        recall.append(float(np.mean(margin[own & (y == 1)] >= limits[-1])) if (own & (y == 1)).any() else 0.0)
    return model, limits, recall


def find_personal_data(docs: DataFrame, text_col: str = "text", trained=None) -> DataFrame:
    """docs with p_base and p_spans: sorted arrays of struct<start, no, end> in code points, end
    exclusive, no the kind's place in KINDS. p_base are the matches of the strict patterns
    that pass their checks; p_spans also holds the candidates that touch no strict span and
    whose margin reaches the limit of their kind; of such that overlap, the one of greatest
    margin stays. Strict spans of different kinds may overlap.

    Null text counts as empty and has no spans. Each text is judged whole in its row: no row
    meets another, so ties, repeated rows and hot groups do not matter; the work grows in
    proportion to a text's length. An empty table stays empty. All columns are returned;
    one that is named like a result is replaced.
    """
    model, limits, _ = trained or train(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    wide, more = spare(docs, "p_wide_"), spare(docs, "p_more_")
    out = docs.withColumn("p_base", once(_concat([_base(k, text) for k in KINDS])))
    out = out.withColumn(wide, once(candidates(text, F.col("p_base"))))
    limit = F.array(*[F.lit(x if x != float("inf") else 1e9) for x in limits])
    scored = F.transform(F.col(wide), lambda c: F.struct(c["start"], c["no"], c["end"], F.round(model.margin(lambda f: c["f"][f]), 6).alias("margin")))
    accepted = F.filter(scored, lambda c: c["margin"] >= F.get(limit, c["no"]))

    best = F.sort_array(F.transform(accepted, lambda c: F.struct((-c["margin"]).alias("less"), c["no"].alias("no"), c["start"].alias("start"), (-c["end"]).alias("far"))))
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint>>")
    meets = lambda took, c: F.exists(took, lambda x: (x["start"] < -c["far"]) & (x["end"] > c["start"]))
    add = lambda took, c: F.when(meets(took, c), took).otherwise(F.array_append(took, F.struct(c["start"].alias("start"), c["no"].alias("no"), (-c["far"]).alias("end"))))
    out = out.withColumn(wide, once(best)).withColumn(more, once(F.aggregate(wide, none, add)))
    out = out.withColumn("p_spans", once(F.sort_array(F.concat("p_base", more)))).withColumn("p_base", F.sort_array("p_base"))
    return out.drop(wide, more)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the
    first names the whole."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        gap = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        parts = F.when(s["start"] >= acc["at"], F.array_append(F.array_append(acc["parts"], gap), F.get(names, s["no"]))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, (acc["at"] + 1).cast("int"))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
