"""Feature engineering: one transaction becomes 14 single-precision numbers, then integers.

All expressions are built-in columns, so they stay in generated code and plans can push
filters and prune columns through them. Arithmetic is rounded to single precision after
each step, because neighbours at equal distance and borderline votes depend on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 14
FEATURES = [f"f{i}" for i in range(DIMS)]
QUANTS = [f"q{i}" for i in range(DIMS)]
#: What a full scale is in each unit.
MAX_AMOUNT, MAX_INSTALLMENTS, MAX_RATIO, MAX_MINUTES, MAX_KM, MAX_DAILY = 10_000.0, 12.0, 10.0, 1440.0, 1000.0, 20.0
#: Risk of a merchant category; every other code has DEFAULT_RISK.
MCC_RISK = {
    "4511": 0.35, "5311": 0.25, "5411": 0.15, "5812": 0.30, "5912": 0.20,
    "5944": 0.45, "5999": 0.50, "7801": 0.80, "7802": 0.75, "7995": 0.85,
}
DEFAULT_RISK = 0.50
I16_SCALE, U8_ZERO, U8_SCALE = 10_000, 128, 127


def compiled(spark) -> None:
    """The JVM compiles no method of over 8,000 bytes, and the code of all features in one is
    longer; beyond this limit Spark makes small methods instead, which are compiled."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def f32(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def ratio(a: Column, b) -> Column:
    """a / b in single precision."""
    return (f32(a) / f32(b)).cast("float")


def clamp01(x: Column) -> Column:
    """Into [0, 1]; not-a-number gives 0. It is replaced first: Spark orders NaN above every
    number. Of equal ones greatest() keeps the first, so minus zero gives zero. x is named once,
    which keeps generated code small enough to be compiled."""
    return F.least(F.greatest(f32(0.0), F.nanvl(f32(x), f32(0.0))), f32(1.0))


def floored(x: Column, least: float = 0.01) -> Column:
    """The greater of x and least; not-a-number gives least."""
    return F.greatest(F.nanvl(f32(x), f32(least)), f32(least))


def mcc_risk(mcc: Column) -> Column:
    out = f32(DEFAULT_RISK)
    for code, risk in MCC_RISK.items():
        out = F.when(mcc == code, f32(risk)).otherwise(out)
    return out


def flag(x: Column) -> Column:
    return x.cast("int").cast("float")


def unknown_merchant(merchant: Column, known: Column) -> Column:
    """Not among the known ones; a null among them does not make it unknown or known."""
    return ~F.coalesce(F.array_contains(known, merchant), F.lit(False))


def whole_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end, truncated towards zero."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return (micros - micros % 1_000_000).cast("long") / F.lit(1_000_000)


def vector(t: str | Callable[[str], Column] = "") -> list[Column]:
    """The 14 features of a nested transaction, named f0 to f13; t prefixes its columns, or gives
    the column of each path."""
    c = t if callable(t) else lambda name: F.col(t + name)
    at, last = c("transaction.requested_at"), c("last_transaction")
    seconds = F.greatest(whole_seconds(c("last_transaction.timestamp"), at), F.lit(0.0))
    missing = f32(-1.0)
    out = [
        clamp01(ratio(c("transaction.amount"), MAX_AMOUNT)),
        clamp01(ratio(c("transaction.installments"), MAX_INSTALLMENTS)),
        clamp01(ratio(ratio(c("transaction.amount"), floored(c("customer.avg_amount"))), MAX_RATIO)),
        ratio(F.hour(at), 23.0),
        ratio(F.weekday(at), 6.0),
        F.when(last.isNull(), missing).otherwise(clamp01(ratio(ratio(seconds, 60.0), MAX_MINUTES))),
        F.when(last.isNull(), missing).otherwise(clamp01(ratio(c("last_transaction.km_from_current"), MAX_KM))),
        clamp01(ratio(c("terminal.km_from_home"), MAX_KM)),
        clamp01(ratio(c("customer.tx_count_24h"), MAX_DAILY)),
        flag(c("terminal.is_online")),
        flag(c("terminal.card_present")),
        flag(unknown_merchant(c("merchant.id"), c("customer.known_merchants"))),
        mcc_risk(c("merchant.mcc")),
        clamp01(ratio(c("merchant.avg_amount"), MAX_AMOUNT)),
    ]
    return [x.alias(f) for x, f in zip(out, FEATURES)]


def half_up(x: Column) -> Column:
    """The nearest integer of a float of 0 or more, halves up: exact, as doubles hold x + 0.5.
    round() goes through the decimal digits of each number."""
    return F.floor(x.cast("double") + 0.5).cast("int")


def quantize_i16(x: Column) -> Column:
    """Negative (missing) gives -10000, else 0 to 10000; halves round up."""
    return F.when(x < 0, F.lit(-I16_SCALE)).otherwise(half_up((clamp01(x) * f32(float(I16_SCALE))).cast("float")))


def quantize_u8(x: Column) -> Column:
    """Negative (missing) gives 0, else 128 to 255; halves round up."""
    return F.when(x < 0, F.lit(0)).otherwise(half_up((f32(float(U8_ZERO)) + clamp01(x) * f32(float(U8_SCALE))).cast("float")))


def dequantize_i16(q: Column) -> Column:
    return F.when(q < 0, f32(-1.0)).otherwise(ratio(q, float(I16_SCALE)))


def with_quants(df: DataFrame, encoding: str = "i16") -> DataFrame:
    how = {"i16": quantize_i16, "u8": quantize_u8}[encoding]
    return df.withColumns({q: how(F.col(f)) for q, f in zip(QUANTS, FEATURES)})


def packed(df: DataFrame) -> tuple[list[Column], int]:
    """q0 to q13 as few whole numbers w0, w1, ..., and the bits of each: 16 if all are short, else
    32. Rows cost by the column where they are kept or sent to Python."""
    bits = 16 if {t for c, t in df.dtypes if c in QUANTS} == {"smallint"} else 32
    per, kind = 64 // bits, "smallint" if bits == 16 else "int"
    part = lambda q, j: f"shiftleft(cast(cast({q} as {kind}) as bigint) & {(1 << bits) - 1}L, {bits * j})"
    return [F.expr(" | ".join(part(q, j) for j, q in enumerate(QUANTS[i : i + per])) + f" as w{i // per}") for i in range(0, DIMS, per)], bits


def unpacked(bits: int) -> list[Column]:
    """q0 to q13 of the numbers of packed()."""
    per, kind = 64 // bits, "smallint" if bits == 16 else "int"
    return [F.expr(f"cast(shiftright(shiftleft(w{i // per}, {64 - bits * (i % per + 1)}), {64 - bits}) as {kind}) as {q}") for i, q in enumerate(QUANTS)]


def label_code(label: Column) -> Column:
    """fraud is 1 and legit 0; anything else ends the query."""
    bad = F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(label, F.lit("null"))))
    return F.when(label == "fraud", 1).when(label == "legit", 0).otherwise(bad.cast("int"))


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    """Sum of squared differences of integers, exact: differences are widened before they are
    multiplied, as the sum passes 32 bits."""
    out = None
    for x, y in zip(a, b):
        d = x.cast("long") - y.cast("long")
        out = d * d if out is None else out + d * d
    return out


def squared_distance_f32(a: list[Column], b: list[Column]) -> Column:
    """Sum of squared differences in single precision, from the first dimension on."""
    out = f32(0.0)
    for x, y in zip(a, b):
        d = (f32(x) - f32(y)).cast("float")
        out = (out + (d * d).cast("float")).cast("float")
    return out


def box_bound(q: list[Column], low: list[Column], high: list[Column]) -> Column:
    """The least squared distance from a point to a box: 0 inside."""
    out = None
    for x, a, b in zip(q, low, high):
        gap = F.greatest(a.cast("long") - x, x - b.cast("long"), F.lit(0).cast("long"))
        out = gap * gap if out is None else out + gap * gap
    return out


#: The answer for 0 to 5 fraudulent neighbours of five.
RESPONSES = [f'{{"approved":{str(n < 3).lower()},"fraud_score":{n / 5:.1f}}}' for n in range(6)]


def response(votes: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for r in RESPONSES]), F.least(votes.cast("int"), F.lit(5)))


def score(votes: Column) -> Column:
    """Votes over five, whatever number of neighbours was found."""
    return ratio(votes, 5.0)


def approved(votes: Column) -> Column:
    return votes < 3
