"""Places of regular expressions in texts, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, join) -> Column:
    """array<long>: join of an array's first 1, 2, ... elements, for an associative join.
    Chunks are joined first, so that the work grows with the number of elements, not with
    its square."""
    none = F.array().cast("array<bigint>")
    own = lambda a: F.aggregate(a, none, lambda acc, x: F.array_append(acc, F.when(F.size(acc) > 0, join(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))), x)).otherwise(x)))

    def chunked(v):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, CHUNK))
        late = lambda runs, ends: F.flatten(F.transform(runs, lambda a, c: F.transform(a, lambda x: F.when(c > 0, join(F.get(ends, c - 1), x)).otherwise(x))))
        return let(F.transform(parts, own), lambda runs: let(own(F.transform(runs, lambda a: F.element_at(a, -1))), lambda ends: late(runs, ends)))

    return F.when(F.size(values) == 0, none).when(F.size(values) <= CHUNK, own(values)).otherwise(let(values, chunked))


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def apart(spans: Column, fixed: Column) -> Column:
    """The spans (structs with start and end) that touch none of the fixed ones. Both are
    swept once by place: what touches a span either reaches past its start from before, or
    starts before its end after it."""
    least, most = F.lit(-1).cast("bigint"), F.lit(2**62).cast("bigint")
    row = lambda i, of: lambda x, k: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(i).alias("mine"), (k if of else F.lit(-1)).alias("k"))
    both = F.sort_array(F.concat(F.transform(spans, row(1, True)), F.transform(fixed, row(0, False))))

    def sweep(rows):
        reach = running(F.transform(rows, lambda r: F.when(r["mine"] == 0, r["end"]).otherwise(least)), F.greatest)
        ahead = running(F.reverse(F.transform(rows, lambda r: F.when(r["mine"] == 0, r["start"]).otherwise(most))), F.least)
        clear = lambda reach, ahead: F.filter(rows, lambda r, i: (r["mine"] == 1) & (F.get(reach, i) <= r["start"]) & (F.get(ahead, F.size(rows) - 1 - i) >= r["end"]))
        return let(reach, lambda a: let(ahead, lambda b: F.transform(clear(a, b), lambda r: F.get(spans, r["k"]))))

    return F.when((F.size(spans) == 0) | (F.size(fixed) == 0), spans).otherwise(let(both, sweep))


def matches(text: Column, pattern: str, only_if: Column) -> Column:
    """array<struct<start, end, m>>: the leftmost non-overlapping matches of a Java pattern, in
    code points, end exclusive; no match where only_if is not true."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:bigint,end:bigint,m:string>>")

    def places(m):
        sizes = F.zip_with(F.slice(between, 1, F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("bigint"))
        return let(running_sums(sizes), lambda ends: F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("m"))))

    return F.when(only_if, let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(places(m)))).otherwise(none)
