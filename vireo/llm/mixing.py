"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vireo.llm.common import cut, rounds

#: Equal rows that one task counts out.
CHUNK = 10_000
#: Documents of a source that one task ranks one by one.
RANKED = 20_000
#: Bits of a document's place in the Pareto order, and how many are looked at in one pass.
BITS, STEP = 52, 10


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sizes(source, source_size), one row a source, with target: all words are shared by weight,
    where weights repeat `cycle` over the sources in code point order, null last; a target
    stops at `most` times its source's size, and what is over is shared again by weight until
    none is above.

    Sources are filled in the order of size over weight: those before the level at which
    the rest can share without passing their own stop are full. Two windows over one row a
    source; the documents are not touched.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle)).cast("int") + 1)
    rows = sizes.withColumn("weight", weight).withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    level = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(every).cast("double"))
    rows = rows.withColumn("before", F.coalesce(F.sum("stop").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("waiting", F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # the share of a unit of weight if exactly the sources before this one are full
    rows = rows.withColumn("share", (F.col("total") - F.col("before")) / F.col("waiting"))
    free = F.col("share") * F.col("weight") <= F.col("stop")
    rows = rows.withColumn("unit", F.min(F.when(free, F.struct(F.col("stop") / F.col("weight"), F.col("share")))).over(every)["share"])
    return rows.select("source", "source_size", "weight", F.least("stop", F.col("unit") * F.col("weight")).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key alone: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined with b, one row a source; null is a source."""
    return a.join(b.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_")), how).drop("s_")


def _chances(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with rate: a document of size s is drawn with chance rate * s, or surely if that
    is 1 or more, where the expected words are those wanted. Solved on one row for each
    source and size: the largest sizes are sure as long as the rest's chances pass 1."""
    sizes = groups.where("size > 0").groupBy("source", "size").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    sizes = _same(sizes, targets.select("source", "wanted"))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    above = F.coalesce(F.sum(F.col("size") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum(F.col("size") * F.col("size") * F.col("n")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rate = (F.col("wanted") - above.cast("double")) / squares.cast("double")
    fits = sizes.withColumn("rate", rate).where(F.col("rate") * F.col("size") <= 1)
    return _same(targets, fits.groupBy("source").agg(F.max_by("rate", "size").alias("rate")), "left")


def _blocked(order: DataFrame, state: DataFrame) -> DataFrame:
    """Where the walk down the order stops for each source of state(source, lo, gap): the first
    document after lo, no larger than the gap, that the sum of such documents up to it does not
    leave room for. (source, hi, words): it, and the words before it; hi is null if all fit.

    No source is ranked whole: sums of ranges of the order find the range in which the
    document lies, which is cut into smaller ones until it has few enough rows to rank."""
    rows = _same(order, state).where((F.col("lo").isNull() | (F.col("key") > F.col("lo"))) & (F.col("size") <= F.col("gap")))
    shift = BITS - STEP
    found = state.select("source", "gap", F.lit(0).cast("long").alias("range"), F.lit(0).cast("long").alias("before"))
    while True:
        own = _same(rows.drop("gap", "lo"), found).where(F.shiftright("place", min(shift + STEP, BITS)) == F.col("range")).drop("range")
        own = own.withColumn("range", F.shiftright("place", shift))
        sums = own.groupBy("source", "gap", "before", "range").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("range"))
        sums = sums.withColumn("upto", upto)
        first = F.min_by(F.struct("range", (F.col("upto") - F.col("words")).alias("before"), "n"), F.when(F.col("upto") > F.col("gap"), F.col("range")))
        edges = cut(sums.groupBy("source", "gap").agg(F.max("upto").alias("all"), first.alias("at")))
        most = edges.agg(F.max("at.n")).first()[0] or 0
        found = edges.where("at is not null").select("source", "gap", "at.range", "at.before")
        if most <= RANKED or shift == 2:
            break
        shift = max(shift - STEP, 2)
    own = _same(rows.drop("gap", "lo"), found).where(F.shiftright("place", shift) == F.col("range"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = own.withColumn("upto", upto).where("upto > gap").groupBy("source").agg(F.min(F.struct("key", (F.col("upto") - F.col("size")).alias("words"))).alias("hit"))
    whole = edges.where("at is null").select("source", F.lit(None).cast(order.schema["key"].dataType).alias("hi"), F.col("all").alias("words"))
    return whole.unionByName(hit.select("source", F.col("hit.key").alias("hi"), "hit.words"))


def _walk(order: DataFrame, gaps: DataFrame) -> DataFrame:
    """(source, gap, close, steps): down the order of each source every document is taken that
    still fits, until at one that does not the gap is no more than close. steps are stretches (lo, hi, gap): of the documents between, those no larger than
    the gap are taken."""
    kind = order.schema["key"].dataType
    none = F.lit(None).cast(kind)
    with rounds(order.sparkSession, "walk") as keep:
        steps = F.array().cast(f"array<struct<lo:{kind.simpleString()},hi:{kind.simpleString()},gap:bigint>>")
        state = keep(gaps.select("source", "gap", "close", none.alias("lo"), F.lit(True).alias("on"), steps.alias("steps")))
        while True:
            on = state.where("on and gap > close")
            if on.isEmpty():
                return cut(state.select("source", "gap", "close", "steps"))
            at = _blocked(order, on.select("source", "lo", "gap"))
            step = _same(state, at, "left")
            took = F.array_append("steps", F.struct("lo", "hi", "gap"))
            some = F.col("words").isNotNull()
            state = keep(step.select("source", (F.col("gap") - F.coalesce("words", F.lit(0))).alias("gap"), "close", F.col("hi").alias("lo"), (some & F.col("hi").isNotNull()).alias("on"), F.when(some, took).otherwise(F.col("steps")).alias("steps")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 11, near: float = 0.001) -> DataFrame:
    """Every row's part in the mix: (doc_id, size, source, source_size, target, copies, taken,
    text_md5).

    Sizes are words. Of a source with target t and size s every document gets floor(t / s)
    copies for certain; the words still wanted are drawn, each document once at most. The
    chance p of a document is in proportion to its size (1 for those that would pass it), such that
    the expected words are those wanted. Documents are ranked by u / (1 - u) over
    p / (1 - p), where u is uniform from id, text and copy; down this order every document is
    taken that still fits, until what is left is `near` of the target or less. Where it is more,
    it is smaller than every document not taken: those taken are walked once more for a
    second copy (if that stays within `most` copies), and at last the smallest document not
    taken is, if that comes nearer. So the drawn words are fixed, not only expected, and
    reruns agree.

    Sizes and ranks of each row are cut to the shared folder, so texts are read once. A hot
    source is not ranked whole: sums of ranges of its order find where the walk stops.

    Null text has size zero; it is taken as often as its source's whole part says, with
    no words. A null source is a source. Null and equal ids are kept. Rows with equal id, source
    and text are numbered, and each is drawn for itself. Sources without words have target
    zero. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.md5(text).alias("tie"),
    )
    groups = cut(rows.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("n")))
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources, cycle, most)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(times).cast("int"))
    targets = targets.withColumn("wanted", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    targets = cut(_chances(groups, targets))
    # equal rows are numbered; a large group is dealt to several tasks
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = groups.where(F.col("n") > CHUNK).withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(CHUNK).cast("long")))).repartition(parts, "at")
    large = large.withColumn("copy", F.explode(F.sequence("at", F.least("n", F.col("at") + (CHUNK - 1))))).drop("at")
    units = groups.where(F.col("n") <= CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).unionByName(large).drop("n")
    units = _same(units, targets)
    p = F.coalesce(F.col("rate") * F.col("size"), F.lit(0.0))
    units = units.withColumn("p", p).withColumn("sure", F.col("p") >= 1)
    u = uniform(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "tie", F.col("copy").cast("string")), seed)
    units = units.withColumn("odds", (u / (1 - u)) * F.try_divide(1 - F.col("p"), F.col("p")))
    # odds over 1 + odds lies in (0, 1) and keeps the order; its first bits are the place
    place = F.when((F.col("p") > 0) & ~F.col("sure"), F.least(F.floor(F.col("odds") / (1 + F.col("odds")) * float(2**BITS)), F.lit(2**BITS - 1)).cast("long"))
    units = cut(units.select("doc_id", "source", "size", "tie", "copy", "sure", place.alias("place")))
    gaps = _same(targets, units.where("sure").groupBy("source").agg(F.sum("size").alias("fixed")), "left")
    gaps = gaps.select("source", F.floor(F.col("target") * F.lit(near)).cast("long").alias("close"), (F.floor(F.col("wanted") + 1e-6) - F.coalesce("fixed", F.lit(0))).cast("long").alias("gap"))
    key = F.struct("place", F.col("doc_id").isNull().alias("no_id"), "doc_id", "size", "tie", "copy")
    order = units.where("place is not null").select("source", "size", "place", key.alias("key"))
    walked = _walk(order, gaps)
    twice = _same(order, targets.select("source", "whole")).where(F.col("whole") + 2 <= most).drop("whole")
    again = _walk(twice, walked.select("source", "gap", "close"))
    steps = again.select("source", "gap", "close", F.col("steps").alias("again"))
    units = _same(units.withColumn("key", key), _same(walked.drop("gap", "close"), steps), "left")
    inside = lambda s: (s["lo"].isNull() | (F.col("key") > s["lo"])) & (s["hi"].isNull() | (F.col("key") < s["hi"])) & (F.col("size") <= s["gap"])
    among = lambda name: F.col("place").isNotNull() & F.coalesce(F.exists(name, inside), F.lit(False))
    units = units.select("doc_id", "source", "size", "tie", "key", F.col("place").isNotNull().alias("drawable"), "gap", "close", (F.col("sure") | among("steps")).alias("took"), among("again").alias("again"))
    last = units.where("drawable and not took and gap > close and size - gap < gap").groupBy("source").agg(F.min(F.struct("size", "key")).alias("last"))
    units = _same(_same(units, last, "left"), targets.select("source", "source_size", "target", "whole"))
    drawn = F.col("took") | F.coalesce(F.col("key") == F.col("last.key"), F.lit(False))
    second = F.col("again") & (F.col("whole") + 2 <= most)
    out = units.withColumn("copies", F.col("whole") + F.when(drawn, 1).otherwise(0) + F.when(second, 1).otherwise(0))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.col("tie").alias("text_md5"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, with all their columns, as often as mix() takes them. Texts are moved
    once, to meet their number of copies; mix() itself moves sizes and hashes only. Of rows with
    equal id, source and text that are not all taken equally often, those with the least
    hash of all columns are taken more often."""
    at = lambda d, s, m: [d.alias("id"), s.alias("source"), m.alias("text")]
    taken = mix(docs, id_col, text_col, source_col, **options)
    taken = taken.groupBy(F.struct(*at(F.col("doc_id"), F.col("source"), F.col("text_md5"))).alias("_mix_at")).agg(F.min("copies").alias("least"), F.count("*").alias("n"), F.sum("copies").alias("all"))
    taken = cut(taken.where(F.col("all") > 0).select("_mix_at", F.struct("least", "n", "all").alias("_mix")))
    md5 = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.withColumn("_mix_at", F.struct(*at(F.col(id_col), F.col(source_col), md5))).join(taken, "_mix_at")
    again = lambda df, n: df.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*docs.columns)
    even = F.col("_mix.all") == F.col("_mix.least") * F.col("_mix.n")
    out = again(rows.where(even & (F.col("_mix.least") > 0)), F.col("_mix.least").cast("long"))
    if taken.where(~even).isEmpty():
        return out
    odd = rows.where(~even).withColumn("_mix_row", F.xxhash64(*docs.columns))
    kinds = odd.groupBy("_mix_at", "_mix", "_mix_row").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("_mix_at").orderBy("_mix_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.least("k", F.greatest(F.col("_mix.all") - F.col("_mix.least") * F.col("_mix.n") - before, F.lit(0)))
    kinds = kinds.select("_mix_at", "_mix_row", (F.col("k") * F.col("_mix.least") + more).alias("_mix_n"))
    odd = odd.dropDuplicates(["_mix_at", "_mix_row"]).join(kinds.where("_mix_n > 0"), ["_mix_at", "_mix_row"])
    return out.unionByName(again(odd, F.col("_mix_n")))


#: The same for DuckDB, with the parameters of the registered query: whole windows, no ranges.
ORACLE_SQL = r"""
WITH RECURSIVE d0 AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS tie FROM documents
),
d1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, tie) AS copy FROM d0),
d AS (
  SELECT *, (CAST(CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || tie || ':' || CAST(copy AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM d1
),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS weight
  FROM d GROUP BY source
),
l AS (
  SELECT *, 3.0::DOUBLE * source_size AS stop, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s
),
l2 AS (
  SELECT *, coalesce(sum(stop) OVER (ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS waiting FROM l
),
l3 AS (SELECT *, (total - before) / waiting AS share FROM l2),
l4 AS (SELECT *, first_value(share) OVER (ORDER BY CASE WHEN share * weight <= stop THEN 0 ELSE 1 END, stop / weight) AS unit FROM l3),
t0 AS (SELECT source, source_size, least(stop, unit * weight) AS target FROM l4),
t AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS times FROM t0),
t2 AS (SELECT *, CAST(floor(times) AS BIGINT) AS whole, greatest(target - floor(times) * source_size, 0) AS wanted FROM t),
h AS (SELECT source, size, CAST(count(*) AS HUGEINT) AS n FROM d WHERE size > 0 GROUP BY source, size),
h2 AS (
  SELECT h.source, size, (wanted - CAST(coalesce(sum(size * n) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(size * size * n) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate
  FROM h JOIN t2 ON h.source IS NOT DISTINCT FROM t2.source
),
c AS (SELECT source, max_by(rate, size) AS rate FROM h2 WHERE rate * size <= 1 GROUP BY source),
r AS (
  SELECT d.*, source_size, target, whole, wanted, coalesce(c.rate * size, 0) AS p FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
),
o AS (SELECT *, (u / (1 - u)) * ((1 - p) / p) AS odds FROM r WHERE p > 0 AND p < 1),
k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY least(CAST(floor(odds / (1 + odds) * CAST(4503599627370496 AS DOUBLE)) AS BIGINT), 4503599627370495), doc_id IS NULL, doc_id, size, tie, copy) AS i FROM o
),
g AS (SELECT source, CAST(floor(any_value(target) * CAST(0.001 AS DOUBLE)) AS BIGINT) AS close, CAST(floor(any_value(wanted) + 1e-6) - sum(CASE WHEN p >= 1 THEN size ELSE 0 END) AS BIGINT) AS gap FROM r GROUP BY source),
walk AS (
  SELECT source, CAST(0 AS BIGINT) AS i, gap, close, gap AS fits, gap > close AS live, false AS took FROM g
  UNION ALL
  SELECT walk.source, k.i, CASE WHEN live AND k.size <= gap THEN gap - k.size ELSE gap END, close, CASE WHEN k.size > gap AND k.size <= fits THEN gap ELSE fits END,
    live AND (k.size <= gap OR k.size > fits OR gap > close), live AND k.size <= gap
  FROM walk JOIN k ON k.source IS NOT DISTINCT FROM walk.source AND k.i = walk.i + 1
),
rest AS (SELECT source, arg_max(gap, i) AS gap, any_value(close) AS close FROM walk GROUP BY source),
k2 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY source ORDER BY i) AS i) FROM k WHERE whole + 2 <= 3),
walk2 AS (
  SELECT source, CAST(0 AS BIGINT) AS i, gap, close, gap AS fits, gap > close AS live, false AS took FROM rest
  UNION ALL
  SELECT walk2.source, k2.i, CASE WHEN live AND k2.size <= gap THEN gap - k2.size ELSE gap END, close, CASE WHEN k2.size > gap AND k2.size <= fits THEN gap ELSE fits END,
    live AND (k2.size <= gap OR k2.size > fits OR gap > close), live AND k2.size <= gap
  FROM walk2 JOIN k2 ON k2.source IS NOT DISTINCT FROM walk2.source AND k2.i = walk2.i + 1
),
rest2 AS (SELECT source, arg_max(gap, i) AS gap, any_value(close) AS close FROM walk2 GROUP BY source),
z AS (
  SELECT k.*, took, row_number() OVER (PARTITION BY k.source, took ORDER BY size, k.i) AS m, rest2.gap, rest2.close
  FROM k JOIN walk ON k.source IS NOT DISTINCT FROM walk.source AND k.i = walk.i JOIN rest2 ON k.source IS NOT DISTINCT FROM rest2.source
),
x0 AS (
  SELECT doc_id, size, tie, source, copy FROM z WHERE took OR (m = 1 AND gap > close AND size - gap < gap) UNION ALL SELECT doc_id, size, tie, source, copy FROM r WHERE p >= 1
  UNION ALL SELECT k2.doc_id, k2.size, k2.tie, k2.source, k2.copy FROM k2 JOIN walk2 ON k2.source IS NOT DISTINCT FROM walk2.source AND k2.i = walk2.i WHERE took
),
x AS (SELECT doc_id, size, tie, source, copy, count(*) AS n FROM x0 GROUP BY ALL)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, r.source_size, r.target, CAST((whole + coalesce(x.n, 0)) * r.size AS BIGINT) AS taken
FROM r LEFT JOIN x ON r.doc_id IS NOT DISTINCT FROM x.doc_id AND r.size = x.size AND r.tie = x.tie AND r.copy = x.copy AND r.source IS NOT DISTINCT FROM x.source
"""
