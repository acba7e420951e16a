"""Quotation linking: conversations in reply order, without what their messages quote."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vireo.llm.common import LOWER, cut, rounds, small_batches

_MARKS = re.compile(r"(?:[ \t]{0,3}>)*")
_INTRODUCES = re.compile(r"(?:wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*\Z")
BLOCK, LINE = 0, 1


def _hash(text: str) -> str | None:
    """Of a passage without regard to A-Z case and white space; none if it has no words."""
    words = text.encode().translate(LOWER).split()
    return hashlib.md5(b" ".join(words)).hexdigest() if words else None


def parse(text: str | None) -> tuple[str, list[tuple[int, int, int, str]]]:
    """A message's own text, and its passages as (level, grain, place, hash).

    A line's level is the number of > marks at its start, each after three blanks at most.
    Lines of one level up to a line without words or of another level are a block; blocks
    and their lines are both passages. Own text is what has level 0, without the line
    that introduces a quotation.
    """
    lines = []
    for line in (text or "").split("\n"):
        marks = _MARKS.match(line)[0]
        lines.append((marks.count(">"), line[len(marks) :]))
    own, passages, block, level = [], [], [], 0

    def close() -> None:
        if block:
            passages.append((level, BLOCK, len(passages), _hash("\n".join(block))))
            place = len(passages)
            if len(block) > 1:
                passages.extend([(level, LINE, place + i, _hash(x)) for i, x in enumerate(block)])
            block.clear()

    for i, (of, body) in enumerate(lines):
        if of == 0 and i + 1 < len(lines) and lines[i + 1][0] and _INTRODUCES.search(body):
            close()
            continue
        if of == 0:
            own.append(body)
        if of != level or _hash(body) is None:
            close()
            level = of
        if _hash(body) is not None:
            block.append(body)
    close()
    while own and _hash(own[-1]) is None:
        own.pop()
    return "\n".join(own).lstrip("\n"), passages


def parse_messages(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) with own_text and passages."""

    def run(batches):
        for batch in batches:
            out = [parse(t) for t in batch.column(3).to_pylist()]
            kinds = pa.list_(pa.struct([("level", pa.int32()), ("grain", pa.int32()), ("place", pa.int32()), ("hash", pa.string())]))
            rows = [[dict(zip(("level", "grain", "place", "hash"), p)) for p in x] for _, x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([x for x, _ in out], pa.string()), pa.array(rows, kinds)], names=["conv_id", "turn", "role", "own_text", "passages"])

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, "conv_id long, turn long, role string, own_text string, passages array<struct<level:int,grain:int,place:int,hash:string>>"
    )


def _at(conv, turn) -> Column:
    return F.struct(F.col(conv).alias("conv"), F.col(turn).alias("turn"))


def roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root, depth) for links(node, parent) without cycles, by doubling: each round
    every node looks twice as far, so rounds are logarithmic in the longest chain."""
    with rounds(links.sparkSession, "roots") as keep:
        state = keep(links.select("node", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
        for _ in range(max_rounds):
            step = state.select(F.col("node").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
            joined = state.join(step, "root", "left")
            if joined.where("further is not null").isEmpty():
                return cut(state)
            state = keep(joined.select("node", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    raise RuntimeError("the links have a cycle")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Every message in its thread: (conv_id, turn, role, own_text, n_quotes, n_linked,
    parent_conv, parent_turn, root_conv, root_turn, depth). Threads in reply order: sort by
    root_conv, root_turn, depth, conv_id, turn; a reply always follows its parent.

    A quoted passage belongs to the first message that has it as its own, in the same
    conversation if there is one before the quoting message, else in any conversation
    before it, in the order of conv_id and turn. A message's parent is the source of its
    passage of the lowest level, whole blocks before lines, then the first. Messages that
    quote nothing known are roots of depth 0. n_quotes counts quoted blocks, n_linked those
    whose source is known.

    Originals are reduced to the first place of each hash, overall and in a conversation,
    before the join, so a line that very many messages share gives one row. Null text is
    empty; messages with a null conv_id or turn are kept as roots and are no source. Equal
    rows stay and have equal results; messages of one place that differ share the parent
    of the lowest (level, grain, place). An empty table gives no rows. Other columns are
    ignored.
    """
    small_batches(messages.sparkSession)
    parsed = cut(parse_messages(messages))
    flat = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p")).where("p.hash is not null")
    own = flat.where("p.level = 0").select("conv_id", "turn", F.col("p.hash").alias("hash"))
    first = own.groupBy("hash").agg(F.min(_at("conv_id", "turn")).alias("any"))
    here = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("own_turn"))
    quoted = flat.where("p.level > 0").select("conv_id", "turn", "p.level", "p.grain", "p.place", "p.hash")
    found = quoted.join(here, ["conv_id", "hash"], "left").join(first, "hash", "left")
    me = _at("conv_id", "turn")
    source = F.when(F.col("own_turn") < F.col("turn"), F.struct(F.col("conv_id").alias("conv"), F.col("own_turn").alias("turn"))).when(F.col("any") < me, F.col("any"))
    found = found.withColumn("source", source).where("source is not null")
    linked = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "grain", "place", "source")).alias("best"), F.countDistinct(F.when(F.col("grain") == BLOCK, F.col("place"))).alias("n_linked"))
    linked = cut(linked.select(me.alias("node"), F.col("best.source").alias("parent"), "n_linked"))
    chains = roots(linked)
    info = linked.join(chains, "node").select(F.col("node.conv").alias("c_"), F.col("node.turn").alias("t_"), "parent", "root", "depth", "n_linked")
    out = parsed.join(info, (F.col("conv_id") == F.col("c_")) & (F.col("turn") == F.col("t_")), "left")
    quotes = F.size(F.filter("passages", lambda p: (p["level"] > 0) & (p["grain"] == BLOCK) & p["hash"].isNotNull())).cast("long")
    return out.select(
        "conv_id", "turn", "role", "own_text", quotes.alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent.conv").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.coalesce("root.conv", "conv_id").alias("root_conv"), F.coalesce("root.turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


#: The same for DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l0 AS (SELECT r, i, ls[i] AS line FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM m)),
l1 AS (SELECT *, regexp_extract(line, '\A((?:[ \t]{0,3}>)*)', 1) AS marks FROM l0),
l2 AS (SELECT r, i, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, substr(line, length(marks) + 1) AS body FROM l1),
l3 AS (
  SELECT *, regexp_matches(body, '[^\x20\x09-\x0D]') AS has_words,
    level = 0 AND coalesce(lead(level) OVER (PARTITION BY r ORDER BY i), 0) > 0 AND regexp_matches(body, '(?:wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*\z') AS intro FROM l2
),
l4 AS (
  SELECT *, CASE WHEN has_words AND NOT intro AND coalesce(lag(has_words AND NOT intro) OVER w, false) AND lag(level) OVER w = level THEN 0 ELSE 1 END AS fresh
  FROM l3 WINDOW w AS (PARTITION BY r ORDER BY i)
),
l5 AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS b FROM l4 WHERE has_words AND NOT intro),
words AS (SELECT r, b, i, level, array_to_string(regexp_extract_all(body, '[^\x20\x09-\x0D]+'), ' ') AS t FROM l5),
low AS (SELECT r, b, i, level, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM words),
bl AS (SELECT r, b, any_value(level) AS level, count(*) AS n, md5(string_agg(t, ' ' ORDER BY i)) AS hash FROM low GROUP BY r, b),
b2 AS (SELECT *, coalesce(sum(CASE WHEN n > 1 THEN n + 1 ELSE 1 END) OVER (PARTITION BY r ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM bl),
ps AS (
  SELECT r, level, 0 AS grain, place, hash FROM b2
  UNION ALL SELECT low.r, low.level, 1, b2.place + row_number() OVER (PARTITION BY low.r, low.b ORDER BY low.i), md5(low.t) FROM low JOIN b2 ON b2.r = low.r AND b2.b = low.b WHERE b2.n > 1
),
p AS (SELECT ps.*, conv_id, turn FROM ps JOIN m USING (r) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
here AS (SELECT conv_id, hash, min(turn) AS own_turn FROM p WHERE level = 0 GROUP BY conv_id, hash),
anywhere AS (SELECT hash, min({'conv': conv_id, 'turn': turn}) AS src FROM p WHERE level = 0 GROUP BY hash),
found AS (
  SELECT p.conv_id, p.turn, level, grain, place,
    CASE WHEN own_turn < p.turn THEN {'conv': p.conv_id, 'turn': own_turn} WHEN src < {'conv': p.conv_id, 'turn': p.turn} THEN src END AS source
  FROM p LEFT JOIN here ON here.conv_id = p.conv_id AND here.hash = p.hash LEFT JOIN anywhere ON anywhere.hash = p.hash WHERE level > 0
),
link AS (
  SELECT conv_id, turn, min({'level': level, 'grain': grain, 'place': place, 'source': source}).source AS parent, count(DISTINCT CASE WHEN grain = 0 THEN place END) AS n_linked
  FROM found WHERE source IS NOT NULL GROUP BY conv_id, turn
),
walk AS (
  SELECT conv_id, turn, parent AS top, CAST(1 AS BIGINT) AS depth FROM link
  UNION ALL SELECT walk.conv_id, walk.turn, link.parent, depth + 1 FROM walk JOIN link ON link.conv_id = walk.top.conv AND link.turn = walk.top.turn
),
root AS (SELECT conv_id, turn, arg_max(top, depth) AS top, max(depth) AS depth FROM walk GROUP BY conv_id, turn),
own AS (SELECT r, string_agg(body, chr(10) ORDER BY i) AS t FROM l3 WHERE level = 0 AND NOT intro GROUP BY r),
q AS (SELECT r, count(*) AS n FROM bl WHERE level > 0 GROUP BY r)
SELECT m.conv_id, m.turn, m.role,
  CASE WHEN regexp_matches(coalesce(own.t, ''), '[^\x20\x09-\x0D]') THEN ltrim(regexp_replace(own.t, '(?:\n[\x20\x09-\x0D]*)?\z', ''), chr(10)) ELSE '' END AS own_text,
  CAST(coalesce(q.n, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, link.parent.conv AS parent_conv, link.parent.turn AS parent_turn,
  coalesce(root.top.conv, m.conv_id) AS root_conv, coalesce(root.top.turn, m.turn) AS root_turn, coalesce(root.depth, 0) AS depth
FROM m LEFT JOIN own USING (r) LEFT JOIN q USING (r) LEFT JOIN link ON link.conv_id = m.conv_id AND link.turn = m.turn LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn
"""
