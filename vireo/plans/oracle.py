"""SQL of the registered queries for DuckDB: the same results from plain relational steps."""

from __future__ import annotations

from vireo.functions.features import DIMS, MCC_RISK
from vireo.plans.adapters import CODES

D = range(DIMS)
_BASE = f"""
ev AS (SELECT event_id AS qid, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
us AS (
  SELECT user_id, CAST(CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS FLOAT) AS avg_amount,
    list(DISTINCT k) FILTER (WHERE event_type = 'purchase') AS known
  FROM ev GROUP BY user_id
),
sh AS (SELECT k, CAST(CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS FLOAT) AS shop_avg FROM ev GROUP BY k),
la AS (
  SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, qid) AS last_at, lag(value) OVER (PARTITION BY user_id ORDER BY ts, qid) AS last_value,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS day
  FROM ev
),
tx AS (
  SELECT la.*, avg_amount, coalesce(list_contains(known, la.k), false) AS is_known, shop_avg, [{', '.join(f"'{c}'" for c in CODES)}][la.k % {len(CODES)} + 1] AS mcc,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label
  FROM la JOIN us USING (user_id) JOIN sh ON sh.k = la.k
)"""


def clamp(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN 0::FLOAT ELSE least(greatest({x}, 0::FLOAT), 1::FLOAT) END"


def div(a: str, b: str) -> str:
    return f"CAST(CAST({a} AS FLOAT) / CAST({b} AS FLOAT) AS FLOAT)"


_FLOOR = lambda x: f"CASE WHEN isnan({x}) THEN 0.01::FLOAT ELSE greatest({x}, 0.01::FLOAT) END"
_RISK = "CASE mcc " + " ".join(f"WHEN '{c}' THEN {r}::FLOAT" for c, r in MCC_RISK.items()) + " ELSE 0.5::FLOAT END"
_SECONDS = "datesub('second', last_at, ts)"
_F = [
    clamp(div("value", "10000")), clamp(div("k % 13", "12")), clamp(div(div("value", _FLOOR("avg_amount")), "10")), div("hour(ts)", "23"), div("isodow(ts) - 1", "6"),
    f"CASE WHEN last_at IS NULL THEN -1::FLOAT ELSE {clamp(div(div(f'greatest({_SECONDS}, 0)', '60'), '1440'))} END",
    f"CASE WHEN last_at IS NULL THEN -1::FLOAT ELSE {clamp(div('abs(value - last_value)', '1000'))} END",
    clamp(div("k * 10", "1000")), clamp(div("day", "20")), "CAST(event_type IN ('click', 'view') AS INT)::FLOAT", "CAST(event_type IN ('purchase', 'signup') AS INT)::FLOAT",
    "CAST(NOT is_known AS INT)::FLOAT", _RISK, clamp(div("shop_avg", "10000")),
]
_Q = {
    "i16": lambda f: f"CAST(CASE WHEN {f} < 0 THEN -10000 ELSE round({clamp(f)} * 10000::FLOAT) END AS INT)",
    "u8": lambda f: f"CAST(CASE WHEN {f} < 0 THEN 0 ELSE round(128::FLOAT + {clamp(f)} * 127::FLOAT) END AS INT)",
}


def _names(prefix: str) -> str:
    return ", ".join(f"{prefix}{i}" for i in D)


def _points(encoding: str = "i16") -> str:
    fs = ", ".join(f"{x} AS f{i}" for i, x in enumerate(_F))
    return f"WITH {_BASE},\nfe AS (SELECT qid, label, {fs} FROM tx),\npt AS (SELECT *, {', '.join(f'{_Q[encoding](f"f{i}")} AS q{i}' for i in D)} FROM fe)"


def _vector_points(encoding: str = "i16") -> str:
    fs = ", ".join(f"CAST((embedding[{i + 1}] + 1::FLOAT) / 2::FLOAT AS FLOAT) AS f{i}" for i in D)
    return f"WITH fe AS (SELECT vec_id AS qid, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label, {fs} FROM embeddings),\npt AS (SELECT *, {', '.join(f'{_Q[encoding](f"f{i}")} AS q{i}' for i in D)} FROM fe)"


def _sq(a: str, b: str) -> str:
    return " + ".join(f"(CAST({a}{i} AS BIGINT) - {b}{i}) * (CAST({a}{i} AS BIGINT) - {b}{i})" for i in D)


def _sq32(a: str, b: str) -> str:
    out = "0::FLOAT"
    for i in D:
        out = f"({out} + ({a}{i} - {b}{i}) * ({a}{i} - {b}{i}))"
    return out


_WITH = f"WITH {_BASE}\n"
CLAMP = f"""
WITH x AS (SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN -value ELSE value / 100 END AS FLOAT) AS x FROM events)
SELECT event_id, CAST({clamp("x")} AS DOUBLE) AS clamped, CAST({_FLOOR("x")} AS DOUBLE) AS floored FROM x"""
MCC = f"{_WITH}SELECT qid, mcc, CAST({_RISK} AS DOUBLE) AS risk FROM tx"
TEMPORAL = f"{_WITH}SELECT qid, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday, CAST({_SECONDS} AS BIGINT) AS seconds FROM tx"
UNKNOWN = f"{_WITH}SELECT qid, NOT is_known AS unknown FROM tx"
SENTINEL = f"{_points()}\nSELECT qid, CAST(f5 AS DOUBLE) AS f5, CAST(f6 AS DOUBLE) AS f6 FROM pt"
VECTORIZE = f"{_points()}\nSELECT qid, {', '.join(f'CAST(f{i} AS DOUBLE) AS f{i}' for i in D)} FROM pt"
DEQUANTIZE = f"{_points()}\nSELECT qid, {', '.join(f'CAST(CASE WHEN q{i} < 0 THEN -1::FLOAT ELSE {div(f"q{i}", "10000")} END AS DOUBLE) AS f{i}' for i in D)} FROM pt"
LABELS = f"{_WITH}SELECT qid, CAST(label AS INT) AS label FROM tx"


def quants(encoding: str) -> str:
    return f"{_points(encoding)}\nSELECT qid, {_names('q')} FROM pt"


def vector_quants(encoding: str) -> str:
    return f"{_vector_points(encoding)}\nSELECT qid AS ref_id, {_names('q')} FROM pt"


def distance(kind: str) -> str:
    how = f"CAST({_sq32('pt.f', 'o.f')} AS DOUBLE)" if kind == "f32" else f"CAST({_sq('pt.q', 'o.q')} AS BIGINT)"
    return f"{_vector_points('u8' if kind == 'u8' else 'i16')},\no AS (SELECT * FROM pt ORDER BY qid LIMIT 1)\nSELECT pt.qid AS ref_id, {how} AS dist FROM pt, o"


def _asked(name: str, whole: bool) -> str:
    """The stated query set, or all rows."""
    return "" if whole else f" WHERE {name}.qid % 20 = 0"


def _nearest(whole: bool = False) -> str:
    return f""",
pairs AS (SELECT a.qid, b.qid AS ref_id, b.label, CAST({_sq('a.q', 'b.q')} AS BIGINT) AS dist FROM pt a, pt b{_asked('a', whole)}),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) AS place FROM pairs) WHERE place <= 5),
vo AS (SELECT qid, CAST(sum(label) AS INT) AS votes FROM nn GROUP BY qid)"""


_KNN = "\nSELECT qid, CAST(place AS INT) AS place, ref_id, dist, CAST(label AS BIGINT) AS label FROM nn"


def knn(encoding: str) -> str:
    return _points(encoding) + _nearest() + _KNN


def knn_vectors() -> str:
    return _vector_points() + _nearest() + _KNN


_ANSWER = """votes < 3 AS approved, '{"approved":' || CASE WHEN votes < 3 THEN 'true' ELSE 'false' END || ',"fraud_score":' || ['0.0', '0.2', '0.4', '0.6', '0.8', '1.0'][votes + 1] || '}' AS response"""
SCORES = _points() + _nearest() + f"\nSELECT qid, votes, {_ANSWER} FROM vo"
BODIES = _points() + _nearest() + f"""
SELECT qid, votes, status, {_ANSWER} FROM (
  SELECT qid, CASE WHEN ok THEN votes ELSE 0 END AS votes, CASE WHEN ok THEN 'ok' ELSE 'invalid' END AS status FROM (SELECT *, qid // 20 % 10 NOT IN (1, 2, 3, 4, 5) AS ok FROM vo)
)"""
BENCH = _points() + _nearest() + """,
tu AS (SELECT votes, row_number() OVER (ORDER BY qid) - 1 AS turn, count(*) OVER () AS payloads FROM vo)
SELECT CAST(1234 AS BIGINT) AS iterations, max(payloads) AS payloads, CAST(sum(votes) AS DOUBLE) / 5 AS checksum FROM range(1234) r(i) JOIN tu ON i % payloads = turn"""
ROUNDTRIP = f"{_vector_points('u8')}\nSELECT CAST(row_number() OVER (ORDER BY qid) - 1 AS BIGINT) AS ref_id, CAST(label AS INT) AS label, {_names('q')} FROM pt"

_DQ = ", ".join(f"CASE WHEN q{i} < 0 THEN -1::FLOAT ELSE {div(f'q{i}', '10000')} END AS x{i}" for i in D)


def _assigned(name: str, centroids: str) -> str:
    return f"""
{name} AS (
  SELECT ref_id, cid, {_names('q')}, label FROM (
    SELECT r.*, c.cid, row_number() OVER (PARTITION BY ref_id ORDER BY {_sq32('r.x', 'c.c')}, c.cid) AS n FROM rf r, {centroids} c
  ) WHERE n = 1
)"""


def _updated(name: str, of: str, old: str) -> str:
    mean = ", ".join(f"coalesce(CAST(CAST(s.q{i} AS DOUBLE) / s.n / 10000 AS FLOAT), c.c{i}) AS c{i}" for i in D)
    return f"""
{name} AS (
  SELECT c.cid, {mean} FROM {old} c LEFT JOIN (SELECT cid, count(*) AS n, {', '.join(f'sum(q{i}) AS q{i}' for i in D)} FROM {of} GROUP BY cid) s ON s.cid = c.cid
)"""


_SEEDED = (
    _points()
    + f""",
rf AS (SELECT qid AS ref_id, label, {_names('q')}, {_DQ} FROM pt),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY ref_id) - 1 AS INT) AS cid, {', '.join(f'x{i} AS c{i}' for i in D)} FROM (SELECT * FROM rf ORDER BY ref_id LIMIT 32)),"""
    + _assigned("a0", "c0")
)
_TRAINED = _SEEDED + "," + _updated("c1", "a0", "c0") + "," + _assigned("a1", "c1") + f""",
la0 AS (
  SELECT c1.cid, CAST(coalesce(s.n, 0) AS BIGINT) AS n, {', '.join(f'CAST(coalesce(s.lo{i}, 0) AS INT) AS lo{i}, CAST(coalesce(s.hi{i}, 0) AS INT) AS hi{i}' for i in D)}
  FROM c1 LEFT JOIN (SELECT cid, count(*) AS n, {', '.join(f'min(q{i}) AS lo{i}, max(q{i}) AS hi{i}' for i in D)} FROM a1 GROUP BY cid) s ON s.cid = c1.cid
),
ly AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM la0)"""
ASSIGN = _SEEDED + "\nSELECT ref_id, cid FROM a0"
UPDATE = _SEEDED + "," + _updated("c1", "a0", "c0") + f"\nSELECT cid, {', '.join(f'CAST(c{i} AS DOUBLE) AS c{i}' for i in D)} FROM c1"
CHANGED = _TRAINED + "\nSELECT CAST(count(*) FILTER (WHERE a0.cid <> a1.cid) AS BIGINT) AS changed FROM a0 JOIN a1 USING (ref_id)"
COUNTS = _TRAINED + "\nSELECT cid, n FROM ly"
OFFSETS = _TRAINED + '\nSELECT cid, "offset" FROM ly'
BOXES = _TRAINED + f"\nSELECT cid, {_names('lo')}, {_names('hi')} FROM ly"
MEMBERS = _TRAINED + f"\nSELECT CAST(row_number() OVER (ORDER BY cid, ref_id) - 1 AS BIGINT) AS ref_id, cid, CAST(label AS INT) AS label, {_names('q')} FROM a1"
LAYOUT = _TRAINED + "\nSELECT ref_id, cid, CAST(row_number() OVER (PARTITION BY cid ORDER BY ref_id) - 1 AS INT) AS pos FROM a1"


def _ranked(whole: bool = False) -> str:
    return _TRAINED + f""",
pr AS (SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY {_sq32('p.f', 'c.c')}, cid) - 1 AS rank FROM pt p, c1 c{_asked('p', whole)})"""


PROBES = _ranked() + "\nSELECT qid, cid, CAST(rank AS BIGINT) AS rank FROM pr WHERE rank < 8"


def _ivf(fast: int, full: int, repair: bool = False, budget: int | None = None, whole: bool = False) -> str:
    gap = " + ".join(f"greatest(lo{i} - CAST(q{i} AS BIGINT), q{i} - CAST(hi{i} AS BIGINT), 0) * greatest(lo{i} - CAST(q{i} AS BIGINT), q{i} - CAST(hi{i} AS BIGINT), 0)" for i in D)
    fits = "" if budget is None else f" AND (SELECT sum(n) FROM pr p2 JOIN ly USING (cid) WHERE p2.qid = pr.qid AND p2.rank < {full}) <= {budget}"
    out = _ranked(whole) + f""",
cand AS (SELECT a.qid, b.ref_id, b.cid, b.label, CAST({_sq('a.q', 'b.q')} AS BIGINT) AS dist FROM pt a, a1 b{_asked('a', whole)}),
v1 AS (SELECT qid, sum(label) AS votes FROM (
  SELECT cand.qid, label, row_number() OVER (PARTITION BY cand.qid ORDER BY dist, rank, ref_id) AS place FROM cand JOIN pr ON pr.qid = cand.qid AND pr.cid = cand.cid WHERE rank < {fast}
) WHERE place <= 5 GROUP BY qid),
vis AS (SELECT pr.qid, cid, rank FROM pr LEFT JOIN v1 ON v1.qid = pr.qid WHERE rank < {fast} OR (rank < {full} AND coalesce(v1.votes, 0) IN (2, 3){fits})),
t2 AS (SELECT * FROM (
  SELECT cand.qid, ref_id, label, dist, rank, row_number() OVER (PARTITION BY cand.qid ORDER BY dist, rank, ref_id) AS place FROM cand JOIN vis ON vis.qid = cand.qid AND vis.cid = cand.cid
) WHERE place <= 5)"""
    last = "t2"
    if repair:
        out += f""",
wo AS (SELECT qid, CASE WHEN count(*) = 5 THEN max(dist) END AS worst FROM t2 GROUP BY qid),
re AS (
  SELECT pt.qid, ly.cid, {full} + 1 + ly.cid AS rank FROM pt CROSS JOIN ly LEFT JOIN wo ON wo.qid = pt.qid LEFT JOIN vis ON vis.qid = pt.qid AND vis.cid = ly.cid
  WHERE {'' if whole else 'pt.qid % 20 = 0 AND '}vis.cid IS NULL AND n > 0 AND ({gap} <= worst OR worst IS NULL)
),
t3 AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rank, ref_id) AS place FROM (
    SELECT qid, ref_id, label, dist, rank FROM t2
    UNION ALL SELECT cand.qid, ref_id, label, dist, rank FROM cand JOIN re ON re.qid = cand.qid AND re.cid = cand.cid
  )
) WHERE place <= 5)"""
        last = "t3"
    return out + f""",
vi AS (SELECT pt.qid, CAST(coalesce(sum(x.label), 0) AS INT) AS votes FROM pt LEFT JOIN {last} x ON x.qid = pt.qid{_asked('pt', whole)} GROUP BY pt.qid)"""


def ivf(fast: int, full: int, repair: bool = False, budget: int | None = None) -> str:
    out = _ivf(fast, full, repair, budget)
    if budget is None:
        return out + "\nSELECT qid, votes FROM vi"
    return out + f""",
sp AS (SELECT qid, sum(n) > {budget} AS late FROM pr JOIN ly USING (cid) WHERE rank < {fast} GROUP BY qid)
SELECT qid, CASE WHEN late THEN 0 ELSE votes END AS votes, CASE WHEN late THEN 'timed_out' ELSE 'ok' END AS status FROM vi JOIN sp USING (qid)"""


def compare(fast: int) -> str:
    """Every row is asked, not the stated query set alone."""
    return _ivf(fast, fast, whole=True) + _nearest(whole=True) + """
SELECT count(*) AS payloads, CAST(count(*) FILTER (WHERE vo.votes <> vi.votes) AS BIGINT) AS score_mismatches, CAST(count(*) FILTER (WHERE (vo.votes < 3) <> (vi.votes < 3)) AS BIGINT) AS decision_mismatches,
  CAST(max(abs(vo.votes - vi.votes)) AS INT) AS max_vote_delta, CAST(sum(vo.votes) AS BIGINT) AS votes_a, CAST(sum(vi.votes) AS BIGINT) AS votes_b
FROM vo JOIN vi USING (qid)"""


LATENCY = """
WITH l AS (SELECT CAST(floor(value * 1000000) AS BIGINT) AS ns FROM events),
s AS (SELECT list_sort(list(ns)) AS v, CAST(count(*) AS BIGINT) AS n, CAST(sum(ns) AS HUGEINT) AS total FROM l)
SELECT n, CAST(total // n // 1000 AS BIGINT) AS avg_us, v[(n - 1) * 50 // 100 + 1] // 1000 AS p50_us, v[(n - 1) * 95 // 100 + 1] // 1000 AS p95_us, v[(n - 1) * 99 // 100 + 1] // 1000 AS p99_us, v[n] // 1000 AS max_us FROM s"""
PAYLOADS = f"{_WITH}SELECT qid, qid % 10 NOT IN (1, 2, 3, 4, 5) AS valid, CASE WHEN qid % 10 NOT IN (1, 2, 3, 4, 5) THEN mcc END AS mcc FROM tx"
