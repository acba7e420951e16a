import random

from vireo.llm.quotes import ORACLE_SQL, link_quotations, parse


def test_parse_levels_and_own_text():
    own, passages = parse("Hi all,\n\nOn Monday Ann wrote:\n> first line\n>  second\n>\n> > deeper\n>> Deeper  two\nMy answer\n\n")
    assert own == "Hi all,\n\nMy answer"
    blocks = [(p[0], p[1]) for p in passages if p[1] == 0]
    assert blocks == [(0, 0), (1, 0), (2, 0), (0, 0)]
    assert [p[3] for p in passages if p[:2] == (1, 0)] == [p[3] for p in parse("FIRST line\nsecond")[1] if p[:2] == (0, 0)]
    assert parse(None) == ("", []) and parse("") == ("", []) and parse(">\n> \n")[1] == []


def brute(rows):
    """rows: (conv, turn, role, text)."""
    parsed = [(c, t, r, *parse(x)) for c, t, r, x in rows]
    own = {}
    for c, t, _, _, ps in parsed:
        if c is not None and t is not None:
            for level, _, _, h in ps:
                if level == 0:
                    own.setdefault(h, set()).add((c, t))
    parent, linked = {}, {}
    for c, t, _, _, ps in parsed:
        if c is None or t is None:
            continue
        for level, grain, place, h in ps:
            if level and h in own:
                before = [x for x in own[h] if x[0] == c and x[1] < t] and [min(x for x in own[h] if x[0] == c)] or [min(own[h])]
                if before[0] < (c, t):
                    parent[c, t] = min(parent.get((c, t), (99, 0, 0, None)), (level, grain, place, before[0]))
                    if grain == 0:
                        linked.setdefault((c, t), set()).add(place)
    out = []
    for c, t, r, text, ps in parsed:
        up = parent.get((c, t), (0, 0, 0, (None, None)))[3]
        at, depth = (c, t), 0
        while at in parent:
            at, depth = parent[at][3], depth + 1
        out.append((c, t, r, text, len([p for p in ps if p[0] and p[1] == 0]), len(linked.get((c, t), ())), *up, *at, depth))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    assert sorted(map(tuple, link_quotations(df).collect()), key=str) == brute(rows)


def made():
    rng = random.Random(7)
    say = lambda: " ".join(f"w{rng.randrange(2000)}" for _ in range(rng.randint(1, 9)))
    rows, texts = [], {}
    for c in range(40):
        for t in range(rng.randint(1, 14)):
            text = "\n".join(say() for _ in range(rng.randint(1, 3))) + ("\n\nSame closing line" if rng.random() < 0.6 else "")
            if t and rng.random() < 0.7:
                of = (c, rng.randrange(t)) if rng.random() < 0.8 else rng.choice(list(texts))
                quote = texts[of].split("\n")
                quote = quote if rng.random() < 0.6 else quote[: rng.randint(1, len(quote))]
                text = "Ann wrote:\n" * (rng.random() < 0.5) + "\n".join(rng.choice(["> ", ">", " > "]) + x.upper() for x in quote) + "\n" + text
            texts[c, t] = text
            rows.append((c, t, "user", text))
    rows += [(0, 0, "user", texts[0, 0]), (0, 0, "user", "other"), (None, 1, "user", "> Same closing line"), (3, None, None, None), (50, 0, "x", "> nobody said"), (51, 0, "y", ">" * 5000 + " deep"), (52, 0, "z", "z" * 100000)]
    rows += [(60, i, "u", f"step {i}" + (f"\n> step {i - 1}" if i else "")) for i in range(70)]
    rng.shuffle(rows)
    return rows


def test_threads(spark, sf_dir):
    check(spark, made())
    check(spark, [])
    some = spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(200)
    check(spark, [(r.conv_id, r.turn, r.role, r.text) for r in some.collect()])


def test_oracle(spark, sf_dir):
    from tests.llm.oracle import same

    same(spark, sf_dir, "op3_quotation_threads")


def test_oracle_on_quotations():
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    rows = made()
    con.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    con.execute("CREATE TABLE conversations AS SELECT CAST(CASE WHEN isnan(conv_id) THEN NULL ELSE conv_id END AS BIGINT) AS conv_id, CAST(CASE WHEN isnan(turn) THEN NULL ELSE turn END AS BIGINT) AS turn, role, text FROM given")
    got = con.execute(ORACLE_SQL).fetchall()
    assert sorted(map(tuple, got), key=str) == brute(rows)
