import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vireo.llm import gbt, url_filter
from vireo.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [r for r in URL_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits, key=len, default=None)


def test_rules_and_parts(spark, sf_dir):
    urls = [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net/", "http://xnet/", "http://example.net/en/1", "http://a.example.net/en", "http://EXAMPLE.com/de/?q=1", "http://a.org/fr/#x", "x://Ä.Org/fr/é?y", "http://a.net?b=/c", "http://a.net#/", "://a.net/://b", "http://u@h.net:80/p\nq", "http://a.net/" + "x" * 100_000, "http://a.net/", "http://a.net/"]
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict double")
    for r in url_filter.judge_urls(df, URL_RULES).collect():
        host, path = split(r.url)
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == URL_RULES[rule] if rule else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(df.limit(0), URL_RULES).collect() == []


def test_lexical_features(spark):
    urls = ["http://a.b.com/x/y1?p=1&q=2", "http://a.com", "https://%41-x_y.org/111//"]
    host, path = url_filter.host_and_path(F.col("url"))
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", *[c.alias(k) for k, c in url_filter.lexical(F.col("url"), host, path).items()]).collect()
    for r in got:
        n = Counter(r.url)
        assert abs(r.entropy + sum(c / len(r.url) * math.log2(c / len(r.url)) for c in n.values())) < 1e-5
        assert abs(r.digit_share - sum(c.isdigit() for c in r.url) / len(r.url)) < 1e-12 and r.url_length == len(r.url)
    assert (got[0].depth, got[0].parameters, got[0].host_labels, got[1].depth) == (2, 2, 3, 0)


def test_held_out_accuracy(spark):
    rng = random.Random(3)

    def url(bad):
        word = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
        if bad:
            return f"http://{word(4)}-{word(5)}{rng.randrange(10**6)}.{rng.choice(['top', 'xyz', 'com'])}/{'/'.join(str(rng.randrange(10**5)) for _ in range(rng.randint(1, 4)))}?{'&'.join(f'{word(2)}={rng.randrange(10**7)}' for _ in range(rng.randint(1, 5)))}"
        return f"https://www.{word(8)}.{rng.choice(['org', 'edu', 'com'])}/{'/'.join(word(6) for _ in range(rng.randint(1, 4)))}" + rng.choice(["", "?page=2", "#top"])

    rows = [(u, int(b)) for b in (True, False) for u in (url(b) for _ in range(1500))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "i int, url string, label int")
    model = url_filter.fit_urls(df.where("i < 2000"))
    got = url_filter.judge_urls(df.where("i >= 2000"), {}, model).select((F.expr("(verdict = 'block') = (label = 1)")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.97


def test_trees_as_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = gbt.fit(["a", "b", "c"], x, y, least=3)
    assert np.mean((model.margins(x) > 0) == y) > 0.97
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x[:200])], "i int, a double, b double, c double")
    got = [r.m for r in df.select("i", model.margin(F.col).alias("m")).orderBy("i").collect()]
    assert np.allclose(got, model.margins(x[:200]))
    assert gbt.fit(["a"], np.empty((0, 1)), np.empty(0)).trees == [] and gbt.fit(["a"], np.ones((5, 1)), np.ones(5)).trees == []
    assert gbt.threshold(np.array([3.0, 2, 1]), np.array([1, 1, 0]), 1.0) == 2 and gbt.threshold(np.array([1.0]), np.array([0]), 0.5) == float("inf")


def test_trees_judge_urls_without_a_rule(spark):
    """They learn from the rules only: what looks like blocked urls is blocked, without a rule too."""
    ads = lambda host, i: f"http://t{i}.{host}/ads/click-{i}/9{i}.php?id={i}&ref=x&u={i}"
    page = lambda host, i: f"http://t{i}.{host}/guide/"
    rows = [(f("ruled.com", i), None) for f in (ads, page) for i in range(300)]
    rows += [(ads("other.com", i), "block") for i in range(300)] + [(page("other.com", i), "allow") for i in range(300)]
    df = spark.createDataFrame(rows, "url string, want string")
    got = url_filter.judge_urls(df, {"ruled.com/ads/": "block", "ruled.com/guide/": "allow"}).where("rule is null").select("want", "verdict").collect()
    assert len(got) == 600 and sum(r.want == r.verdict for r in got) >= 540


def test_hot_urls_and_clashing_names(spark):
    """What the trees learn does not hang on how often one url comes; all columns come back."""
    rows = [(f"http://h{i % 40}.com/{'x' if i % 9 else 'ads/1?id=1'}/{i}", i % 9 == 0) for i in range(900)]
    hot = lambda url: spark.createDataFrame([(u, int(b), i) for i, (u, b) in enumerate(rows + [(url, True)] * 2000)], "url string, label int, u_row_ int")
    a, b = (url_filter.fit_urls(hot(u)) for u in ("http://hot.com/a", "http://hot.com/b"))
    assert abs(a.prior - 101 / 901) < 1e-9 and abs(b.prior - a.prior) < 1e-9
    got = url_filter.judge_urls(hot("http://hot.com/a").withColumnRenamed("url", "host"), {"com/x/": "allow"}, a, url_col="host")
    assert got.columns == ["host", "label", "u_row_", "path", "rule", "block_margin", "verdict"]
    assert got.where("path like '/x/%' and rule = 'com/x/'").count() == 800
