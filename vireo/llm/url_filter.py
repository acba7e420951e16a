"""URL filter: rules by host and path, and boosted trees on lexical features."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vireo.llm import gbt
from vireo.llm.common import once, spare
from vireo.llm.spans import let

FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_share", "entropy", "parameters", "hyphens", "top_rate", "site_rate")


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; and from there
    up to ? # or the end. Null and urls without :// have an empty host and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return _lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null. A rule host/path fits the host and its subdomains
    where the path starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features that need no statistics. Entropy is of the url's characters, in bits."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    letters = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    return {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "host_labels": F.size(F.split(host, r"\.")).cast("double"),
        "digit_share": F.regexp_count(url, F.lit("[0-9]")) / n,
        "entropy": F.round(F.aggregate(letters, F.lit(0.0), lambda a, c: a + let(share(c), lambda p: -p * F.log2(p))), 6),
        "parameters": F.regexp_count(url, F.lit("[?&][^&#=]+=")).cast("double"),
        "hyphens": F.regexp_count(url, F.lit("[-_%~]")).cast("double"),
    }


def _suffixes(host: Column) -> dict[str, Column]:
    return {"top": F.substring_index(host, ".", -1), "site": F.substring_index(host, ".", -2)}


class UrlModel:
    """Fitted trees and the block rates of host suffixes, smoothed towards the overall rate."""

    def __init__(self, model: gbt.Boosted, rates: dict[str, dict[str, float]], prior: float):
        self.model, self.rates, self.prior = model, rates, prior

    def with_rates(self, rows: DataFrame, name: str) -> DataFrame:
        """rows with the rates of the suffixes in the struct column `name`, as a struct `name`_rates.
        The tables that are broadcast have a row a suffix of the fitted sample, no more."""
        known = {}
        for kind, of in self.rates.items():
            key, rate = f"{name}_{kind}", f"{name}_{kind}_rate"
            table = rows.sparkSession.createDataFrame(sorted(of.items()), f"`{key}` string, `{rate}` double")
            rows = rows.join(F.broadcast(table), F.col(f"{name}.{kind}") == F.col(key), "left").drop(key)
            known[f"{kind}_rate"] = rate
        out = rows.withColumn(f"{name}_rates", F.struct(*[F.coalesce(F.col(c), F.lit(self.prior)).alias(k) for k, c in known.items()]))
        return out.drop(*known.values())

    def margin(self, row: Column, rates: Column) -> Column:
        """row: a struct with the lexical features; rates: one with those of the suffixes."""
        return self.model.margin(lambda f: rates[f] if f.endswith("_rate") else row[f])


def _rates(suffixes: list[str], y: np.ndarray, prior: float, smoothing: float) -> dict[str, float]:
    total: dict[str, list[float]] = {}
    for suffix, label in zip(suffixes, y.tolist()):
        t = total.setdefault(suffix, [0.0, 0.0])
        t[0] += label
        t[1] += 1
    return {k: round((a + smoothing * prior) / (n + smoothing), 6) for k, (a, n) in total.items()}


def fit_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "label", sample: int = 20_000, smoothing: float = 20.0, folds: int = 5) -> UrlModel:
    """Trees for labelled urls (label 1: block), from `sample` distinct ones at most: those of
    the least hash, so that the choice depends neither on the order of rows nor on how often a
    url comes. The trees see each url with the suffix rates of the other folds, so that a
    suffix does not carry its own label; the model keeps the rates of all. Null labels are
    left out; null urls count as empty."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(url_col).alias("url_"), F.col(label_col).cast("int").alias("label_"))
    rows = rows.withColumn("place_", (F.xxhash64(F.coalesce("url_", F.lit("")), "label_") / F.lit(float(2**64))) + 0.5)
    n = rows.agg(F.approx_count_distinct("place_")).first()[0]
    # of n even places, about twice the sample lies below this: tasks need not send more
    rows = rows.where(F.col("place_") <= F.lit(2.0 * sample / max(n, 1))).distinct().orderBy("place_", "url_", "label_").limit(sample)
    host, path = host_and_path(F.col("url_"))
    feats = {**lexical(F.col("url_"), host, path), **_suffixes(host)}
    got = rows.select(*[c.alias(k) for k, c in feats.items()], "label_").collect()  # sample rows at most
    y = np.array([r.label_ for r in got], dtype=float)
    prior = float(y.mean()) if len(y) else 0.0
    fold = np.arange(len(y)) % folds  # the order is that of hashes
    rates, columns = {}, {}
    for kind in ("top", "site"):
        own = [r[kind] for r in got]
        rates[kind] = _rates(own, y, prior, smoothing)
        apart = [_rates([x for x, f in zip(own, fold) if f != k], y[fold != k], prior, smoothing) for k in range(folds)]
        columns[f"{kind}_rate"] = [apart[f].get(x, prior) for x, f in zip(own, fold)]
    x = np.array([[r[f] if f in feats else columns[f][i] for f in FEATURES] for i, r in enumerate(got)], dtype=float).reshape(len(got), len(FEATURES))
    return UrlModel(gbt.fit(list(FEATURES), x, y), rates, prior)


def judge_urls(pages: DataFrame, rules: dict[str, str], model: UrlModel | None = None, url_col: str = "url", limit: float = 0.0, **fitting) -> DataFrame:
    """pages with host, path, rule, block_margin and verdict (allow or block): the verdict of the
    longest fitting rule, else block where the model's log odds reach `limit`.

    Without a model one is fitted here on the urls that a rule blocks or allows; those without
    a rule are judged only. Each url is judged in its own row, so ties, repeated rows and hot hosts do not
    matter. A null url, or one without ://, has empty host and path, no rule, and the
    model's verdict. An empty table stays empty. Other columns are returned; one that is
    named like a result is replaced.
    """
    url, row = spare(pages, "u_url_"), spare(pages, "u_row_")
    pages = pages.withColumn(url, F.col(url_col))
    host, path = host_and_path(F.col(url))
    out = pages.withColumn("host", once(host)).withColumn("path", once(path))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", rule)
    of_rule = F.lit(None).cast("string")
    for r, verdict in rules.items():
        of_rule = F.when(F.col("rule") == r, F.lit(verdict)).otherwise(of_rule)
    if model is None:
        model = fit_urls(out.select(F.col(url).alias("url"), F.when(of_rule == "block", 1).when(of_rule == "allow", 0).alias("label")), **fitting)
    feats = {**lexical(F.col(url), F.col("host"), F.col("path")), **_suffixes(F.col("host"))}
    out = model.with_rates(out.withColumn(row, once(F.struct(*[c.alias(k) for k, c in feats.items()]))), row)
    out = out.withColumn("block_margin", once(F.round(model.margin(F.col(row), F.col(f"{row}_rates")), 6)))
    out = out.withColumn("verdict", F.coalesce(of_rule, F.when(F.col("block_margin") >= limit, "block").otherwise("allow")))
    return out.drop(url, row, f"{row}_rates")
