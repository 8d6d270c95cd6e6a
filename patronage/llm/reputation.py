"""Host reputation by empirical Bayes, and URL filtering by its posterior bound.

The outcomes of labelled pages (bad or not) are summed per host. A host's rate of bad pages is shrunk towards its
registered domain's, that one's towards its public suffix's, and that one's towards the overall rate, each by a
beta-binomial prior. How strongly is measured from the data: the prior's strength at a level is the one that
explains how far the counts at that level lie from what their parents predict (method of moments). A host is
blocked if even the lower bound of its posterior rate is too high, so a few bad pages do not block one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.session import durable

ALLOW, BLOCK = "allow", "block"
BAD_RATE = 0.5  # a host is blocked if its rate is above this ...
SURENESS = 1.645  # ... by so many posterior standard deviations
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
# Suffixes of two labels under which names are registered.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "org.uk")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]], index: int) -> Column:
    """Item ``index`` of the longest fitting (verdict, rule); null if none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, rule_path = split_rule(rule[1])
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.lit(rule[index])).otherwise(found)
    return found


def _names(hosts: DataFrame) -> DataFrame:
    """Adds the public suffix and the registered domain of each host."""
    labels = F.split("host", r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    two = F.when(F.size(labels) >= 2, last(2)).otherwise(F.col("host"))
    long = two.isin(*LONG_SUFFIXES)
    suffix = F.when(long, two).otherwise(F.element_at(labels, -1))
    domain = F.when(long & (F.size(labels) >= 3), last(3)).otherwise(two)
    return hosts.withColumn("suffix", suffix).withColumn("domain", domain)


def _shrunk(level: DataFrame, known: list[str]) -> DataFrame:
    """Turns (n, bad, prior rate ``above``) into the posterior mean ``rate``; keeps the columns ``known``."""
    spread = F.col("n") * F.col("above") * (1 - F.col("above"))
    miss = F.col("bad") - F.col("n") * F.col("above")
    sums = level.agg(F.sum(miss * miss), F.sum(spread), F.sum(spread * (F.col("n") - 1))).first()
    squares, expected, growth = (float(x or 0.0) for x in sums)
    overlap = (squares - expected) / growth if growth > 0 else 0.0
    strength = 1 / overlap - 1 if overlap > 0 else MOST_STRENGTH
    strength = min(max(strength, LEAST_STRENGTH), MOST_STRENGTH)
    alpha = F.col("bad") + strength * F.col("above")
    rate = alpha / (F.col("n") + strength)
    return level.select(*known, rate.alias("rate"), (F.col("n") + strength).alias("weight"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, bound) of every host in ``outcomes`` (host, n, bad): its counts of labelled and bad
    pages, posterior mean and lower posterior bound. Hosts without labelled pages get their domain's rate."""
    hosts = durable(_names(outcomes.select("host", "n", "bad")))
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = durable(hosts.groupBy("suffix", "domain").agg(*counts))
    suffixes = durable(domains.groupBy("suffix").agg(*counts))
    total = suffixes.agg(*counts).first()
    overall = ((total[1] or 0) + 1.0) / ((total[0] or 0) + 2.0)
    suffixes = _shrunk(suffixes.withColumn("above", F.lit(overall)), ["suffix"])
    domains = durable(domains.join(suffixes.select("suffix", F.col("rate").alias("above")), "suffix"))
    domains = _shrunk(domains, ["suffix", "domain"])
    above = domains.select("suffix", "domain", F.col("rate").alias("above"))
    judged = _shrunk(durable(hosts.join(above, ["suffix", "domain"])), ["host", "n", "bad"])
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return judged.withColumn("bound", F.col("rate") - SURENESS * deviation).drop("weight")


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    bad_rate: float = BAD_RATE,
) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): allow or block, by the longest fitting rule or by reputation.

    ``outcomes`` (page_id, bad boolean) labels some pages; a page is bad if any of its rows says so, and rows
    without page_id or outcome say nothing. ``rules`` are (verdict, ``host/path``) and hold for the host, its
    subdomains and all paths that begin so. Pages with a null url or none with ``://`` share the empty host,
    which is judged like any other. Repeated pages give repeated rows; other columns are ignored; without
    outcomes nothing is blocked but by a rule.

    Columns: page_id, host, path, rule, verdict, bad_rate, bad_bound.
    """
    own = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = own.select("page_id", "host").join(labels, "page_id", "left").groupBy("host")
    counts = counted.agg(F.count("bad").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
    hosts = durable(reputation(counts).select("host", "rate", "bound"))
    verdict = F.when(F.col("bound") > bad_rate, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return own.join(hosts, "host").select(
        "page_id",
        "host",
        "path",
        rule_column(F.col("host"), F.col("path"), rules, 1).alias("rule"),
        F.coalesce(rule_column(F.col("host"), F.col("path"), rules, 0), verdict).alias("verdict"),
        F.col("rate").alias("bad_rate"),
        F.col("bound").alias("bad_bound"),
    )
