"""URL filters: rules first, then the empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host. The share of bad pages of a host is shrunk towards that of
its registered domain, the domain's towards its suffix, the suffix's towards all: each level is a beta
prior with the mean of the level above and a strength estimated from the spread between its members.
A host is blocked when its bad share is above ``limit`` with the given certainty (normal bound of the
beta posterior). Built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscore.session import cut_lineage

#: (verdict, host, path)
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels; hosts below others have a suffix of one.
TWO_LABELS = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
              "com.mx", "com.tr", "com.tw", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: A level's prior weighs as much as this many pages at least and at most.
WEAKEST, STRONGEST = 1.0, 1000.0
LIMIT, Z = 0.5, 1.645


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, two_labels: Sequence[str] = TWO_LABELS) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*two_labels), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and the label before it; the host itself if there is none."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    parts = F.split(host, r"\.")
    return F.when(F.size(parts) <= labels, host).otherwise(
        F.array_join(F.slice(parts, F.size(parts) - labels + 1, labels), ".")
    )


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in reversed(ordered):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame) -> float:
    """How many pages a level's prior is worth, from the spread of its members around their prior means."""
    n, bad, mean = F.col("n"), F.col("bad"), F.col("prior")
    each = mean * (1 - mean)
    spread, base = level.agg(
        F.sum((bad - n * mean) ** 2 - n * each), F.sum(n * (n - 1) * each)
    ).first()
    share = spread / base if base else 0.0
    return 1 / min(max(share, 1 / (1 + STRONGEST)), 1 / (1 + WEAKEST)) - 1


def _mean(level: DataFrame, strength: float) -> DataFrame:
    return level.withColumn("mean", (strength * F.col("prior") + F.col("bad")) / (strength + F.col("n")))


def reputations(outcomes: DataFrame, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """host, n, bad, mean, bound, verdict for each host of ``outcomes`` (host, bad: 0, 1 or null).

    ``n`` counts the outcomes that are known. A host with none has its domain's mean. ``bound`` is the
    lower end of its bad share; the verdict is block where that is above ``limit``.
    """
    hosts = outcomes.groupBy("host").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad")
    )
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host")))
    hosts = cut_lineage(hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    suffixes = suffixes.withColumn("prior", F.lit((bad + 0.5) / (n + 1)))
    suffixes = _mean(suffixes, _strength(suffixes)).select("suffix", F.col("mean").alias("prior"))
    domains = domains.join(suffixes, "suffix")
    domains = _mean(domains, _strength(domains)).select("domain", "suffix", F.col("mean").alias("prior"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    strength = _strength(hosts)
    mean, weight = F.col("mean"), F.col("n") + strength
    bound = mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))
    judged = _mean(hosts, strength).withColumn("bound", bound)
    verdict = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return judged.select("host", "n", "bad", "mean", "bound", verdict.alias("verdict"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], limit: float = LIMIT, z: float = Z
) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url).

    ``outcomes`` (page_id, bad) holds labelled pages, 1 for bad; a page may have several or none, and null
    page_ids or outcomes count for nothing. A rule's verdict comes first, then the host's reputation.
    A null url, or one without ``://``, has an empty host and path, judged like any other host. Repeated
    rows give repeated rows. Other columns are left out. An empty table gives an empty one.
    """
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    labels = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = parts.select("page_id", "host").join(labels, "page_id", "left")
    found = reputations(known, limit, z).select("host", F.col("verdict").alias("_verdict"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.join(found, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "_verdict").alias("verdict")
    )
