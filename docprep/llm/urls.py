"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's
share of good pages is shrunk by a beta-binomial prior towards the level above: suffix towards all
pages, domain towards its suffix, host towards its domain. How strongly is estimated from the data
(method of moments, one number per level). A host is blocked only when even the upper bound of its
posterior is below the threshold, so hosts with little evidence follow their domain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import lower_ascii

# Suffixes of two labels under which names are registered (a short public list; a parameter).
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za", "com.tr", "com.ar")
#: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix of a host, user and port aside; an address in numbers is its own suffix."""
    bare = F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", "")
    pair = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(r"^[0-9.]+$|^\["), bare).otherwise(F.when(pair.isin(*suffixes), pair).otherwise(F.substring_index(bare, ".", -1)))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: the suffix and one label before it."""
    bare = F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", "")
    pair = F.substring_index(bare, ".", -2)
    longer = F.when(pair.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(pair)
    return F.when(bare.rlike(r"^[0-9.]+$|^\["), bare).otherwise(longer)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null when none does. Of equal ones the first given wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.find("/")
        name, start = (text, "") if at < 0 else (text[:at], text[at:])
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> float:
    """Prior strength of a level from ``good``, ``n`` and the parent's ``mean``, by the method of moments."""
    spread = F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("mean"), 2) - F.col("mean") * (1 - F.col("mean"))
    scale = F.col("mean") * (1 - F.col("mean")) * (F.col("n") - 1)
    row = groups.filter("n > 0").agg(F.sum(spread).alias("a"), F.sum(scale).alias("b")).first()
    rho = (row["a"] / row["b"]) if row["b"] else 0.0
    rho = min(max(rho or 0.0, 1e-3), 0.9)
    return (1 - rho) / rho


def _posterior(groups: DataFrame, strength: float) -> DataFrame:
    k = F.lit(float(strength))
    return groups.withColumn("a", k * F.col("mean") + F.col("good")).withColumn("b", k * (1 - F.col("mean")) + F.col("n") - F.col("good"))


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, n, good, a, b): the beta posterior of every host of ``pages(page_id, host)``.

    ``outcomes(page_id, good)`` holds 0 or 1 per labelled page; several labels of a page count as
    their mean, rounded up. Pages without a label say nothing.
    """
    labels = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.round(F.avg("good")).alias("good"))
    # Labels are the smaller side; hosts are summed before anything is shuffled by host.
    counts = pages.join(labels, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"))
    hosts = counts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    domains = hosts.groupBy("domain").agg(F.max("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("good").alias("good"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = tops.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = ((whole["good"] or 0.0) + 0.5) / ((whole["n"] or 0) + 1.0)

    tops = tops.withColumn("mean", F.lit(mean))
    tops = _posterior(tops, _strength(tops)).select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
    domains = domains.join(tops, "suffix")
    domains = _posterior(domains, _strength(domains)).select("domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
    hosts = hosts.join(domains, "domain")
    return _posterior(hosts, _strength(hosts)).select("host", "n", "good", "a", "b")


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    least_good: float = 0.5,
    z: float = 1.645,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``n_labelled``, ``posterior_mean``, ``upper_bound``.

    The longest fitting rule decides; else a host is blocked when its posterior mean plus ``z`` standard
    deviations is below ``least_good``. Null urls and urls without ``://`` have an empty host, which is judged
    like any host. Null ids and repeated rows keep their rows; extra columns are ignored.
    """
    url = F.col("url").cast("string")
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = reputation(split.select("page_id", "host"), outcomes, suffixes)
    total = F.col("a") + F.col("b")
    bound = F.col("a") / total + z * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    known = known.select("host", F.col("n").alias("n_labelled"), (F.col("a") / total).alias("posterior_mean"), F.least(bound, F.lit(1.0)).alias("upper_bound"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("upper_bound") < least_good, F.lit("block")).otherwise(F.lit("allow"))
    return split.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_labelled", "posterior_mean", "upper_bound"
    )
