"""URL verdicts from rules and from an empirical-Bayes host reputation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plangauge.core.columns import others

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Reputation:
    """Parameters of the beta-binomial hierarchy: prior strengths, the one-sided normal quantile, the bad share to exceed."""

    z: float = 1.645
    limit: float = 0.35
    least_strength: float = 1.0
    most_strength: float = 1000.0


def _after(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, with A-Z in lower case; empty where there is none."""
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (length, rule, verdict) of the longest fitting rule, else null. rules: (verdict, host/path) pairs, a configured list."""
    known = F.array(*[F.struct(F.lit(len(r)).alias("length"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for v, r in rules])
    fits = F.filter(known, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return best


def registered_domain(host: Column) -> Column:
    """The last two labels (no list of longer public suffixes is at hand); a host of one label is its own."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(units: DataFrame, p: Reputation) -> float:
    """Prior strength by the method of moments for units (n, bad, m): how far their rates stray from the parent's mean m."""
    t = units.where("n > 0").agg(
        F.sum(F.expr("n * pow(bad / n - m, 2)")).alias("s"), F.sum(F.expr("m * (1 - m)")).alias("v"), F.sum(F.expr("m * (1 - m) * (n - 1)")).alias("w")
    ).first()
    rho = 1.0 if not t.w else (t.s - t.v) / t.w
    return p.most_strength if rho <= 1 / (1 + p.most_strength) else max(p.least_strength, 1 / rho - 1)


def reputations(hosts: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """hosts (host, n labelled pages, bad among them), a row for each host: plus mean, bound and blocked.

    Suffixes shrink to the overall share of bad pages, registered domains to their suffix, hosts to their domain, each by a
    beta prior whose strength the spread at that level gives. A host with no labelled page has its domain's mean at the prior's
    own strength. A host is blocked if the posterior's lower bound, mean - z * deviation, is over the limit. The driver gets four numbers.
    """
    h = hosts.select("host", "n", "bad", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("sfx"))
    total = h.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    p0 = ((total.bad or 0) + 1.0) / ((total.n or 0) + 2.0)
    domains = h.groupBy("domain", "sfx").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("sfx").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    k0 = _strength(suffixes.withColumn("m", F.lit(p0)), p)
    suffixes = suffixes.select("sfx", ((F.col("bad") + k0 * p0) / (F.col("n") + k0)).alias("m"))
    domains = domains.join(suffixes, "sfx")
    k1 = _strength(domains, p)
    domains = domains.select("domain", ((F.col("bad") + k1 * F.col("m")) / (F.col("n") + k1)).alias("m"))
    h = h.join(domains, "domain")
    k2 = _strength(h, p)
    a, both = F.col("bad") + k2 * F.col("m"), F.col("n") + k2
    h = h.withColumn("mean", a / both)
    bound = F.col("mean") - p.z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (both + 1))
    return h.select("host", "n", "bad", "mean", bound.alias("bound"), (bound > p.limit).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], *, url_col: str = "url", p: Reputation = Reputation()) -> DataFrame:
    """pages plus host, path, rule and verdict. outcomes (host, bad boolean): a row for each labelled page.

    The longest fitting rule decides; where none fits, the host's reputation does. Null urls and urls without :// have an empty
    host and path. Input columns named like the new ones are replaced. Hosts with any share of all pages are safe: counts are
    taken by partial aggregation, and the join back is one that Spark can split.
    """
    seen = pages.select(*others(pages, "host", "path", "rule", "verdict"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    counts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"))
    none = seen.select("host").distinct().select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    hosts = counts.unionByName(none).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    verdicts = reputations(hosts, p).select("host", "blocked")
    best = matching_rule(F.col("host"), F.col("path"), rules)
    out = seen.join(verdicts, "host", "left").withColumn("_pg_rule", best)
    verdict = F.coalesce(F.col("_pg_rule.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select(*others(seen), F.col("_pg_rule.rule").alias("rule"), verdict.alias("verdict"))
