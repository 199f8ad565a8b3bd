"""URL filter by empirical-Bayes host reputation, with hard rules on host and path."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored


# Common suffixes of two labels; hand in a full list where more are needed.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for pages of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """Parameters of the shrinkage.

    A host is blocked when its posterior probability of a bad page lies above ``max_bad``, or above ``times`` the share of
    bad pages overall, even at the lower bound, ``z`` posterior standard deviations under the mean. ``strength`` bounds the
    pseudo-count of every prior. ``suffixes``: suffixes of two or three labels under which domains are registered.
    """

    max_bad: float = 0.5
    times: float = 2.0
    z: float = 1.645
    strength: tuple[float, float] = (1.0, 1000.0)
    suffixes: tuple[str, ...] = SUFFIXES


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or a text without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1)).otherwise("")
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    path = F.substr(rest, F.length(host) + 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as a struct (name, verdict), else null."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_outcomes(pages: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, n, bad) of every host: the suffix is its last two or three labels if they are listed, else the
    last one; the registered domain has one label more."""

    def last(labels: int) -> Column:
        return F.substring_index("host", ".", -labels)

    listed = [last(k).isin(*[s for s in suffixes if s.count(".") == k - 1]) for k in (2, 3)]
    places = F.when(listed[1], 3).when(listed[0], 2).otherwise(1)

    def label(more: int) -> Column:
        return F.when(places == 3, last(3 + more)).when(places == 2, last(2 + more)).otherwise(last(1 + more))

    counts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    return counts.select("host", label(1).alias("domain"), label(0).alias("suffix"), "n", "bad")


def overall_share(hosts: DataFrame) -> float:
    """Share of bad pages among all labelled ones, half a page of either kind added."""
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    return ((whole.bad or 0) + 0.5) / ((whole.n or 0) + 1)


def _shrunk(level: DataFrame, p: Reputation) -> DataFrame:
    """Posterior of each group from its own counts and its parent's mean ``prior``; the pseudo-count is fitted by moments.

    The within-group correlation rho solves  sum n (rate - prior)^2 = sum prior (1 - prior) (1 + (n - 1) rho).
    """
    spread = F.col("prior") * (1 - F.col("prior"))
    seen = level.filter("n > 0")
    moments = seen.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), F.lit(2.0))).alias("found"),
        F.sum(spread).alias("base"),
        F.sum(spread * (F.col("n") - 1)).alias("slope"),
    ).first()
    least, most = p.strength
    rho = (moments.found - moments.base) / moments.slope if moments.slope else 0.0
    strength = min(max(1 / rho - 1, least), most) if rho > 0 else most
    total = F.col("n") + strength
    mean = (F.col("bad") + strength * F.col("prior")) / total
    return level.withColumn("mean", mean).withColumn("sd", F.sqrt(mean * (1 - mean) / (total + 1)))


def host_reputation(hosts: DataFrame, overall: float, p: Reputation = Reputation()) -> DataFrame:
    """(host, mean, bound): beta posterior of a bad page, shrunk from host to registered domain to suffix to all pages.

    ``hosts`` is a stored result of ``host_outcomes``, ``overall`` its share of bad pages. Every level is an aggregate of the one below; only three moments
    a level come back to the driver. A host without labelled pages takes its domain's mean, the empty host the overall one.
    """
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffix = _shrunk(hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(overall)), p)
    domain = hosts.groupBy("suffix", "domain").agg(*sums).join(suffix.select("suffix", F.col("mean").alias("prior")), "suffix")
    domain = _shrunk(domain, p)
    host = hosts.join(domain.select("domain", F.col("mean").alias("prior")), "domain")
    return _shrunk(host, p).select("host", "mean", (F.col("mean") - p.z * F.col("sd")).alias("bound"))


def judge(pages: DataFrame, rules: Sequence[Rule], p: Reputation = Reputation(), url: str = "url", bad: str = "bad") -> DataFrame:
    """Add host, path, rule, verdict (allow or block), and the host's posterior ``mean`` and lower ``bound`` to every page;
    ``bad`` is its labelled outcome, null without one.

    Columns of these names are replaced. Null urls and urls without ``://`` have an empty host and path and are judged like
    any host. Repeated pages count as often as they come; an empty table gives an empty result. Of a hot host only its
    counts are shuffled; the join back leaves a hot host to the adaptive skew join, or broadcasts the reputations when they
    are measured small.
    """
    host, path = url_parts(F.col(url))
    split = pages.withColumns({"host": host, "path": path, "bad": F.col(bad).cast("boolean")}).drop("mean", "bound")
    hosts = stored(host_outcomes(split, p.suffixes), "hosts")
    overall = overall_share(hosts)
    reputations = host_reputation(hosts, overall, p)
    fitted = split.withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("bound") > min(p.max_bad, p.times * overall), "block").otherwise("allow")
    return (
        fitted.join(reputations, "host", "left")
        .withColumn("rule", F.col("__rule.name"))
        .withColumn("verdict", F.coalesce("__rule.verdict", by_method))
        .drop("__rule")
    )
