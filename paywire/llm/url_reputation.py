"""URL filter: path rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and
suffix.  Each level's rate is shrunk towards the level above by a beta-binomial
prior whose strength comes from the spread that the children show beyond
binomial noise.  A host without labels has what its domain's posterior says of a new
host there, a domain without labels what its suffix's says, a suffix what all pages
say; each step down widens the spread by the prior of the level.  A host is blocked when
the lower posterior bound of its bad rate is over `max_bad`; the bound is the normal
approximation to the posterior's quantile, mean less `z` deviations.  Only DataFrame
functions are used.

A site's name is its host without user, port and final dots.  Its suffix is the last
part, or the last two where these are one of `second_levels` under a country's two
letters or one of `long_suffixes`; that rule stands for the public list of suffixes, of
which private ones (such as those of hosting firms) must be given.  An IP address is a
domain of its own, and all addresses share the suffix `#`.

Counts meet in partial sums before any shuffle, so a host with a third of all
rows costs no more than another.  The join back to the pages leaves the choice
between a broadcast of a size that Spark has measured and a skew-split sort-merge
join to adaptive execution.

Defined results: a NULL url, or one without `://`, has an empty host and path and
is judged as the host ``''``; repeated pages are judged and counted each;
a page id labelled more than once is bad if any label says so; NULL labels and
labels of unknown pages count nothing; with no labels at all every page that no
rule fits is allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywire.llm.common import lower_ascii, saved


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """max_bad: bad rate to tolerate; z: standard deviations below the mean that the bound lies; strengths are kept in [1, most]."""

    max_bad: float = 0.2
    z: float = 1.645
    most: float = 1000.0
    second_levels: tuple[str, ...] = ("ac", "asn", "co", "com", "ed", "edu", "go", "gob", "gouv", "gov", "gv", "id", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
    long_suffixes: tuple[str, ...] = ()


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """The host without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def _is_address(site: Column) -> Column:
    return site.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")


def _is_long(two: Column, how: Reputation) -> Column:
    return two.rlike(rf"^({'|'.join(how.second_levels)})\.[a-z]{{2}}$") | two.isin(*how.long_suffixes)


def suffix_of(host: Column, how: Reputation) -> Column:
    site = site_of(host)
    two = F.substring_index(site, ".", -2)
    return F.when(_is_address(site), F.lit("#")).when(_is_long(two, how), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(host: Column, how: Reputation) -> Column:
    site = site_of(host)
    two, three = F.substring_index(site, ".", -2), F.substring_index(site, ".", -3)
    return F.when(_is_address(site), site).when(_is_long(two, how), three).otherwise(two)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> list[tuple[Column, Rule]]:
    """Conditions in the order in which they count: the longest rule first."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    return [(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), r) for r in ordered]


def _strength(children: DataFrame, most: float) -> tuple[float, float]:
    """Mean rate and prior strength by the method of moments; one row reaches the driver."""
    rate = F.col("bad") / F.col("n")
    sums = children.where("n > 0").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("k"), F.sum(F.col("n") * rate * rate).alias("squares")).first()
    if not sums["n"]:
        return 0.0, 1.0
    mean = sums["bad"] / sums["n"]
    noise = mean * (1 - mean) * sums["k"] / sums["n"]
    between = max(sums["squares"] / sums["n"] - mean * mean - noise, 1e-9)
    return mean, min(max(mean * (1 - mean) / between - 1, 1.0), most)


def _posterior(above: Column, above_kept: Column, strength: float) -> tuple[Column, Column]:
    """Mean, and 1 less the share of mean * (1 - mean) that the variance is, of a row with n labels of which `bad` are bad."""
    weight = F.col("n") + strength
    kept = F.when(F.col("n") > 0, weight / (weight + 1)).otherwise(above_kept * strength / (strength + 1))
    return (F.col("bad") + strength * above) / weight, kept


def host_reputation(pages: DataFrame, outcomes: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """host, n_labelled, n_bad, bad_mean and bad_lower, the posterior mean and lower bound, of each host of the pages.

    pages: page_id, host.  outcomes: page_id, bad (0 or 1).
    """
    labels = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.select("page_id", "host").join(labels, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = saved(hosts.withColumn("domain", domain_of(F.col("host"), how)).withColumn("suffix", suffix_of(F.col("host"), how)), "hosts")
    domains = saved(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    mean, s_suffix = _strength(suffixes, how.most)
    s_domain, s_host = _strength(domains, how.most)[1], _strength(hosts, how.most)[1]
    m, kept = _posterior(F.lit(mean), F.lit(1.0), s_suffix)
    up = suffixes.select("suffix", m.alias("above"), kept.alias("above_kept"))
    m, kept = _posterior(F.col("above"), F.col("above_kept"), s_domain)
    up = saved(domains.join(up, "suffix").select("suffix", "domain", m.alias("above"), kept.alias("above_kept")), "domains")
    m, kept = _posterior(F.col("above"), F.col("above_kept"), s_host)
    found = hosts.join(up, ["suffix", "domain"]).select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), m.alias("bad_mean"), kept.alias("kept"))
    bound = F.col("bad_mean") - how.z * F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) * (1 - F.col("kept")))
    return saved(found.withColumn("bad_lower", bound).drop("kept"), "reputation")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], how: Reputation = Reputation(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, n_labelled, bad_mean, bad_lower."""
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = host_reputation(seen, outcomes, how)
    fits = fitting_rule(F.col("host"), F.col("path"), rules)
    none = F.lit(None).cast("string")
    rule = reduce(lambda rest, x: F.when(x[0], F.lit(x[1].text)).otherwise(rest), reversed(fits), none)
    ruled = reduce(lambda rest, x: F.when(x[0], F.lit(x[1].verdict)).otherwise(rest), reversed(fits), none)
    judged = F.when(F.col("bad_lower") > how.max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return seen.join(known, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, judged).alias("verdict"), "n_labelled", "bad_mean", "bad_lower")
