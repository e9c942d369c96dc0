"""URL filters by empirical-Bayes host reputation (operator 13).

Labelled outcomes of pages (good or bad) are few for most hosts. A host's share of good pages is therefore drawn towards
that of the other hosts of its registered domain, the domain's towards that of the other domains of its suffix, and the
suffix's towards all others: at each level a beta prior with the upper level's mean. How strong the prior is follows from
the data: the spread of the groups' counts beyond what chance gives (the overdispersion of the beta-binomial, by moments).
Prior means leave the group itself out, so no outcome counts twice.

1. *Count*: outcomes are summed by host, then by domain, then by suffix; sums are combined before each shuffle, so a host
   with a third of all pages is one row.
2. *Shrink*: from the top down, one row of moments a level goes to the driver.
3. *Judge*: rules decide first. Else a page goes if its host does: where the upper bound of the posterior share of good
   pages lies below ``least_good``. Pages meet the blocked hosts only; a hot host's pages may be split by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.storage import materialize

#: Labels below a country's domain that belong to its suffix: names are registered below them. Fixed, a parameter's default.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "go", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; then up to ``?``, ``#`` or
    the end. Null, or without ``://``: both empty."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def site_of(host: Column) -> Column:
    """A host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def suffix_of(site: Column, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    """The last label, or the last two of a country's domain; empty for addresses of numbers."""
    two = f"(?:{'|'.join(second_level)})\\.[a-z]{{2}}"
    numbers = site.rlike(r"^[0-9.]*$") | site.startswith("[")
    return F.when(numbers, F.lit("")).when(site.rlike(f"(?:^|\\.){two}$"), F.regexp_extract(site, f"({two})$", 1)).otherwise(F.regexp_extract(site, r"([^.]*)$", 1))


def domain_of(site: Column, suffix: Column) -> Column:
    """The label before the suffix, and the suffix; the site itself where there is none before it."""
    front = F.substring(site, F.lit(1), F.length(site) - F.length(suffix) - 1)
    return F.when((suffix == "") | (F.length(suffix) >= F.length(site)), site).otherwise(F.concat(F.regexp_extract(front, r"([^.]*)$", 1), F.lit("."), suffix))


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, below ``path``: allow or block."""

    host: str
    path: str
    action: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action (ties: the longer host, then block); both null where none does. A
    rule is a pair of string tests of the scan, so the list is meant to be one that people keep by hand."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.action)):
        fits = rule.fits(host, path)
        text, action = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.action)).otherwise(action)
    return text, action


def _strength(groups: DataFrame, least: float, most: float) -> float:
    """Pages that the prior of ``groups`` (n, k, m: prior mean) counts for: 1 / rho - 1, where rho is the part of the
    squared distances from the prior mean that binomial chance leaves, kept between ``least`` and ``most``."""
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    chance = n * m * (1 - m)
    over, pairs = groups.agg(F.sum((k - n * m) * (k - n * m) - chance), F.sum((n - 1) * chance)).first()
    rho = over / pairs if pairs else 0.0
    return 1 / min(max(rho, 1 / (1 + most)), 1 / (1 + least)) - 1


def _others(n: str, k: str, n_all: Column, k_all: Column, weight: float, mean: Column) -> Column:
    """The mean of what the upper level has without this group, drawn to ``mean``."""
    return (k_all - F.col(k) + weight * mean) / (n_all - F.col(n) + weight)


def reputations(pages: DataFrame, z: float = 1.645, least_weight: float = 1.0, most_weight: float = 1000.0, second_level: Sequence[str] = SECOND_LEVEL) -> DataFrame:
    """One row per site of ``pages`` (host, good): site, domain, suffix, n (labelled pages), k (good ones), mean, upper (of the
    posterior share of good pages: mean and ``z`` standard deviations more, at most 1).

    ``good`` is 1, 0 or null (not labelled). A site without labels has its domain's prior, with the prior's width. An empty
    table gives no rows; repeated rows count each; other columns are ignored.
    """
    site = site_of(F.coalesce("host", F.lit("")))
    sites = pages.select(site.alias("site"), F.col("good").cast("long").alias("good")).groupBy("site").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    sites = sites.withColumn("suffix", suffix_of(F.col("site"), second_level)).withColumn("domain", domain_of(F.col("site"), F.col("suffix")))
    sites = materialize(sites, "url_sites")
    domains = sites.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    n_all, k_all = (F.lit(float(x or 0)) for x in suffixes.agg(F.sum("sn"), F.sum("sk")).first())
    bounds = least_weight, most_weight
    top = suffixes.withColumn("m", (k_all - F.col("sk") + 1) / (n_all - F.col("sn") + 2))
    weight = _strength(top.select(F.col("sn").alias("n"), F.col("sk").alias("k"), "m"), *bounds)
    top = top.withColumn("sw", F.lit(weight)).withColumnRenamed("m", "sm")
    middle = domains.join(top, "suffix").withColumn("m", _others("dn", "dk", F.col("sn"), F.col("sk"), weight, F.col("sm")))
    weight = _strength(middle.select(F.col("dn").alias("n"), F.col("dk").alias("k"), "m"), *bounds)
    middle = middle.select("domain", "dn", "dk", F.col("m").alias("dm"))
    low = sites.join(middle, "domain").withColumn("m", _others("n", "k", F.col("dn"), F.col("dk"), weight, F.col("dm")))
    weight = _strength(low, *bounds)
    good, bad = F.col("k") + weight * F.col("m"), F.col("n") - F.col("k") + weight * (1 - F.col("m"))
    mean = good / (good + bad)
    upper = F.least(F.lit(1.0), mean + z * F.sqrt(mean * (1 - mean) / (good + bad + 1)))
    return low.select("site", "domain", "suffix", "n", "k", mean.alias("mean"), upper.alias("upper"))


def judge(pages: DataFrame, found: DataFrame, rules: Sequence[Rule] = (), least_good: float = 0.5) -> DataFrame:
    """``pages`` (page_id, url) as page_id, host, path, rule, verdict. ``found`` is what :func:`reputations` gives.

    ``rule`` is null where none fits; ``verdict`` is the rule's, else ``block`` for the pages of sites whose ``upper`` lies
    below ``least_good`` and ``allow`` for all others, those of unknown sites and without a host too. Rows are judged
    each, null page_ids and repeated rows too; other columns are ignored; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), site_of(F.col("host")).alias("site"))
    blocked = found.where(F.col("upper") < least_good).select("site", F.lit("block").alias("bad"))
    return rows.join(blocked, "site", "left").select("page_id", "host", "path", "rule", F.coalesce("action", "bad", F.lit("allow")).alias("verdict"))
