"""Url filtering by empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes (bad or not) are counted per host.  Hosts of one registered domain share a
beta prior around the domain's own posterior rate, domains of one suffix around the suffix's, and
suffixes around the rate of all labelled pages.  The prior's strength at each level is the moment
estimate of the beta-binomial over the level's members.  A host is blocked when the lower bound
of its posterior bad rate, mean less ``z`` standard deviations, is above ``bad_rate``.  A host
without labels has its nearest ancestor's posterior.  Explicit rules go before the reputation.

Only counts are grouped (map-side first), so a host with a third of all pages is one row of the
reputation table; pages are joined to it by host, by broadcast where the table has at most
``BROADCAST_HOSTS`` rows and otherwise by a shuffle of keys without the pages' contents.

An outcome belongs to the pages whose key equals its own; the key is the page's id, or what the
caller derives from the url (``document_of``: the id of the document that the page carries).

A null url, or one without ``://``, has an empty host and path; no rule fits it and it has the
reputation of all pages together.  Repeated pages and labels count each time; null outcomes don't
count.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import named, written

BROADCAST_HOSTS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Endings of two labels below which domains are registered: a general label under a country's.
DOUBLE_SUFFIX = r"^(ac|co|com|edu|gob|gouv|gov|ltd|mil|ne|net|nom|or|org|plc|sch)\.[a-z][a-z]$"
#: What stands for the suffix of all hosts that are addresses.
ADDRESS = "(address)"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def document_of(url: Column) -> Column:
    """The id of the document a page carries: the number that ends the url's path, before a file
    ending or a slash; null where there is none."""
    return F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/*$", 1).try_cast("long")


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The text of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, rule.text).otherwise(out)
    return out


def _bare(host: Column) -> Column:
    """The host without a user's name or a port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]+$", "")


def _is_address(bare: Column) -> Column:
    return bare.rlike(r"^[0-9]+([.][0-9]+){3}$") | bare.startswith("[")


def suffix_of(host: Column, double: str = DOUBLE_SUFFIX) -> Column:
    """The last label, or the last two where they are a double suffix; one for all addresses."""
    bare = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(_is_address(bare), ADDRESS).when(two.rlike(double), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, double: str = DOUBLE_SUFFIX) -> Column:
    """One label more than the suffix; an address is its own domain."""
    bare = _bare(host)
    two, three = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -3)
    return F.when(_is_address(bare), bare).when(two.rlike(double), three).otherwise(two)


def _strength(members: DataFrame, parent_rate: Column) -> float:
    """Moment estimate of a beta prior's strength (its pseudo-count) from members with n and bad,
    where ``parent_rate`` is the rate around which each member is drawn."""
    row = members.where("n > 1").agg(
        F.sum(F.col("n") * parent_rate * (1 - parent_rate)).alias("binomial"),
        F.sum(F.pow(F.col("bad") - F.col("n") * parent_rate, 2)).alias("square"),
        F.sum(F.col("n") * (F.col("n") - 1) * parent_rate * (1 - parent_rate)).alias("extra"),
    ).first()
    if not row["extra"]:
        return 10.0
    # variance of bad: n m (1 - m) (1 + (n - 1) rho), rho = 1 / (strength + 1)
    rho = min(0.999, max(1e-4, (row["square"] - row["binomial"]) / row["extra"]))
    return 1 / rho - 1


def host_reputation(labelled: DataFrame) -> DataFrame:
    """``labelled`` has host and bad (0 or 1).  One row per host, domain and suffix, with level and
    name, the posterior's mean and standard deviation and n; one row (all, '') for the root."""
    rows = labelled.where("bad is not null")
    hosts = written(
        rows.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}),
        "hosts",
    )
    root = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n, bad = root["n"] or 0.0, root["bad"] or 0.0
    rate = (bad + 0.5) / (n + 1)
    spark = labelled.sparkSession
    out = spark.range(1).select(*_posterior(F.lit("all"), F.lit(""), F.lit(n), F.lit(bad), F.lit(rate), 1.0))
    parents = None
    for level, above in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        keys = [level] + ([above] if above else [])
        members = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if parents is None:
            members = members.withColumn("parent", F.lit(rate))
        else:
            members = members.join(parents.select(F.col("name").alias(above), F.col("mean").alias("parent")), above)
        members = written(members, level)
        strength = _strength(members, F.col("parent"))
        parents = members.select(*_posterior(F.lit(level), F.col(level), F.col("n"), F.col("bad"), F.col("parent"), strength))
        out = out.unionByName(parents)
    return out


def _posterior(level: Column, name: Column, n: Column, bad: Column, parent: Column, strength: float) -> list[Column]:
    a, b = bad + strength * parent, n - bad + strength * (1 - parent)
    mean = a / (a + b)
    return [level.alias("level"), name.alias("name"), n.alias("n"), mean.alias("mean"), F.sqrt(mean * (1 - mean) / (a + b + 1)).alias("sd")]


def url_verdicts(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = (), id_col: str = "page_id", url_col: str = "url",
    outcome_id: str = "page_id", outcome_col: str = "bad", bad_rate: float = 0.5, z: float = 2.0, key: Column | None = None,
) -> DataFrame:
    """One row per page: id, host, path, rule (null where none fits), reputation (posterior mean of
    the bad rate), bound, and verdict: the rule's action, else block where the bound is above
    ``bad_rate`` and allow otherwise.  Outcomes are joined by ``key``, without it by the page's id."""
    host, path = host_of(named(url_col)), path_of(named(url_col))
    rows = pages.select(named(id_col).alias("id"), host.alias("host"), path.alias("path"))
    keyed = pages.select((named(id_col) if key is None else key).alias("key"), host.alias("host"))
    labelled = keyed.join(outcomes.select(named(outcome_id).alias("key"), named(outcome_col).alias("bad")), "key").select("host", "bad")
    known = written(host_reputation(labelled), "reputation")
    # of each host that occurs, the nearest ancestor's posterior that there is
    seen = rows.groupBy("host").agg(F.count("*").alias("pages")).drop("pages")
    at = seen.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    for level in ("host", "domain", "suffix"):
        own = known.where(F.col("level") == level).select(F.col("name").alias(level), F.struct("mean", "sd").alias(f"at_{level}"))
        at = at.join(own, level, "left")
    root = known.where("level = 'all'").select("mean", "sd").first()
    best = F.coalesce("at_host", "at_domain", "at_suffix", F.struct(F.lit(root["mean"]).alias("mean"), F.lit(root["sd"]).alias("sd")))
    at = written(at.select("host", best["mean"].alias("reputation"), (best["mean"] - z * best["sd"]).alias("bound")), "verdicts")
    joined = rows.join(F.broadcast(at) if at.count() <= BROADCAST_HOSTS else at, "host", "left")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.text, r.action).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("bound") > bad_rate, "block").otherwise("allow"))
    return joined.withColumn("rule", rule).select(F.col("id").alias(id_col), "host", "path", "rule", "reputation", "bound", verdict.alias("verdict"))
