"""URL filters by rules and empirical-Bayes host reputation, in DataFrame functions only.

Rules come first. For the rest, the share of bad outcomes among a host's labelled
pages is shrunk through beta-binomial priors: the suffix (last label of the host, or
the last two where ``SUFFIXES`` has them) towards all pages, the registered domain
(one label more) towards its suffix, the host towards its domain. Ports don't count. How strongly each level is shrunk is estimated from how
much more its groups differ than chance would have it (the intra-class
correlation by moments). A host is blocked if the lower posterior bound of its bad
share lies above the limit.

Outcomes are aggregated by host with map-side sums before anything else, and
verdicts are made once for each host; the pages meet them in one join on host,
whose skew Spark splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.shared import free_name, settle

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's. At most some thousands.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of two labels, country by country; all others count as one label.
SUFFIXES = tuple(
    f"{second}.{country}"
    for country, seconds in {
        "uk": "co org ac gov ltd plc me net sch nhs", "au": "com net org edu gov id asn", "nz": "co net org ac govt school geek",
        "br": "com net org gov edu art blog", "jp": "co ne or ac go ad ed gr lg", "kr": "co ne or ac go re pe",
        "in": "co net org gen firm ind ac edu gov nic", "za": "co net org web gov ac", "il": "co org net ac gov muni",
        "cn": "com net org gov edu ac", "tw": "com net org gov edu idv", "hk": "com net org gov edu idv", "sg": "com net org gov edu per",
        "my": "com net org gov edu name", "th": "co in ac go or net", "id": "co or web ac go sch my", "ph": "com net org gov edu",
        "vn": "com net org gov edu", "tr": "com net org gov edu web gen", "ua": "com net org gov edu in", "pl": "com net org gov edu",
        "mx": "com net org gob edu", "ar": "com net org gob edu", "co": "com net org gov edu", "pe": "com net org gob edu",
        "at": "co or ac gv", "hu": "co org", "es": "com nom org gob edu", "pt": "com org gov edu", "gr": "com net org gov edu",
        "eg": "com net org gov edu", "ng": "com net org gov edu", "ke": "co or ne go ac", "sa": "com net org gov edu", "pk": "com net org gov edu",
    }.items()
    for second in seconds.split()
)
MOST_BAD = 0.5
Z = 1.645
#: Limits of the estimated correlation, and its value where nothing can be estimated.
LEAST_RHO, MOST_RHO, DEFAULT_RHO = 0.001, 0.5, 0.1


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_port(of: Column) -> Column:
    return F.regexp_replace(of, r":[0-9]*$", "")


def suffix(of: Column) -> Column:
    name = without_port(of)
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain(of: Column) -> Column:
    name = without_port(of)
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does."""
    best = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, of, start in reversed(best):
        fits = ((host_ == of) | host_.endswith(f".{of}")) & path_.startswith(start)
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def strength(groups: DataFrame) -> float:
    """Pseudo-observations of the prior, from (n, bad) of a level's groups: one row of sums reaches the driver."""
    n, bad, k, squares, by_rate = groups.agg(
        F.sum("n"), F.sum("bad"), F.count("*"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("bad") * F.col("bad") / F.col("n"))
    ).first()
    rho = DEFAULT_RHO
    if n and k > 1:
        m = bad / n
        spread, room = m * (1 - m), n - squares / n - (k - 1)
        if spread > 0 and room > 0:
            rho = ((by_rate - n * m * m) - (k - 1) * spread) / (spread * room)
    rho = min(max(rho, LEAST_RHO), MOST_RHO)
    return (1 - rho) / rho


def reputations(hosts: DataFrame, outcomes: DataFrame, most_bad: float = MOST_BAD, z: float = Z) -> DataFrame:
    """(host, bad_mean, bad_bound, verdict) for each row of hosts (host), from outcomes (host, bad: 0 or 1, null unlabelled).

    Without any outcome the mean is one half and nothing is blocked.
    """
    by_host = settle(
        outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("double").alias("bad"))
    )

    def level(name: str, of) -> tuple[DataFrame, float]:
        groups = by_host.groupBy(of(F.col("host")).alias(name)).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        s = strength(groups)
        return groups.select(name, F.col("n").alias(f"{name}_n"), F.col("bad").alias(f"{name}_bad")), s

    suffixes, s_suffix = level("suffix", suffix)
    domains, s_domain = level("domain", domain)
    by, s_host = level("of_host", without_port)
    n, bad = by_host.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    known = (
        hosts.withColumns({"suffix": suffix(F.col("host")), "domain": domain(F.col("host"))})
        .join(suffixes, "suffix", "left")
        .join(domains, "domain", "left")
        .join(by, without_port(F.col("host")) == F.col("of_host"), "left")
    )

    def shrunk(name: str, towards: Column, s: float) -> Column:
        n_, bad_ = F.coalesce(f"{name}_n", F.lit(0)), F.coalesce(f"{name}_bad", F.lit(0.0))
        return (bad_ + s * towards) / (n_ + s)

    mean = shrunk("of_host", shrunk("domain", shrunk("suffix", F.lit((bad + 1) / (n + 2)), s_suffix), s_domain), s_host)
    weight = F.coalesce("of_host_n", F.lit(0)) + s_host
    bound = F.col("bad_mean") - z * F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.col("weight") + 1))
    return known.select("host", mean.alias("bad_mean"), weight.alias("weight")).select(
        "host", "bad_mean", bound.alias("bad_bound"), F.when(bound > most_bad, "block").otherwise("allow").alias("verdict")
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; outcomes has (url, bad: 1 bad, 0 good, null unlabelled).

    A null url, and one without ``://``, has an empty host and path, which no rule
    fits; pages of empty host share one reputation. Urls of any length are read
    whole. Repeated pages are judged alike; no pages give an empty result. Without outcomes, all that no rule blocks is allowed. Columns called
    like the added ones are replaced.
    """
    labelled = outcomes.select(host(F.col("url")).alias("host"), F.col("bad").cast("int").alias("bad"))
    hosts = pages.select(host(F.col(url)).alias("host")).distinct()
    found = free_name(pages, "reputation")
    verdicts = settle(reputations(hosts, labelled)).select(F.struct("host", "verdict").alias(found))
    df = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (
        df.join(verdicts, F.col("host") == F.col(f"{found}.host"), "left")
        .withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.col(f"{found}.verdict"))})
        .drop(found)
    )
