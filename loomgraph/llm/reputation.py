"""Verdicts on page addresses: rules first, else the host's reputation by empirical Bayes. Spark expressions only.

Labelled outcomes are counted by host. Counts of a host are shrunk to those of its registered domain, these to those
of its suffix, these to the whole table: each level's beta prior has the mean of the level above and a strength fitted
to how far the level's rates scatter beyond chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import skew, textops

#: Public suffixes of two labels. Others may be given.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.nz", "co.in", "com.br", "com.cn", "com.mx", "co.za", "com.tr", "co.kr")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRENGTH = (1.0, 1000.0)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path; both empty for null and without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domain(host: Column, two_labels: tuple[str, ...] = TWO_LABELS) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without user and port; an address of numbers is both itself."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$|\.+$", "")
    tail = lambda n: F.substring_index(name, ".", -n)
    bare = name.rlike(r"^[0-9.]*$|^\[")
    long = tail(2).isin(*two_labels) if two_labels else F.lit(False)
    return F.when(bare, name).when(long, tail(3)).otherwise(tail(2)), F.when(bare, name).when(long, tail(2)).otherwise(tail(1))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path joined) that fits, and its verdict; null without one.

    rules: host, path, verdict; a short list, held in the expression. A rule fits its host and all subdomains
    if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _shrunk(level: DataFrame) -> tuple[DataFrame, float]:
    """Adds `mean` to a level (n, bad, and mu, the mean above): the posterior mean under the fitted strength, also given.

    With outcomes of a unit correlated by rho, the squared distance of bad from n * mu is n * mu * (1 - mu) *
    (1 + (n - 1) * rho) on average; rho follows from the sums over all units, the strength is 1 / rho - 1.
    """
    spread = F.col("mu") * (1 - F.col("mu"))
    off, chance, pairs = level.agg(F.sum((F.col("bad") - F.col("n") * F.col("mu")) ** 2), F.sum(F.col("n") * spread), F.sum(F.col("n") * (F.col("n") - 1) * spread)).first()
    rho = (off - chance) / pairs if pairs else 0.0
    least, most = STRENGTH
    strength = min(most, max(least, 1 / rho - 1)) if rho > 0 else most
    return level.withColumn("mean", (F.col("bad") + strength * F.col("mu")) / (F.col("n") + strength)), strength


def fit(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, two_labels: tuple[str, ...] = TWO_LABELS) -> DataFrame:
    """(host, pages, n, bad, mean, low, high): for each host of pages (id, host), its counts and the posterior of its bad rate.

    outcomes: id and bad (0, 1 or null); of several rows of an id the worst counts, those without a page or a value
    don't. low and high are the mean less and plus z standard deviations of the beta posterior, within 0 and 1. Repeated
    pages count each. Without any outcome the mean is 0.5 and the strength the largest. A level's rows are joined to
    the level above with hot keys apart, so that a domain or suffix with most hosts is no single task.
    """
    spark = pages.sparkSession
    known = outcomes.where("id IS NOT NULL AND bad IS NOT NULL").groupBy("id").agg(F.max("bad").alias("bad"))
    own, suffix = domain(F.col("host"), two_labels)
    counts = pages.join(known, "id", "left").groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = textops.stored(counts.withColumn("domain", own).withColumn("suffix", suffix), f"{textops.shared_dir(spark)}/hosts")
    up = lambda *keys: hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    top, _ = _shrunk(up("suffix").withColumn("mu", F.lit(bad / n if n else 0.5)))
    mid, _ = _shrunk(skew.joined(up("domain", "suffix"), top.select("suffix", F.col("mean").alias("mu")), "suffix"))
    low, strength = _shrunk(skew.joined(hosts, mid.select("domain", F.col("mean").alias("mu")), "domain"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1))
    return low.select("host", "pages", "n", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - z * sd).alias("low"), F.least(F.lit(1.0), F.col("mean") + z * sd).alias("high"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], most_bad: float = 0.5, key: str = "page_id", url: str = "url", z: float = 1.645, two_labels: tuple[str, ...] = TWO_LABELS) -> DataFrame:
    """All pages with host, path, rule, verdict, and the host's n_labelled, n_bad, bad_rate, low, high.

    Rules decide; else a page is blocked if its host's bad rate is above most_bad even at the lower posterior bound.
    outcomes: id (a page's key) and bad. Null addresses, those without `://` and empty hosts share the empty host.
    Columns of pages with the names of new ones are replaced. Repeated rows stay, an empty table gives no rows, and a
    null key has no outcome.
    """
    host, path = parts(F.col(url))
    fresh = ("host", "path", "rule", "verdict", "n_labelled", "n_bad", "bad_rate", "low", "high")
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in fresh or c in (key, url)])
    keyed = rows.withColumn("host", host).withColumn("path", path)
    facts = fit(pages.select(F.col(key).alias("id"), host.alias("host")), outcomes, z, two_labels)
    facts = textops.stored(facts, f"{textops.shared_dir(pages.sparkSession)}/reputation")
    facts = facts.select("host", F.col("n").alias("n_labelled"), F.col("bad").cast("long").alias("n_bad"), F.col("mean").alias("bad_rate"), "low", "high")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("low") > most_bad, "block").otherwise("allow")
    return skew.joined(keyed, facts, "host").withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_host))
