"""URL rules and empirical-Bayes host reputation, in DataFrame operations only.

Rules decide the pages that they fit. Their verdicts are the labelled outcomes:
per host, the number of labelled pages and of blocked ones. A beta-binomial
prior is handed down from suffix to registered domain and host; each level's
strength comes from how much the rates below it differ (method of moments), and
a suffix starts from an even prior worth two pages. A page without a rule is
blocked if the lower posterior bound of its host's rate is above ``bound``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the rules (fixed values).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of two labels (fixed values).
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
BOUND, SCORE_Z = 0.8, 1.6448536
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0


def host_column(url: Column) -> Column:
    """Host in lower case (A-Z only): '' without '://'."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def suffix_column(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_column(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(level: DataFrame, prior: Column) -> float:
    """Beta prior strength a + b by moments: rates of groups around their prior."""
    rate, n = F.col("k") / F.col("n"), F.col("n")
    row = level.where("n > 0").select(prior.alias("p"), rate.alias("r"), n.alias("n")).agg(
        F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("within"),
        F.sum(F.col("n") * (F.col("r") - F.col("p")) ** 2).alias("spread"),
        F.sum("n").alias("n"),
        F.sum(F.col("p") * (1 - F.col("p"))).alias("noise"),
    ).first()
    if not row["n"]:
        return LEAST_STRENGTH
    base = row["within"] / row["n"]
    between = max((row["spread"] - row["noise"]) / row["n"], 0.0)
    if between <= 0:
        return MOST_STRENGTH
    return min(max(base / between - 1, LEAST_STRENGTH), MOST_STRENGTH)


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, mean, lower) from (host, n, k): labelled pages and blocked ones."""
    hosts = outcomes.select("host", "n", "k", domain_column(F.col("host")).alias("domain"), suffix_column(F.col("host")).alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def shrink(level: DataFrame, prior: str, prior_size: Column) -> DataFrame:
        """Posterior mean and size; a prior is never surer than what it rests on."""
        strength = F.least(F.lit(_strength(level, F.col(prior))), prior_size)
        return level.withColumn("mean", (F.col("k") + strength * F.col(prior)) / (F.col("n") + strength)).withColumn(
            "size", F.col("n") + strength
        )

    s = shrink(suffixes.withColumn("even", F.lit(0.5)), "even", F.lit(LEAST_STRENGTH))
    s = s.select("suffix", F.col("mean").alias("suffix_mean"), F.col("size").alias("suffix_size"))
    d = shrink(domains.join(s, "suffix"), "suffix_mean", F.col("suffix_size"))
    d = d.select("domain", F.col("mean").alias("domain_mean"), F.col("size").alias("domain_size"))
    h = shrink(hosts.join(d, "domain"), "domain_mean", F.col("domain_size"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    return h.select("host", "mean", (F.col("mean") - SCORE_Z * sd).alias("lower"))


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, bound: float = BOUND) -> DataFrame:
    """One row per row of ``df``: id, host, path, rule, verdict, reputation.

    Null urls and urls without '://' have an empty host and path, which is a host
    like any other. The longest fitting rule wins; without one the verdict is
    block if the host's lower bound is above ``bound``. Repeated rows count as
    often as they come. Other columns of ``df`` are ignored.
    """
    url = F.col(url_col)
    pages = df.select(F.col(id_col).alias("id"), host_column(url).alias("host"), path_column(url).alias("path"))
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    pages = pages.select("*", rule.alias("rule"), ruled.alias("ruled"))
    outcomes = pages.groupBy("host").agg(
        F.count("ruled").alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("k")
    )
    known = host_reputation(outcomes).select(F.col("host").alias("of_host"), F.col("mean"), F.col("lower"))
    judged = pages.join(known, F.col("host") == F.col("of_host"), "left")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("lower") > bound, "block").otherwise("allow")).alias("verdict"),
        F.round("mean", 6).alias("reputation"),
    )
