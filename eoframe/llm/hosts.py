"""URL filter by rules and, where none fits, by the empirical-Bayes reputation of the host.

Outcomes of labelled pages (1: bad) are counted per host, registered domain and
suffix.  Each level's beta prior has the posterior mean of the level above and a
strength estimated from all groups of the level by the method of moments: little
spread between groups gives a strong prior.  A page is blocked when the lower
bound of its host's posterior (mean less ``Z`` deviations) passes ``BLOCK_AT``;
an unlabelled host is judged by its domain, that by its suffix.

Labels: ``labels.quality`` of the document with the page's id; 0 is bad.

Defined results: a null url or one without ``://`` has empty host and path, fits
no rule and is judged as a host of its own; rows equal in page_id are judged one
by one; without any label every method verdict is allow; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eoframe.llm.common import ascii_lower, table

#: (rule, verdict); a rule is a host and a path
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
Z = 1.645
BLOCK_AT = 0.5
#: second-level names under which domains are registered, as in "co.uk"
SHARED = ("co", "com", "org", "net", "ac", "gov", "edu")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first, so it is wrapped last
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where the second-last is one under which domains are registered."""
    parts = F.split(host, r"\.")
    last, second = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    shared = (F.size(parts) > 2) & (F.length(last) == 2) & second.isin(*SHARED)
    return F.when(shared, F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The suffix and the label before it."""
    suffix = suffix_of(host)
    rest = F.when(F.length(host) > F.length(suffix), F.left(host, F.length(host) - F.length(suffix) - 1)).otherwise(F.lit(""))
    own = F.element_at(F.split(rest, r"\."), -1)
    return F.when(own == "", suffix).otherwise(F.concat(own, F.lit("."), suffix))


def _shrunk(level: DataFrame, key: str, upper: DataFrame, upper_key: str) -> DataFrame:
    """(key, mean, strength) of ``level`` (key, upper_key, n, bad), shrunk to the means of ``upper``."""
    with_prior = level.join(upper.select(F.col(upper_key).alias("uk"), F.col("mean").alias("prior")), F.col(upper_key) == F.col("uk"), "left")
    # moments over groups: spread beyond what draws with the prior's rate would show
    rate = F.col("bad") / F.col("n")
    noise = F.col("prior") * (1 - F.col("prior"))
    parts = with_prior.where("n > 0").agg(
        F.sum(F.col("n") * (F.pow(rate - F.col("prior"), F.lit(2)))).alias("spread"), F.sum(noise).alias("noise"),
        F.sum((F.col("n") - 1) * noise).alias("room"),
    )
    share = F.greatest(F.try_divide(F.col("spread") - F.col("noise"), F.col("room")), F.lit(1e-3))
    strength = parts.select(F.least(F.greatest(1 / F.coalesce(share, F.lit(1.0)) - 1, F.lit(0.5)), F.lit(1e3)).alias("s")).scalar()
    return with_prior.withColumn("s", strength).select(
        key, ((F.col("bad") + F.col("s") * F.col("prior")) / (F.col("n") + F.col("s"))).alias("mean"), (F.col("n") + F.col("s")).alias("strength")
    )


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, mean, strength) of every host of ``outcomes`` (host, bad: 0, 1 or null for an unlabelled page)."""
    marked = F.col("bad").isNotNull().cast("int")
    hosts = outcomes.groupBy("host").agg(F.sum(marked).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("all", F.lit("all"))
    whole = suffixes.groupBy("all").agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("mean"))
    by_suffix = _shrunk(suffixes, "suffix", whole, "all")
    by_domain = _shrunk(domains, "domain", by_suffix, "suffix")
    return _shrunk(hosts, "host", by_domain, "domain")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, posterior, bound per page."""
    p = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    marks = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").alias("li")).agg((1 - F.min("quality")).alias("bad"))
    outcomes = p.join(marks, F.col("page_id") == F.col("li"), "left").select("host", F.col("bad").cast("bigint").alias("bad"))
    # one row per host and mark first: a host may hold a third of all pages
    known = reputation(outcomes)
    any_label = outcomes.where("bad IS NOT NULL").agg(F.count("*").alias("c")).scalar() > 0
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    bound = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    verdicts = known.select(F.col("host").alias("kh"), F.col("mean").alias("posterior"), bound.alias("bound"))
    method = F.when((F.col("bound") > BLOCK_AT) & any_label, F.lit("block")).otherwise(F.lit("allow"))
    return p.join(verdicts, F.col("host") == F.col("kh"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "posterior", "bound"
    )


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
