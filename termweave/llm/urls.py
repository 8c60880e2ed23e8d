"""URL filters by empirical-Bayes host reputation; DataFrame functions only.

Pages with a labelled outcome (1 good, 0 bad) are counted by host. Good rates are shrunk along host,
registered domain and suffix: the suffix posterior starts from the rate of all labelled pages, a domain's from its
suffix, a host's from its domain. At each level the prior is Beta(k m, k (1 - m)) with m the parent's posterior mean and k the
level's strength, estimated for all its members by the method of moments of the beta-binomial. A host is
blocked if its posterior mean less ``z`` posterior standard deviations is under ``least``. Hosts without labelled
pages have their domain's, suffix's or the overall rate, as far as there is one. A host's reputation is that of its name without user and
port. The suffix is its last label, or the last two where they are one of ``suffixes``; the registered domain has one label more.

Rules come first: (host, path, verdict) fits the host and its subdomains if the path starts with the rule's; the
longest host and path together win, at equal length the longer host.

Cases: a null url, or one without ``://``, has an empty host and path, and so the reputation of the empty host;
pages without outcome are judged like all others; repeated rows are judged each, and their outcomes counted each; no labelled page at all gives a rate
of one half; an empty table gives no rows; other columns play no part, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.plans.shared import Cut

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Suffixes of two labels that registries sell names under; a parameter.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "ac.jp", "co.jp", "ne.jp", "or.jp", "com.au", "net.au", "org.au", "com.br", "net.br", "com.cn", "com.mx", "com.tr", "com.tw", "co.in", "co.kr", "co.nz", "co.za")
#: Posterior bound: standard deviations below the mean, and the least good rate that passes.
Z, LEAST = 2.0, 0.8
#: Bounds of the correlation of two pages under one parent; a prior's strength is its reciprocal less one.
RHO = (1e-3, 0.5)


def parsed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, host, path) per row of pages."""
    rest = F.when(F.col("u").contains("://"), F.substring(F.col("u"), F.instr("u", "://") + 3, F.length("u"))).otherwise("")
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u")).select("id", F.coalesce(rest, F.lit("")).alias("r"))
    cutoff = plain.select("id", F.substring_index(F.substring_index("r", "?", 1), "#", 1).alias("r"))
    host = F.substring_index("r", "/", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return cutoff.select("id", low.alias("host"), F.substring(F.col("r"), F.length(host) + 1, F.length("r")).alias("path"))


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Rules are parameters, a few hundred at most."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _shrunk(counts: DataFrame) -> DataFrame:
    """counts (n, good, m: the prior's mean, ...) with posterior mean and var; the strength is one number for the level."""
    base = F.col("m") * (1 - F.col("m"))
    # moments: E (good - n m)^2 / n = m (1 - m) (1 + (n - 1) rho), and the strength is 1 / rho - 1
    off = F.col("good") - F.col("n") * F.col("m")
    excess, room = counts.agg(F.sum(off * off / F.col("n") - base), F.sum(base * (F.col("n") - 1))).first()
    rho = min(max(excess / room, RHO[0]), RHO[1]) if room else RHO[1]
    k = 1 / rho - 1
    a, b = F.col("good") + k * F.col("m"), F.col("n") - F.col("good") + k * (1 - F.col("m"))
    return counts.select("*", (a / (a + b)).alias("mean"), (a * b / ((a + b) * (a + b) * (a + b + 1))).alias("var"))


def bare(host: Column) -> Column:
    """A host's name without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def reputation(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """(host, mean, var) of every host from (host, n, good), n = 0 where no page of it is labelled.

    Every step works on rows by host, domain or suffix, into which pages have been counted before.
    """
    two = F.substring_index("host", ".", -2).isin(*suffixes)
    suffix = F.when(two, F.substring_index("host", ".", -2)).otherwise(F.substring_index("host", ".", -1))
    domain = F.when(two, F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2))
    named = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), F.col("n").cast("double").alias("n"), F.col("good").cast("double").alias("good"))
    good, n = named.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    overall = (good + 0.5) / (n + 1)
    marked = named.where("n > 0")
    total = lambda *keys: marked.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    mean = lambda df, key: df.select(F.col(key).alias("k"), F.col("mean").alias("m"), F.col("var").alias("v"))
    suffixes = mean(Cut(_shrunk(total("suffix").withColumn("m", F.lit(overall))), "suffixes").df, "suffix")
    domains = mean(Cut(_shrunk(total("domain", "suffix").join(suffixes, F.col("suffix") == F.col("k"))), "domains").df, "domain")
    own = mean(Cut(_shrunk(marked.join(domains, F.col("domain") == F.col("k"))), "own").df, "host")
    out = named.select("host", "domain", "suffix")
    for level, (df, key) in enumerate(((own, "host"), (domains, "domain"), (suffixes, "suffix"))):
        out = out.join(df.select(F.col("k").alias(f"k{level}"), F.col("m").alias(f"m{level}"), F.col("v").alias(f"v{level}")), F.col(key) == F.col(f"k{level}"), "left")
    return out.select("host", F.coalesce("m0", "m1", "m2", F.lit(overall)).alias("mean"), F.coalesce("v0", "v1", "v2", F.lit(overall * (1 - overall))).alias("var"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", outcome_id: str = "page_id", good_col: str = "good", rules=RULES, z: float = Z, least: float = LEAST, suffixes=SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict, mean, bound) per row of pages."""
    urls = parsed(pages, id_col, url_col).withColumn("name", bare(F.col("host")))
    marked = outcomes.groupBy(F.col(outcome_id).alias("o")).agg(F.max(F.col(good_col).cast("int")).alias("g"))
    counted = urls.select("id", F.col("name").alias("host")).join(marked, F.col("id") == F.col("o"), "left").groupBy("host").agg(F.count("g").alias("n"), F.coalesce(F.sum("g"), F.lit(0)).alias("good"))
    hosts = Cut(counted, "hosts").df
    known = Cut(reputation(hosts, suffixes).select(F.col("host").alias("h"), "mean", (F.col("mean") - z * F.sqrt("var")).alias("bound")), "reputation").df
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") >= least, "allow").otherwise("block")
    return urls.join(known, F.col("name") == F.col("h")).select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"))


def op2_urls(spark, sf_dir: str) -> DataFrame:
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    # the tables' labelled outcomes: a label's integer id is the id of a page, quality its outcome
    got = judge(pages, labels.where("quality IS NOT NULL"), outcome_id="doc_id", good_col="quality")
    return got.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "mean", "bound")
