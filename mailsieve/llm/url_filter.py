"""URL filter: rules first, else the reputation of the host, with DataFrame functions only.

Labelled outcomes of pages are summed by host, registered domain and suffix.
Each level is shrunk towards the one above by a beta-binomial prior whose
strength is estimated from the level itself (moments), so a host with few
labelled pages is judged like its domain, and that like its suffix.  A url is
blocked when the lower bound of its host's posterior is under ``min_good``.

Rules are joined to the hosts, not to the pages: each host is looked up under
all its parent hosts, whatever the number of rules.  Pages then get what holds
for their host by one join, which Spark broadcasts if the hosts are few and
otherwise splits at hot hosts.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is judged by the outcomes of all such urls; outcomes that are null are
unlabelled; several outcomes of one page count as the best one; repeated pages
each count and each give a row; without any outcome the share is taken as one
half; extra columns of the pages are kept, those with the names of new ones are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels; any other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "com.mx", "com.tr", "co.za")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.element_at(labels, -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    n = F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def _strength(groups: DataFrame, mean: Column) -> float:
    """How many outcomes the prior of a level weighs, by the moments of the beta-binomial."""
    p = F.least(F.greatest(mean, F.lit(1e-6)), F.lit(1 - 1e-6))
    r = groups.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2) / (p * (1 - p))).alias("x"), F.count("*").alias("g"), F.sum(F.col("n") - 1).alias("f")).first()
    if not r.g or not r.f:
        return 1.0
    rho = min(0.9, max(1e-3, (r.x - r.g) / r.f))
    return 1 / rho - 1


def host_reputation(pages: DataFrame, *, host_col: str = "host", good_col: str = "good", z: float = 1.645) -> DataFrame:
    """One row per host: ``n`` labelled pages, ``k`` good ones, posterior ``mean`` and lower ``bound``."""
    good = F.col(good_col).cast("int")
    hosts = pages.groupBy(F.col(host_col).alias("host")).agg(F.count(good).alias("n"), F.coalesce(F.sum(good), F.lit(0)).alias("k"))
    hosts = written(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "url-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    top = (total.k + 0.5) / (total.n + 1) if total.n else 0.5
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes = hosts.groupBy("suffix").agg(*sums)
    s = _strength(suffixes, F.lit(top))
    suffixes = suffixes.select("suffix", ((F.col("k") + s * top) / (F.col("n") + s)).alias("suffix_mean"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    s = _strength(domains, F.col("suffix_mean"))
    domains = written(domains.select("domain", ((F.col("k") + s * F.col("suffix_mean")) / (F.col("n") + s)).alias("domain_mean")), "url-domains")
    hosts = hosts.join(domains, "domain")
    s = _strength(hosts, F.col("domain_mean"))
    a = F.col("k") + s * F.col("domain_mean")
    b = F.col("n") - F.col("k") + s * (1 - F.col("domain_mean"))
    mean = a / (a + b)
    return hosts.select("host", "n", "k", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound"))


def _fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules that are for a host or one of its parents, longest first."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = rules.select(
        F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER).alias("rule_host"),
        F.regexp_replace("rule", r"(?s)^[^/]*", "").alias("path"),
        F.col("rule"),
        F.col("verdict"),
    )
    found = hosts.select("host", F.explode(parents).alias("rule_host")).join(own, "rule_host")
    rank = F.struct((-F.length("rule")).alias("shorter"), "rule", F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    return found.groupBy("host").agg(F.sort_array(F.collect_set(rank)).alias("__rules"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, *, min_good: float = 0.5, z: float = 1.645) -> DataFrame:
    """``pages`` (``page_id``, ``url``, ...) with ``host``, ``path``, ``rule`` and ``verdict``.

    ``outcomes`` has ``page_id`` and ``good`` (0 or 1), ``rules`` has ``rule``
    (host and start of the path, such as ``example.com/de/``) and ``verdict``.
    """
    new = ("host", "path", "rule", "verdict", "good")
    pages = pages.drop(*(c for c in new if c in pages.columns))
    known = outcomes.where("good is not null").groupBy("page_id").agg(F.max("good").alias("good"))
    labelled = pages.select("page_id", host_of(F.col("url")).alias("host")).join(known, "page_id", "left")
    hosts = written(host_reputation(labelled, z=z), "url-reputation")
    hosts = written(hosts.join(_fitting(hosts.select("host"), rules), "host", "left").select(F.col("host").alias("__host"), "bound", "__rules"), "url-verdicts")
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).join(hosts, F.col("host") == F.col("__host"), "left")
    hit = F.get(F.filter("__rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    verdict = F.when(F.col("bound") >= min_good, "allow").otherwise("block")
    return out.withColumn("__hit", hit).select(*pages.columns, "host", "path", F.col("__hit.rule").alias("rule"), F.coalesce("__hit.rule_verdict", verdict).alias("verdict"))
