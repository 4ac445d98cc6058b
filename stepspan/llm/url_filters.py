"""URL filters: rules first, then empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or not) are counted per host. Beta-binomial priors shrink them downwards: the rate of all
labels is the prior of a suffix, a suffix's posterior that of its registered domains, a domain's posterior that of its
hosts. The weight of each prior comes from the data by moments: the spread of the children's rates around their
parent's beyond what binomial noise explains. A page is blocked when the lower bound of its host's posterior rate of bad
pages is above a limit; hosts without labels are judged by their domain's posterior, these by their suffix's.

Nulls: a null url, or one without "://", has an empty host and path, no rule and the reputation of the empty host.
Null label values count as not bad; labels without a page count nowhere; several labels of a page count once each. With
no labels at all every page without a rule is allowed. Pages with equal urls are judged alike, repeated rows stay.
Very long urls are taken whole. Only page_id and url are read, other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: (action, host, path prefix): fixed values of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Second-level names under which a country's registrars sell names: fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    at = F.instr("url", "://")
    rest = F.when(F.col("url").isNull() | (at == 0), "").otherwise(F.expr("substring(url, instr(url, '://') + 3)"))
    return pages.select("page_id", "url").select(
        "page_id",
        F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as (host/path text, action)."""
    name = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits is the longest
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def registered_domain(host: Column) -> Column:
    parts = F.split(host, r"\.")
    n = F.size(parts)
    two = F.when((n >= 3) & F.element_at(parts, -2).isin(*SECOND_LEVEL) & (F.length(F.element_at(parts, -1)) == 2), 3).otherwise(2)
    return F.when(n <= two, host).otherwise(F.array_join(F.slice(parts, -two, two), "."))


def _prior_weight(child: DataFrame) -> float:
    """By moments: how many labels a parent's rate is worth for its children. One number comes to the driver."""
    spread = F.sum((F.col("bad") - F.col("n") * F.col("m")) ** 2)
    noise = F.sum(F.col("n") * F.col("m") * (1 - F.col("m")))
    extra = F.sum(F.col("n") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m")))
    rho = F.when(extra > 0, (spread - noise) / extra)
    rho = F.least(F.greatest(rho, F.lit(0.001)), F.lit(0.5))
    return child.filter("n > 0").agg(1 / F.coalesce(rho, F.lit(0.1)) - 1).first()[0]


def _shrunk(weight: float) -> Column:
    return (F.col("bad") + weight * F.col("m")) / (F.col("n") + weight)


def host_reputation(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """outcomes: (host, bad 0 or 1); hosts: (host), distinct. -> host, n, bad, posterior_mean, lower, upper."""
    counted = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    x = (
        hosts.join(counted, "host", "left")
        .select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"), registered_domain(F.col("host")).alias("domain"))
        .withColumn("suffix", F.when(F.instr("domain", ".") > 0, F.expr("substring(domain, instr(domain, '.') + 1)")).otherwise(F.col("domain")))
    )
    x = staged(x, "hosts")
    domains = staged(x.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = domains.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    suffixes = suffixes.withColumn("m", F.lit((bad + 0.5) / (n + 1.0)))
    suffixes = staged(suffixes.select("suffix", _shrunk(_prior_weight(suffixes)).alias("m")), "suffixes")
    d = domains.join(suffixes, "suffix")
    d = staged(d.select("domain", _shrunk(_prior_weight(d)).alias("m")), "domain-means")
    h = x.join(d, "domain")
    weight = _prior_weight(h)
    a, b = F.col("bad") + weight * F.col("m"), F.col("n") - F.col("bad") + weight * (1 - F.col("m"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    mean = a / (a + b)
    return h.select("host", "n", "bad", mean.alias("posterior_mean"), F.greatest(mean - z * sd, F.lit(0.0)).alias("lower"), F.least(mean + z * sd, F.lit(1.0)).alias("upper"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict; n and bad: labels of the host; posterior_mean, bad_lower: of its rate of bad pages.
    labels: (page_id, bad 0 or 1)."""
    parts = with_parts(pages)
    outcomes = parts.select("page_id", "host").join(labels.select("page_id", F.coalesce("bad", F.lit(0)).alias("bad")), "page_id")
    found = host_reputation(outcomes, parts.select("host").distinct(), z)
    reputation = staged(found.select("host", "n", "bad", F.round("posterior_mean", 6).alias("posterior_mean"), F.col("lower").alias("bad_lower")), "reputation")
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.coalesce(action, F.when(F.col("bad_lower") > limit, "block").otherwise("allow"))
    return parts.join(reputation, "host", "left").select("page_id", "host", "path", name.alias("rule"), judged.alias("verdict"), "n", "bad", "posterior_mean", F.round("bad_lower", 6).alias("bad_lower"))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """The labels table as outcomes of the pages with these ids: bad if of low quality or toxic."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))


SQL = """
WITH rests AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
), outcomes AS (
  SELECT host, (coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT AS bad FROM parts JOIN labels ON page_id = doc_id
), counted AS (SELECT host, count(*) AS n, sum(bad)::BIGINT AS bad FROM outcomes GROUP BY host
), split AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, string_split(host, '.') AS p
  FROM (SELECT DISTINCT host FROM parts) LEFT JOIN counted USING (host)
), named AS (
  SELECT *, CASE WHEN len(p) >= 3 AND p[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AND length(p[-1]) = 2 THEN 3 ELSE 2 END AS two FROM split
), domained AS (SELECT host, n, bad, CASE WHEN len(p) <= two THEN host ELSE array_to_string(p[len(p) - two + 1 :], '.') END AS domain FROM named
), hosts AS (
  SELECT *, CASE WHEN instr(domain, '.') > 0 THEN substr(domain, instr(domain, '.') + 1) ELSE domain END AS suffix FROM domained
), domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad,
         (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) FROM domains) AS m
  FROM domains GROUP BY suffix
), w1 AS (
  SELECT 1 / coalesce(least(greatest(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN (sum((bad - n * m) ** 2) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)) END, 0.001), 0.5), 0.1) - 1 AS w
  FROM suffixes WHERE n > 0
), s AS (SELECT suffix, (bad + w * m) / (n + w) AS m FROM suffixes, w1
), d0 AS (SELECT domain, n, bad, m FROM domains JOIN s USING (suffix)
), w2 AS (
  SELECT 1 / coalesce(least(greatest(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN (sum((bad - n * m) ** 2) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)) END, 0.001), 0.5), 0.1) - 1 AS w
  FROM d0 WHERE n > 0
), d AS (SELECT domain, (bad + w * m) / (n + w) AS m FROM d0, w2
), h0 AS (SELECT host, n, bad, m FROM hosts JOIN d USING (domain)
), w3 AS (
  SELECT 1 / coalesce(least(greatest(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN (sum((bad - n * m) ** 2) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)) END, 0.001), 0.5), 0.1) - 1 AS w
  FROM h0 WHERE n > 0
), ab AS (SELECT host, n, bad, bad + w * m AS a, n - bad + w * (1 - m) AS b FROM h0, w3
), reputation AS (
  SELECT host, n, bad, a / (a + b) AS mean, greatest(a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) AS lower FROM ab
), judged AS (
  SELECT page_id, p.host, path, r.n, r.bad, mean, lower,
         CASE WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts p JOIN reputation r ON p.host = r.host
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       n, bad, round(mean, 6) AS posterior_mean, round(lower, 6) AS bad_lower
FROM judged
"""
