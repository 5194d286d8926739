"""URL filters: fixed host and path rules, then an empirical-Bayes reputation of hosts.

Outcomes of labelled pages are binomial; the rate of a host is shrunk towards its registered domain, that
towards its suffix, and that towards all pages, which begin at one bad page in twenty. How strongly a level is shrunk comes from the spread of its
groups (a beta-binomial fitted by moments). Everything is DataFrame functions; only the aggregates per host
are joined back, so a host that holds a third of all pages is combined before it is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of two labels under which names are registered; any other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "com.br", "com.cn", "co.in", "co.za")
BAD_RATE_LIMIT = 0.35
NORMAL_QUANTILE = 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, all its subdomains, and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: str) -> tuple[Column, Column]:
    """The host in lower case and the path of a url column; both empty for a null or a url without ``://``."""
    cut = f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END"
    return (
        F.translate(F.regexp_extract(F.expr(cut), "^[^/?#]*", 0), UPPER, LOWER),
        F.regexp_extract(F.expr(cut), "^[^/?#]*([^?#]*)", 1),
    )


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix below which it is registered."""
    two = F.substring_index(host, ".", -2)
    is_long = two.isin(*LONG_SUFFIXES)
    return (
        F.when(is_long, F.substring_index(host, ".", -3)).otherwise(two),
        F.when(is_long, two).otherwise(F.substring_index(host, ".", -1)),
    )


def _strength(groups: DataFrame) -> DataFrame:
    """One row ``_s``: how many pages the prior of a level is worth, from the spread of its groups' rates."""
    found = groups.where("_n > 0").agg(
        F.coalesce(F.sum("_k") / F.sum("_n"), F.lit(0.0)).alias("p"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("double").alias("n"),
        F.count("*").cast("double").alias("g"),
        F.coalesce(F.sum(F.col("_n") * F.col("_n")), F.lit(0)).cast("double").alias("nn"),
        F.coalesce(F.sum(F.col("_k") * F.col("_k") / F.col("_n")), F.lit(0.0)).alias("kk"),
    )
    scatter = F.col("kk") - F.col("n") * F.col("p") * F.col("p")
    free = F.col("n") - F.col("nn") / F.col("n") - (F.col("g") - 1)
    rho = (scatter / (F.col("p") * (1 - F.col("p"))) - (F.col("g") - 1)) / free
    known = (F.col("g") > 1) & (F.col("p") > 0) & (F.col("p") < 1) & (free > 0)
    bounded = F.when(known, F.least(F.greatest(rho, F.lit(0.005)), F.lit(0.5))).otherwise(F.lit(0.005))
    return found.select((1 / bounded - 1).alias("_s"))


def _shrunk(groups: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``: the rate of each group after shrinking towards the rate ``_m`` of its parent."""
    strength = _strength(groups)
    joined = groups.join(parent.withColumnRenamed(key, "_p"), F.col(key) == F.col("_p")).drop("_p").join(F.broadcast(strength))  # one row
    return joined.withColumn(name, (F.col("_k") + F.col("_s") * F.col("_m")) / (F.col("_n") + F.col("_s")))


def reputation(outcomes: DataFrame) -> DataFrame:
    """Per host: labelled pages, bad ones, and the posterior bound of the bad rate.

    ``outcomes`` has ``host`` and ``bad`` (1, 0, or null where a page has no label).
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("_n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("_k"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.select("host", domain.alias("_domain"), suffix.alias("_suffix"), "_n", "_k")
    domains = hosts.groupBy("_domain", "_suffix").agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"))
    suffixes = domains.groupBy("_suffix").agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k")).withColumn("_all", F.lit(1))
    everything = suffixes.groupBy("_all").agg(((F.sum("_k") + 0.5) / (F.sum("_n") + 10)).alias("_m"))
    suffixes = _shrunk(suffixes, everything, "_all", "_rate").select("_suffix", F.col("_rate").alias("_m"))
    domains = _shrunk(domains, suffixes, "_suffix", "_rate").select("_domain", F.col("_rate").alias("_m"))
    ranked = _shrunk(hosts, domains, "_domain", "_rate")
    a, total = F.col("_k") + F.col("_s") * F.col("_m"), F.col("_n") + F.col("_s")
    mean = a / total
    deviation = F.sqrt(mean * (1 - mean) / (total + 1))
    return ranked.select(
        F.col("host").alias("_host"), F.col("_n").alias("labelled_pages"), F.col("_k").alias("bad_pages"),
        F.round(mean, 6).alias("bad_rate"), F.round(mean - NORMAL_QUANTILE * deviation, 6).alias("bad_rate_bound"),
    )


def url_verdicts(pages: DataFrame, labels: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per page: host, path, rule and verdict.

    A rule decides where one fits; elsewhere a page is blocked if the lower posterior bound of its host's bad
    rate is above ``BAD_RATE_LIMIT``. ``labels`` has ``doc_id``, ``quality`` and ``toxic``; a page is bad if it is
    toxic or of quality 0. Null urls have an empty host, which is a host like any other; null keys have no label;
    repeated rows are judged one by one; no labels at all leave everything at the same prior.
    """
    read = pages.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").cast("string").alias("_url"))
    host, path = host_and_path("_url")
    read = read.select("_key", host.alias("host"), path.alias("path"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.coalesce("toxic", "quality").isNotNull(), 0)
    marked = labels.select(F.col("doc_id").alias("_doc"), bad.alias("bad")).where("_doc is not null").groupBy("_doc").agg(F.max("bad").alias("bad"))
    known = reputation(read.join(marked, F.col("_key") == F.col("_doc"), "left").select("host", "bad"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_rate_bound") > BAD_RATE_LIMIT, "block").otherwise("allow")
    return read.join(known, F.col("host") == F.col("_host"), "left").select(
        F.col("_key").alias(key), "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        "labelled_pages", "bad_pages", "bad_rate", "bad_rate_bound",
    )


RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def oracle_sql(rules: list[Rule] = RULES) -> str:
    """The same rows in SQL."""
    longest = sorted(rules, key=lambda r: -len(r.name))
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in longest}
    name = " ".join(f"WHEN {fits[r]} THEN '{r.name}'" for r in longest)
    verdict = " ".join(f"WHEN {fits[r]} THEN '{r.verdict}'" for r in longest)
    long = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)

    def labels_from_end(n: int) -> str:
        return f"array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - {n - 1}, 1), len(string_split(host, '.'))), '.')"

    def strength(table: str) -> str:
        return f"""(SELECT 1 / CASE WHEN g > 1 AND p > 0 AND p < 1 AND n - nn / n - (g - 1) > 0
            THEN least(greatest(((kk - n * p * p) / (p * (1 - p)) - (g - 1)) / (n - nn / n - (g - 1)), 0.005), 0.5)
            ELSE 0.005 END - 1
          FROM (SELECT coalesce(sum(k) / sum(n), 0)::DOUBLE p, coalesce(sum(n), 0)::DOUBLE n, count(*)::DOUBLE g,
                coalesce(sum(n * n), 0)::DOUBLE nn, coalesce(sum(k * k / n), 0)::DOUBLE kk FROM {table} WHERE n > 0))"""

    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    read AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    marked AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN coalesce(toxic, quality) IS NOT NULL THEN 0 END) AS bad
        FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM read LEFT JOIN marked ON page_id = doc_id GROUP BY host),
    placed AS (SELECT *, CASE WHEN {labels_from_end(2)} IN ({long}) THEN {labels_from_end(3)} ELSE {labels_from_end(2)} END AS domain,
        CASE WHEN {labels_from_end(2)} IN ({long}) THEN {labels_from_end(2)} ELSE {labels_from_end(1)} END AS suffix FROM hosts),
    domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM placed GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains GROUP BY ALL),
    everything AS (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 10) AS m FROM suffixes),
    suffix_rate AS (SELECT suffix, (k + s * m) / (n + s) AS m FROM suffixes, everything, (SELECT {strength("suffixes")} AS s)),
    domain_rate AS (SELECT domain, (k + s * m) / (n + s) AS m FROM domains JOIN suffix_rate USING (suffix), (SELECT {strength("domains")} AS s)),
    host_rate AS (SELECT host, n, k, n + s AS total, (k + s * m) / (n + s) AS mean FROM placed JOIN domain_rate USING (domain), (SELECT {strength("placed")} AS s)),
    ranked AS (SELECT host, n AS labelled_pages, k AS bad_pages, round(mean, 6) AS bad_rate,
        round(mean - {NORMAL_QUANTILE} * sqrt(mean * (1 - mean) / (total + 1)), 6) AS bad_rate_bound FROM host_rate)
    SELECT page_id, host, path, CASE {name} END AS rule,
        coalesce(CASE {verdict} END, CASE WHEN bad_rate_bound > {BAD_RATE_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
        labelled_pages, bad_pages, bad_rate, bad_rate_bound
    FROM read LEFT JOIN ranked USING (host)"""
