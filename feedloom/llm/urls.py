"""URL filter: host reputation by nested beta-binomial priors, under explicit allow and block rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import ascii_lower


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

# Suffixes of two labels under which names are registered; all others have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "com.br", "co.nz", "co.in", "co.za")

# A host is blocked if even the lower bound of its rate of bad pages is over this.
MAX_BAD = 0.3
#: Standard deviations of the one-sided 95 % bound.
BOUND_SD = 1.645
# Limits of the correlation of outcomes within a level, so that a prior is never without weight or all-powerful.
MIN_RHO, MAX_RHO = 0.001, 0.5
# Rules are tested one by one on every url; more belong in a table.
MAX_RULES = 1000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: tuple[Rule, ...], what: str, host: Column, path: Column) -> Column:
    """Text or verdict of the longest rule that fits; the first given wins among equal lengths."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(rule.text if what == "text" else rule.verdict)).otherwise(found)
    return found


def suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def outcomes(labels: DataFrame) -> DataFrame:
    """One outcome per labelled document: ``page_id`` and ``bad`` (toxic or of poor quality).

    A document labelled more than once is bad if any label says so; labels without either
    value say nothing.
    """
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    said = labels.filter("toxic IS NOT NULL OR quality IS NOT NULL")
    return said.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))


def _concentration(rates: DataFrame) -> float:
    """Weight of a level's prior by the method of moments over ``n``, ``k`` and the prior mean ``mu``.

    Under a beta-binomial the squared error (k - n mu)^2 / n has the mean
    mu (1 - mu) (1 + (n - 1) rho); the prior weighs 1 / rho - 1 pages.
    """
    spread = F.col("mu") * (1 - F.col("mu"))
    error = (F.col("k") - F.col("n") * F.col("mu")) ** 2 / F.col("n")
    sums = rates.filter("n > 0").agg(F.sum(error - spread).alias("over"), F.sum(spread * (F.col("n") - 1)).alias("unit")).first()
    rho = sums["over"] / sums["unit"] if sums["unit"] else MAX_RHO
    rho = min(MAX_RHO, max(MIN_RHO, rho))
    return 1 / rho - 1


def _shrunk(rates: DataFrame, weight: float) -> Column:
    return (F.col("mu") * F.lit(weight) + F.col("k")) / (F.lit(weight) + F.col("n"))


def reputations(hosts: DataFrame) -> DataFrame:
    """Posterior of every host: ``host``, ``bad_rate`` and the lower ``bound`` of the rate.

    ``hosts`` has ``host``, ``n`` labelled and ``k`` bad pages. The rate of all pages is the
    prior mean of the suffixes, a suffix' posterior mean that of its registered domains, a
    domain's that of its hosts; the weight of each prior is fitted on its level. A host
    without labelled pages keeps its domain's rate.
    """
    named = hosts.withColumns({"suffix": suffix(F.col("host")), "domain": registered_domain(F.col("host"))})
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    every = suffixes.agg(F.sum("n"), F.sum("k")).first()
    overall = ((every[1] or 0) + 0.5) / ((every[0] or 0) + 1)
    tops = suffixes.withColumn("mu", F.lit(overall))
    tops = tops.select("suffix", _shrunk(tops, _concentration(tops)).alias("mu"))
    middle = domains.join(tops, "suffix")
    middle = middle.select("domain", "suffix", _shrunk(middle, _concentration(middle)).alias("mu"))
    low = named.join(middle, ["domain", "suffix"])
    weight = _concentration(low)
    rate = _shrunk(low, weight)
    deviation = F.sqrt(rate * (1 - rate) / (F.lit(weight) + F.col("n") + 1))
    return low.select("host", rate.alias("bad_rate"), (rate - BOUND_SD * deviation).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``bad_rate`` of every page.

    The longest fitting rule decides. Without one the page is blocked if the posterior
    bound of its host is over ``max_bad``. A page is labelled if ``labels`` has its page_id
    as doc_id. Null urls and urls without ``://`` share the empty host. Repeated rows are
    judged as often as they come; empty tables give no rows; other columns are ignored.

    Pages are counted by host before they are shuffled. Hosts are joined back to narrow
    rows, with one row per host on the other side, so a hot host can be split.
    """
    host, path = url_parts(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labelled = urls.select("page_id", "host").join(outcomes(labels), "page_id", "left")
    counts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    known = reputations(counts)
    ruled = urls.withColumns(
        {
            "rule": fitting_rule(rules, "text", F.col("host"), F.col("path")),
            "ruling": fitting_rule(rules, "verdict", F.col("host"), F.col("path")),
        }
    )
    own = F.when(F.col("bound") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(known, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruling", own).alias("verdict"),
        F.round("bad_rate", 6).alias("bad_rate"),
    )


def judge_sql() -> str:
    """The same in DuckDB SQL, with the rules written out."""
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    rho = lambda t: f"(SELECT coalesce(least({MAX_RHO}, greatest({MIN_RHO}, sum(power(k - n * mu, 2) / n - mu * (1 - mu)) / nullif(sum(mu * (1 - mu) * (n - 1)), 0))), {MAX_RHO}) FROM {t} WHERE n > 0)"  # noqa: E731,E501
    return f"""
    WITH cut AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), urls AS (
      SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM cut
    ), outcomes AS (
      SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id
    ), parts AS (
      SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, string_split(host, '.') AS l
      FROM urls LEFT JOIN outcomes ON page_id = doc_id GROUP BY host
    ), hosts AS (
      SELECT host, n, k,
             CASE WHEN array_to_string(l[-2:], '.') IN ({two}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
             CASE WHEN array_to_string(l[-2:], '.') IN ({two}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain
      FROM parts
    ), domains AS (
      SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix
    ), tops AS (
      SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM hosts)::DOUBLE AS mu FROM domains GROUP BY suffix
    ), w1 AS (SELECT 1 / {rho("tops")} - 1 AS w), middle AS (
      SELECT d.*, (t.mu * w + t.k) / (w + t.n) AS mu FROM domains d JOIN tops t USING (suffix), w1
    ), w2 AS (SELECT 1 / {rho("middle")} - 1 AS w), low AS (
      SELECT h.*, (m.mu * w + m.k) / (w + m.n) AS mu FROM hosts h JOIN middle m USING (domain, suffix), w2
    ), w3 AS (SELECT 1 / {rho("low")} - 1 AS w), known AS (
      SELECT host, (mu * w + k) / (w + n) AS rate, w + n + 1 AS weight FROM low, w3
    ), rules(rule, ruling, rule_host, rule_path) AS (
      VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
             ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
    ), fits AS (
      SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(ruling, length(rule)) AS ruling
      FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules
        ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path)
      GROUP BY host, path
    )
    SELECT page_id, u.host, u.path, rule,
           coalesce(ruling, CASE WHEN rate - {BOUND_SD} * sqrt(rate * (1 - rate) / weight) > {MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
           round(rate, 6) AS bad_rate
    FROM urls u LEFT JOIN fits f ON u.host = f.host AND u.path = f.path LEFT JOIN known n ON u.host = n.host
    """
