"""URL filter: explicit rules, and for other pages the reputation of their host by empirical Bayes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule): a rule is a host, with all its subdomains, and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A host is blocked when its share of bad pages is above LIMIT by DEVIATIONS standard deviations.
LIMIT, DEVIATIONS = 0.5, 1.64
#: Bounds of the estimated weight of a prior, in pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From after the first "://" up to /, ?, # or the end, A-Z lower-cased; "" without "://"."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; "" without "://"."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*(/?[^?#]*)", 1), F.lit(""))


def _fitting(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, of equally long ones the first by verdict (block last) and text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0], r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _level(counts: DataFrame, key: str, parent: str, priors: DataFrame | None) -> DataFrame:
    """One level of the hierarchy: every key's share of bad pages, drawn towards its parent's.

    The weight of the prior, in pages, comes from how much the shares of a level differ beyond what
    chance explains (method of moments over the level's keys).
    """
    own = counts.groupBy(key, *([parent] if parent else [])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = own.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.when(F.col("n") > 0, 1)).alias("keys"),
                    F.sum(F.when(F.col("n") > 0, F.col("bad") * F.col("bad") / F.col("n"))).alias("squares")).first()
    n, bad, keys, squares = (whole[c] or 0 for c in ("n", "bad", "keys", "squares"))
    mean = (bad + 1) / (n + 2)
    spread = (squares / n - (bad / n) ** 2 if n else 0.0) - mean * (1 - mean) * max(keys - 1, 0) / max(n, 1)
    weight = min(MOST_WEIGHT, max(LEAST_WEIGHT, mean * (1 - mean) / spread - 1)) if spread > 0 else MOST_WEIGHT
    if priors is None:
        own = own.withColumn("prior", F.lit(float(mean)))
    else:
        own = own.join(priors.select(F.col(priors.columns[0]).alias(parent), F.col("mean").alias("prior")), parent)
    a, b = F.col("prior") * weight + F.col("bad"), (1 - F.col("prior")) * weight + F.col("n") - F.col("bad")
    return own.select(key, (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, mean, deviation): posterior share of bad pages of every host in (host, n, bad).

    Shares are drawn from host to registered domain (the last two labels) to suffix (the last label).
    """
    counts = (outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
              .withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2)))
    suffixes = _level(counts, "suffix", "", None)
    domains = _level(counts, "domain", "suffix", suffixes)
    return _level(counts, "host", "domain", domains)


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    The longest rule that fits decides. Pages with a rule are the labelled outcomes from which hosts get
    their reputation; a page without one is blocked if the lower bound of its host's share of bad pages
    is above LIMIT, else allowed.

    A null url, or one without "://", has an empty host and path and is judged as the host "". Repeated
    rows give a row each and count each. Other columns are ignored, whatever their names. Without
    labelled pages all pages are allowed; an empty table gives an empty result.
    """
    place = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = place.withColumn("fit", _fitting(F.col("host"), F.col("path"), rules))
    outcomes = ruled.groupBy("host").agg(F.count("fit").alias("n"), F.count(F.when(F.col("fit.verdict") == "block", 1)).alias("bad"))
    known = host_reputation(outcomes).select("host", F.when(F.col("mean") - DEVIATIONS * F.col("deviation") > LIMIT, "block").otherwise("allow").alias("judged"))
    # pages that a rule decides need no reputation, and do not travel
    other = ruled.where("fit is null").join(known, "host", "left")
    return (ruled.where("fit is not null").select("page_id", "host", "path", "fit.rule", "fit.verdict")
            .union(other.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("judged", F.lit("allow")).alias("verdict"))))


def _sql_level(name: str, key: str, parent: str, parent_table: str) -> str:
    prior = f"JOIN {parent_table} p ON o.{parent} = p.key" if parent else ""
    return f"""
{name}_own AS (SELECT {key}{', ' + parent if parent else ''}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM counts GROUP BY ALL),
{name}_all AS (SELECT sum(n) AS n, (sum(bad) + 1) / (sum(n) + 2) AS m,
    CASE WHEN sum(n) > 0 THEN sum(CASE WHEN n > 0 THEN bad * bad / n END) / sum(n) - (sum(bad) / sum(n)) ^ 2 ELSE 0 END AS v, greatest(count(*) FILTER (WHERE n > 0) - 1, 0) AS k FROM {name}_own),
{name}_w AS (SELECT m, CASE WHEN v - m * (1 - m) * k / greatest(n, 1) > 0
    THEN least({MOST_WEIGHT}, greatest({LEAST_WEIGHT}, m * (1 - m) / (v - m * (1 - m) * k / greatest(n, 1)) - 1)) ELSE {MOST_WEIGHT} END AS w FROM {name}_all),
{name} AS (SELECT o.{key} AS key, ({'p.mean' if parent else 'm'} * w + o.bad) / (w + o.n) AS mean, w + o.n AS s FROM {name}_own o {prior}, {name}_w)"""


def _sql_case(column: int) -> str:
    whens = []
    for verdict, rule in sorted(RULES, key=lambda r: (len(r[1]), r[0], r[1]), reverse=True):
        name, slash, start = rule.partition("/")
        whens.append(f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND path LIKE '{slash + start}%' THEN '{(rule, verdict)[column]}'")
    return f"CASE {' '.join(whens)} END"


#: The rows of ``op4_url_reputation`` in DuckDB SQL.
URL_SQL = rf"""
WITH place AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/?[^?#]*)', 1) AS path
    FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), ruled AS (SELECT *, {_sql_case(0)} AS rule, {_sql_case(1)} AS fit FROM place),
counts AS (
    SELECT host, string_split(host, '.')[-1] AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain, count(fit) AS n, count(*) FILTER (WHERE fit = 'block') AS bad FROM ruled GROUP BY ALL
), {_sql_level('suffixes', 'suffix', '', '')}, {_sql_level('domains', 'domain', 'suffix', 'suffixes')}, {_sql_level('hosts', 'host', 'domain', 'domains')}
SELECT page_id, host, path, rule, coalesce(fit, CASE WHEN mean - {DEVIATIONS} * sqrt(mean * (1 - mean) / (s + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN hosts ON ruled.host = hosts.key
"""
