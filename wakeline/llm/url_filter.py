"""URL allow/block filter by hashed host-suffix and path-prefix expressions.

Every distinct (host, path) is expanded into ``host suffix + path prefix``
expressions; a short prefix of each expression's SHA-256 is equi-joined with
the rules, full digests confirm the match and the longest rule wins.

Only DataFrame functions are used.  The expansion covers just those host
depths and path lengths that some rule has; both lists are read from the rules
and are replaced by *all* depths or lengths when they would be longer than
``SHAPES``, so no rule is ever missed.

Defined results: a null url, or one without ``://``, has empty host and path;
repeated rows are judged alike, each on its own row; an empty rule table gives
``default`` everywhere; a rule listed with two actions blocks.  Among fitting
rules of equal length the one with the longer host wins, then ``block``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPES = 256  # most distinct rule depths or path lengths that are expanded one by one
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """Host of a url, ASCII lower case; empty if there is none."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of a url, up to ``?`` or ``#``; empty if there is none."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _depth(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) with their digest; nulls in host, path or action make no rule."""
    rule = F.concat("host", "path")
    return (
        rules.select("host", "path", "action")
        .dropna()
        .select(
            rule.alias("rule"),
            "action",
            F.length("host").alias("host_len"),
            _depth(F.col("host")).alias("depth"),
            F.length("path").alias("path_len"),
            F.sha2(rule, 256).alias("digest"),
        )
        .withColumn("short", F.substring("digest", 1, 8))
    )


def _shapes(table: DataFrame, col: str) -> list[int] | None:
    """Distinct values of a shape column, or None when there are more than SHAPES."""
    found = [r[0] for r in table.select(col).distinct().limit(SHAPES + 1).collect()]
    return sorted(found) if len(found) <= SHAPES else None


def _numbers(values: list[int] | None, most: Column, least: int) -> Column:
    """The shapes that are possible up to ``most``."""
    if values is None:
        return F.sequence(F.lit(least), F.greatest(most, F.lit(least)))
    return F.filter(F.lit(values).cast("array<int>"), lambda n: n <= most)


def match_rules(hosts_paths: DataFrame, rules: DataFrame) -> DataFrame:
    """One row (host, path, rule, action) per distinct (host, path) that some rule fits."""
    table = rule_table(rules)
    depths, lengths = _shapes(table, "depth"), _shapes(table, "path_len")
    labels = F.split("host", r"\.")
    expanded = (
        hosts_paths.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(_numbers(depths, _depth(F.col("host")), 1)).alias("depth"))
        .select("host", "path", F.array_join(F.slice(labels, -F.col("depth"), F.col("depth")), ".").alias("suffix"))
        .select("host", "path", "suffix", F.explode(_numbers(lengths, F.length("path"), 0)).alias("n"))
        .select("host", "path", F.sha2(F.concat("suffix", F.substr("path", F.lit(1), F.col("n"))), 256).alias("full"))
        .withColumn("short", F.substring("full", 1, 8))
    )
    return (
        expanded.join(table, "short")
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("len"), "host_len", "action", "rule")).alias("best"))
        .select("host", "path", "best.rule", "best.action")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row: ``id_col``, host, path, rule (null if none fits), verdict."""
    url = F.col(url_col)
    judged = pages.select(F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"))
    best = match_rules(judged, rules)
    return judged.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )


#: The rules of the registered query.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url; odd rows as the module says."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP6_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), judged AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(rhost, rpath, action) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM judged) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM judged LEFT JOIN best USING (host, path)
"""
