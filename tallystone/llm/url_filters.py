"""URL filters: allow and block rules found by their rarest literal token.

Every rule names a host (subdomains included) and the start of a path. Its literal tokens are the labels of its host and
the whole segments of its path; the rule is filed under the one of them that the fewest URLs hold. A URL's own tokens
fetch candidate rules, and only those run their regular expression. DataFrame functions only.

Defined cases: a null URL, or one without "://", has an empty host and path and takes the default verdict unless a rule
without literal tokens fits; empty host labels are no tokens; repeated rows each get their own result row; an empty table gives an
empty result; columns beside the id and the URL are ignored; of several rules that fit, the longest wins, then the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import ascii_lower, materialize, small_enough

#: Up to so many rules travel as one row to every task; more are joined by token.
MAX_BROADCAST_RULES = 10_000

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def literal_tokens(host: Column, path: Column) -> Column:
    """Host labels and the path segments that a slash ends; '' stands for 'any URL'."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split(path, "/")
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    segments = F.transform(F.filter(inner, lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def _indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Rules with the token they are filed under: of their own tokens, the one in the fewest URLs."""
    own = rules.select("rule", F.explode_outer("tokens").alias("token"))
    wanted = own.select("token").where("token is not null").distinct()
    seen = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(wanted) if small_enough(wanted, MAX_BROADCAST_RULES) else wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = own.join(seen, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    return rules.join(rarest, "rule").select("rule", "action", "pattern", F.coalesce("best.token", F.lit("")).alias("token"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """id, host, path, rule and verdict of every row of pages. rules: host, path (with its leading slash), action."""
    rules = (
        rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .withColumn("rule", F.concat("host", "path"))
        .groupBy("rule", "host", "path").agg(F.min("action").alias("action"))
        .withColumn("tokens", literal_tokens(F.col("host"), F.col("path")))
        .withColumn("pattern", F.concat(F.lit(r"(?s)^(?:[^/]*\.)?\Q"), F.replace(F.col("rule"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    )
    urls = pages.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = urls.withColumn("tokens", F.concat(literal_tokens(F.col("host"), F.col("path")), F.array(F.lit(""))))
    index = _indexed(rules, urls)
    fits = lambda r: F.concat("host", "path").rlike(r["pattern"]) if isinstance(r["pattern"], str) else F.rlike(F.concat("host", "path"), r["pattern"])
    best = lambda r: F.struct((-F.length(r["rule"])).alias("longest"), r["rule"].alias("rule"), r["action"].alias("action"))
    if small_enough(rules, max_broadcast_rules):
        filed = index.groupBy("token").agg(F.collect_list(F.struct("rule", "action", "pattern")).alias("filed"))
        one = filed.agg(F.map_from_entries(F.collect_list(F.struct("token", "filed"))).alias("index"))  # one row, of the counted rules
        found = urls.join(F.broadcast(one), how="left")
        fetched = F.flatten(F.filter(F.transform("tokens", lambda t: F.try_element_at("index", t)), lambda x: x.isNotNull()))
        found = found.withColumn("won", F.array_min(F.transform(F.filter(fetched, fits), best)))
    else:
        urls = materialize(urls.withColumn("_row", F.monotonically_increasing_id()), "urls")
        asked = urls.select("_row", "host", "path", F.explode("tokens").alias("token")).join(index, "token")
        r = {c: F.col(c) for c in ("rule", "action", "pattern")}
        won = asked.where(fits(r)).groupBy("_row").agg(F.min(best(r)).alias("won"))
        found = urls.join(won, "_row", "left")
    return found.select(F.col("_id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))


#: The rules that the registered query judges by.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def query(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = r"""
WITH rules(host, path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS rid,
  translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT u.rid, r.host || r.path AS rule, r.action,
  row_number() OVER (PARTITION BY u.rid ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS k
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM u LEFT JOIN m ON u.rid = m.rid AND m.k = 1
"""
