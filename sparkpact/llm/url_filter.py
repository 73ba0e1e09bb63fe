"""URL filter: host-suffix and path-prefix expressions, joined to the rules on short hash prefixes.

Each distinct (host, path) expands into the pairs of a host suffix (whole labels) and a directory prefix of its path. An
expression and a rule meet on the first eight hex digits of their SHA-256; the whole digest and the rule's exact path
confirm the match, and the longest rule wins (ties: block before allow, then the smaller text). All of it is built-in
SQL functions.

Null or malformed urls have an empty host and path, match no rule and get the default verdict. Repeated rows are judged
alike, an empty table gives an empty result, and columns besides the id and the url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Rules up to this count are broadcast (at most about 60 MB at 2 kB a rule); more are joined by a salted shuffle.
BROADCAST_RULES = 30_000
RULE_BYTES = 2_000
SALTS = 16


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    return F.when(F.locate("://", url) > 0, lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _directory(path: Column) -> Column:
    """The path up to and with its last slash; every text that starts with the path starts with this."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def _up_to(text: Column, separator: str, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(separator), count)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _digest(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), directory), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules(host, path, action) with digests. Rows with a null host, path or action are no rules."""
    r = rules.select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.lower("action").alias("action"))
    r = r.dropna().distinct()
    directory = _directory(F.col("rule_path"))
    return r.select("*", F.concat("rule_host", "rule_path").alias("rule"), _digest(F.col("rule_host"), directory).alias("rule_digest"), F.size(F.split("rule_host", r"\.", -1)).alias("labels"), _slashes(directory).alias("depth"))


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict.

    The rules' label counts and path depths bound how far a url is expanded, so a url of many labels costs no more than
    the rules ask for.
    """
    r = prepare_rules(rules)
    # one row of counts: the bounds of the expansion and whether the rules are small enough to broadcast
    n, labels, depth, width = r.agg(F.count("*"), F.max("labels"), F.max("depth"), F.max(F.octet_length("rule"))).first()
    url = F.col(f"`{url_col}`")
    pages = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    if not n:
        return pages.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: _up_to(F.col("host"), ".", -k))
    cuts = F.sequence(F.lit(0), F.least(_slashes(F.col("path")), F.lit(depth)))
    prefixes = F.transform(cuts, lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(_up_to(F.col("path"), "/", k), F.lit("/"))))
    keys = (
        pages.select("host", "path").distinct()
        .withColumn("host_suffix", F.explode(suffixes))
        .withColumn("directory", F.explode(prefixes))
        .withColumn("digest", _digest(F.col("host_suffix"), F.col("directory")))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    r = r.withColumn("short", F.substring("rule_digest", 1, 8))
    if n <= BROADCAST_RULES and width <= RULE_BYTES:
        met = keys.join(F.broadcast(r), "short")
    else:  # a rule for a whole top-level domain meets most urls: spread its key over SALTS partitions
        salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS))
        met = keys.withColumn("salt", salt).join(r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))), ["short", "salt"])
    met = met.where((F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path")))
    rank = F.struct(F.length("rule").alias("n"), (F.col("action") == "block").cast("int").alias("b"), F.col("rule"), F.col("action"))
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    judged = pages.join(best, ["host", "path"], "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

ORACLE = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), u AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), r(h, t, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT u.page_id, u.host, u.path, r.h || r.t AS rule, action,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.t) DESC, action DESC, r.h || r.t DESC) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.t)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
