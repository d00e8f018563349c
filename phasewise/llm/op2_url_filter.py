"""URL filter: host-suffix and path-prefix expressions joined with rules by hash prefix.

Every distinct address is expanded into host suffixes (at label borders) and path prefixes,
of just the label counts and prefix lengths that rules have, so that no rule can be missed.
Expressions meet rules in an equi-join on the first four bytes of their SHA-256; the full
digest then confirms, and the longest rule wins (a tie: the longer host, then block).

Only distinct addresses are expanded, so a host or address with a third of all rows costs
one expansion.  The rules are a DataFrame: Spark broadcasts them if its size estimate allows
and shuffles otherwise.  A url that is null or has no ``://`` has an empty host and path and
fits no rule; so does an empty path with a rule whose path is ``/``.  Urls without a rule get
the default verdict.  Repeated rows, null ids and other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.llm.common import column

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8  # hexadecimal: four bytes
#: Label counts and path lengths are read from the rules to the driver; more kinds than this raise.
MAX_SHAPES = 10_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url",
          default: str = "allow") -> DataFrame:
    """id, host, path, rule (host and path of the winner, else null) and verdict of each row.

    rules: host, path (starts with ``/`` or is empty) and verdict; null fields and hosts in
    upper case fit nothing; of equal rules block wins.
    """
    host, path = host_and_path(column(url_column))
    urls = pages.select(column(id_column).alias(id_column), host.alias("host"), path.alias("path"))
    known = (rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    shapes = (known.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"))
              .distinct().limit(MAX_SHAPES + 1).collect())
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"rules of more than {MAX_SHAPES} shapes")
    keyed = known.select(
        F.substring(digest(F.col("host"), F.col("path")), 1, PREFIX_DIGITS).alias("key"),
        digest(F.col("host"), F.col("path")).alias("full"), F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_chars"), "verdict")

    labels = F.split("host", r"\.")
    candidates = [
        F.when((F.size(labels) >= n) & (F.length("path") >= m), digest(
            F.substring_index("host", ".", -n), F.substring("path", 1, m) if m else F.lit("")))
        for n, m in sorted((r["labels"], r["chars"]) for r in shapes)
    ]
    addresses = urls.where("host <> ''").select("host", "path").distinct()
    expressions = addresses.select(
        "host", "path", F.explode(F.array_compact(F.array(*candidates)) if candidates
                                  else F.array().cast("array<string>")).alias("digest"))
    winners = (
        expressions.withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
        .join(keyed, "key").where("digest = full")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("chars"), "host_chars", "verdict", "rule")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return (urls.join(winners, ["host", "path"], "left")
            .select(column(id_column), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


SQL = """
WITH split AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT p.page_id, p.host, p.path,
       arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule,
       coalesce(arg_max(r.verdict, length(r.rule_host || r.rule_path)), 'allow') AS verdict
FROM parts p LEFT JOIN rules r
  ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
GROUP BY p.page_id, p.host, p.path
"""
