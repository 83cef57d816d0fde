"""URL filtering by expansion into host-suffix and path-prefix expressions.

A rule is a host with a path prefix; it fits its host and all subdomains where the URL's path starts with the rule's path. Each URL is expanded into expressions ``host suffix`` + ``path prefix`` of the shapes that occur among the rules (numbers of host labels, lengths of paths), so every rule that fits is among them. Expressions and rules are equi-joined on the first bytes of their digests; the full digests and then the host and path themselves confirm, and the longest rule wins (ties: the longer host, then block). Only DataFrame functions are used; Catalyst broadcasts the rules where their size allows it.

Matching is done once for each distinct (host, path), so a URL that fills a third of the table is expanded once.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end. Null or no ``://``: both empty. URLs that no rule fits get the method's verdict: block without a host, else ``default``. Repeated rows give repeated output rows, empty tables none; without rules every URL gets the method's verdict. Rules without a verdict, a host or a path are left out. Columns other than those named are not looked at.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

#: The rules of the query: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules))
    return spark.range(1).select(F.inline(rows))


def _host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``; ``rules``: verdict, host, path."""
    host, path = _host_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).where("verdict is not null and rule_host <> '' and rule_path is not null")
    known = known.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    labels = F.size(F.split("rule_host", r"\."))
    shapes = sorted({(r.labels, r.length) for r in known.select(labels.alias("labels"), F.length("rule_path").alias("length")).distinct().collect()})
    shape = F.from_json(F.lit(json.dumps([{"labels": n, "length": k} for n, k in shapes])), "array<struct<labels: int, length: int>>")  # one literal, so that the plan is as small for many rules as for few
    fitting = F.filter(shape, lambda s: (F.size(F.split("host", r"\.")) >= s["labels"]) & (F.length("path") >= s["length"]))
    spread = F.explode(F.transform(fitting, lambda s: F.struct(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]).alias("suffix"), F.substring(F.col("path"), F.lit(1), s["length"]).alias("part"))))
    expressions = urls.where("host <> ''").select("host", "path").distinct().select("host", "path", spread.alias("x")).select("host", "path", _digest(F.col("x.suffix"), F.col("x.part")).alias("seen"))
    met = expressions.withColumn("prefix", F.substring("seen", 1, PREFIX_HEX)).join(known, "prefix")
    met = met.where((F.col("seen") == F.col("digest")) & ((F.col("host") == F.col("rule_host")) | F.endswith("host", F.concat(F.lit("."), F.col("rule_host")))) & F.startswith("path", F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(rule), F.length("rule_host"), (F.col("verdict") == "block").cast("int"), rule)
    best = written(met.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), "verdict"), order).alias("best")))  # so that both sides of the last join are plain exchanges, which AQE can split where one URL, or those without a host, fill a partition
    verdict = F.coalesce("best.verdict", F.when(F.col("host") == "", F.lit("block")).otherwise(F.lit(default)))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages"), rules_table(spark))


ORACLE_SQL = """
WITH rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest
), urls AS (
  SELECT row_number() OVER (ORDER BY page_id, h, path) AS id, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut
), met AS (
  SELECT u.*, k.verdict, k.rhost || k.rpath AS rule,
    row_number() OVER (PARTITION BY id ORDER BY length(k.rhost || k.rpath) DESC, length(k.rhost) DESC, (k.verdict = 'block') DESC) AS n
  FROM urls u LEFT JOIN rules k ON (u.host = k.rhost OR ends_with(u.host, '.' || k.rhost)) AND starts_with(u.path, k.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM met WHERE n = 1
"""
