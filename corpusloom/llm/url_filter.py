"""URL rules by host and path, joined as a sorted sweep over nested intervals; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._common import ascii_lower, size_in_bytes, table

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: What no rule fits.
DEFAULT_VERDICT = "allow"
#: After every character of a host; ends the interval of its subdomains.
_HIGH = "\U0010ffff"
#: Sweeps run side by side, each over its share of the hosts and all rules: this many at least and at most, else by size.
SWEEPS, MOST_SWEEPS, SWEEP_BYTES = 64, 4096, 256 << 20


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://, else the empty text."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """The labels from last to first, each with a dot behind it: a host's key begins those of its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): the rules in force from each interval end on, up to the next.

    Intervals of host keys are nested or apart. Where one starts, the rules of the host and of all it
    lies in are on the stack; where it ends, those of its own host are off again.
    """
    by_host = rules.groupBy("host").agg(F.collect_set(F.struct("rule_host", "rule_path", "verdict")).alias("own"))
    labels = F.split("host", r"\.")
    outer = by_host.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("above"))
    owned = by_host.select(F.col("host").alias("above"), "own")
    stacks = outer.join(owned, "above").groupBy("host").agg(F.flatten(F.collect_list("own")).alias("on"), F.flatten(F.collect_list(F.when(F.col("above") != F.col("host"), F.col("own")))).alias("off"))
    key = host_key(F.col("host"))
    return stacks.select(key.alias("key"), F.col("on").alias("stack")).union(stacks.select(F.concat(key, F.lit(_HIGH)).alias("key"), F.col("off").alias("stack")))


def judge(pages: DataFrame, rules: DataFrame, *, default: str = DEFAULT_VERDICT, sweeps: int | None = None) -> DataFrame:
    """The verdict on each url of ``pages`` (page_id, url) by ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with the rule's. Of several the
    longest host and path together win, then the longer host; if such rules contradict each other,
    block. Returns page_id, host, path, rule (host followed by path, or null), verdict.

    Distinct hosts are gathered first, so a host of a third of all pages is one row. Hosts and interval
    ends are then dealt to ``sweeps`` parts; in each one pass in key order carries the stack of rules
    in force. A page gets its host's stack by an equi-join, which Spark can split if a host is hot, and
    takes the longest whose path fits. Nothing is broadcast by hint, nothing runs in Python.

    Edge cases: a null url or one without :// has an empty host and path and gets the default. Ports and
    user names belong to the host as written. Repeated rows and rules change nothing. Rules with a null
    host, path or verdict are left out.
    """
    sweeps = sweeps or int(min(MOST_SWEEPS, max(SWEEPS, size_in_bytes(pages) // SWEEP_BYTES)))
    urls = pages.select("page_id", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"))
    clean = rules.where("host is not null and path is not null and verdict is not null")
    clean = clean.select(ascii_lower(F.col("host")).alias("host"), ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    hosts = urls.select("host").distinct().select(F.pmod(F.xxhash64("host"), F.lit(sweeps)).alias("sweep"), host_key(F.col("host")).alias("key"), "host", F.lit(None).cast("array<struct<rule_host:string,rule_path:string,verdict:string>>").alias("stack"))
    ends = boundaries(clean).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sweeps - 1).cast("long"))).alias("sweep"), "key", F.lit(None).cast("string").alias("host"), "stack")
    swept = hosts.unionByName(ends)
    order = Window.partitionBy("sweep").orderBy(F.col("key"), F.col("host").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    stacks = swept.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).where("host is not null").where(F.size("stack") > 0).select("host", "stack")

    judged = urls.join(stacks, "host", "left")
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    ranked = F.transform(fits, lambda r: F.struct((F.length(r["rule_host"]) + F.length(r["rule_path"])).alias("n"), F.length(r["rule_host"]).alias("h"), r["verdict"].alias("verdict"), F.concat(r["rule_host"], r["rule_path"]).alias("rule")))
    best = F.array_max(ranked)
    return judged.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([*rules], "host string, path string, verdict string")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


OP2_SQL = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY h IS NULL, length(h) + length(p) DESC, length(h) DESC) AS n
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT_VERDICT}') AS verdict FROM fit WHERE n = 1
"""
