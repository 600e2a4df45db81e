"""URL verdicts by host-suffix and path-prefix rules (DataFrame functions only).

A rule is a host and a path, such as `example.net/en/`; it fits its host and all subdomains if the URL's path starts
with its path, and the longest rule that fits wins. Each distinct (host, path) is expanded into expressions: its
host suffixes joined with its path prefixes that end in a slash. Expressions and rules meet by the first four bytes
of their SHA-256; then the full digest is confirmed, the rest of the rule's path is compared, and the longest rule
is taken. Only shapes (labels of the host, slashes of the path) that some rule has are expanded, so a URL costs as
many rows as there are shapes, however long it is.

Defined results: an empty table gives no rows; a URL of any length is read whole; a null URL or one without `://` has an empty host and path, and no rule; without a rule the verdict
is the default; between rules of one length the longer host, then `block`, then the smaller text wins; null rules and
verdicts are ignored; repeated pages are judged each; extra columns of `pages` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules up to this many are sent to every executor (about 100 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path. Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.regexp_extract("rest", "^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(rest, length(host) + 1)"), "^[^?#]*", 0)
    rows = pages.withColumn("rest", F.coalesce(rest, F.lit(""))).withColumn("host", host).withColumn("path", path)
    return rows.withColumn("host", F.translate("host", UPPER, LOWER)).drop("rest")


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule, verdict) with what a join needs: host, path, the path up to its last slash, shape and digest."""
    r = rules.where("rule is not null and verdict is not null").select("rule", "verdict").distinct()
    r = r.where("rule like '%/%'").withColumn("rule_host", F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER))
    r = r.withColumn("rule_path", F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"))
    r = r.withColumn("slashes", F.expr("length(rule_path) - length(replace(rule_path, '/', ''))")).withColumn("labels", F.size(F.split("rule_host", "\\.")))
    r = r.withColumn("digest", F.sha2(F.expr("concat(rule_host, substring_index(rule_path, '/', slashes), '/')"), 256))
    return r.withColumn("short", F.substring("digest", 1, 8))


def judge(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str]], default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict of every row of pages; rules: (rule, verdict) rows."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules])).alias("r")).select("r.*") if rules else spark.range(0).selectExpr("'' as rule", "'' as verdict")
    ready = rule_table(rules)
    n = ready.count()
    shapes = [tuple(x) for x in ready.select("labels", "slashes").distinct().collect()]  # at most a few labels by a few slashes
    rows = parsed(pages.select("page_id", F.col("url").cast("string").alias("url")))
    if not shapes:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    distinct = rows.where("host <> '' and path <> ''").select("host", "path").distinct()
    shape = F.explode(F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("slashes")) for a, b in sorted(shapes)]))
    grown = distinct.withColumn("shape", shape).select("host", "path", "shape.*")
    grown = grown.where("size(split(host, '\\\\.')) >= labels and length(path) - length(replace(path, '/', '')) >= slashes")
    grown = grown.withColumn("digest", F.sha2(F.expr("concat(substring_index(host, '.', -labels), substring_index(path, '/', slashes), '/')"), 256))
    grown = grown.select("host", "path", "digest", F.substring("digest", 1, 8).alias("short"))
    side = ready.select("short", F.col("digest").alias("rule_digest"), "rule", "rule_host", "rule_path", "verdict")
    met = grown.join(F.broadcast(side) if n <= BROADCAST_RULES else side, "short")
    fits = met.where("digest = rule_digest and (host = rule_host or endswith(host, concat('.', rule_host))) and startswith(path, rule_path)")
    rank = F.struct(F.length("rule").alias("a"), F.length("rule_host").alias("b"), (F.col("verdict") == "block").alias("c"))
    best = fits.withColumn("rank", rank).groupBy("host", "path").agg(F.max("rank").alias("top"), F.collect_set(F.struct("rank", "rule", "verdict")).alias("all"))
    one = F.expr("array_min(transform(filter(all, x -> x.rank = top), x -> struct(x.rule as rule, x.verdict as verdict)))")
    best = best.select("host", "path", one.alias("one"))
    # a null key meets nothing and is dealt out at random, so rows that no rule can fit don't gather in one task
    some = F.when((F.col("host") != "") & (F.col("path") != ""), F.col("host")).alias("some")
    out = rows.select("*", some).join(best.withColumnsRenamed({"host": "best_host", "path": "best_path"}), (F.col("some") == F.col("best_host")) & (F.col("path") == F.col("best_path")), "left")
    return out.select("page_id", "url", "host", "path", F.col("one.rule").alias("rule"), F.coalesce("one.verdict", F.lit(default)).alias("verdict"))
