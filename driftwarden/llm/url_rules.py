"""URL filters by a sort-merge range join.

A host is written backwards by labels (`example.net` -> `net.example.`), so a rule's host covers one interval of
keys: those that begin with its key.  Rules and the distinct hosts of the pages are sorted together and swept
once.  The stack of rules that are open at a key is kept by depth: rules of one depth do not overlap, so
the last one before a key is the only one that may cover it, and the innermost slots stand for the
top of the stack.  What a range partition needs from those before it is one row per partition.  Each page then gets
the open rules of its host, and the longest whose path its own path begins with decides.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwarden.session import stage_table

# fixed values: the rules of the registered query
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, LETTERS, LETTERS.lower())


def host_key(host: Column) -> Column:
    """Labels backwards, each ended by a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path; both empty for a null url or one without `://`."""
    url = F.col("url").cast("string")
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract("rest", r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract("rest", r"^([^/?#]*)([^?#]*)", 2)
    return pages.select("page_id", rest.alias("rest")).select("page_id", lower_ascii(raw).alias("host"), path.alias("path"))


def open_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, open: the rules (path, rule, verdict) of every host that some rule's host covers.

    `hosts` has distinct hosts, `rules` verdict, host and path; the rules of one host are kept together.
    """
    named = rules.dropna(subset=["verdict", "host", "path"]).withColumn("host", lower_ascii(F.col("host"))).distinct()
    grouped = (named.withColumn("key", host_key(F.col("host"))).groupBy("key")
               .agg(F.collect_list(F.struct("path", F.concat("host", "path").alias("rule"), "verdict")).alias("rules"))
               .filter("key <> ''").withColumn("depth", F.length("key") - F.length(F.replace(F.col("key"), F.lit("."), F.lit("")))))
    depths = sorted(r[0] for r in grouped.select("depth").distinct().collect())      # as many as hosts have labels
    if not depths:
        return hosts.limit(0).select("host", F.array().cast("array<struct<path: string, rule: string, verdict: string>>").alias("open"))
    rows = (hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host")
            .unionByName(grouped.withColumn("kind", F.lit(0)), allowMissingColumns=True))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = stage_table(rows.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "sweep")

    def slot(depth):
        return F.when((F.col("kind") == 0) & (F.col("depth") == depth), F.struct("key", "rules"))

    so_far = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # one row per partition
    carried = swept.groupBy("part").agg(*[F.max_by(slot(d), F.when(slot(d).isNotNull(), F.col("key"))).alias(f"c{d}") for d in depths])
    carried = carried.select("part", *[F.last(f"c{d}", True).over(earlier).alias(f"c{d}") for d in depths])
    stacked = (swept.select("*", *[F.last(slot(d), True).over(so_far).alias(f"s{d}") for d in depths])
               .filter("kind = 1").join(carried, "part"))
    stack = F.array(*[F.coalesce(f"s{d}", f"c{d}") for d in depths])
    covering = F.filter(stack, lambda s: s.isNotNull() & F.startswith(F.col("key"), s["key"]))
    return stacked.select("host", F.flatten(F.transform(covering, lambda s: s["rules"])).alias("open")).filter(F.size("open") > 0)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict per row of `pages` (page_id, url; other columns are ignored).

    The longest fitting rule (host and path together) decides; of equally long ones the one whose
    rule is later by code point, `block` before `allow` for the same rule twice.  Without a rule the rule is
    null and the verdict `default`.  Null ids stay, repeated rows are each judged, rules with a null part
    are passed over; an empty table gives no rows.
    """
    parts = url_parts(pages)
    opened = open_rules(parts.select("host").filter("host <> ''").distinct(), rules)
    joined = parts.join(opened, "host", "left")
    fitting = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(
        F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return joined.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def given_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(RULES), "verdict string, host string, path string")
