"""URL filters by a sort-merge range join, DataFrame operations only.

A host is keyed by its labels in reverse (``org.example.``), so a rule's host and all its
subdomains are one interval of keys, and the intervals of rules are nested or disjoint.  The
bounds of all intervals cut the keys into segments, each with the stack of rules whose interval
is open there.  One sorted sweep over bounds and URLs carries the stack forward to each URL; of
the stack the rules whose path starts the URL's path fit, and the longest rule wins.

The sweep is dealt out by the number of the row, so a host that holds a third of all rows, or a row that
is repeated, is spread over all tasks, whose count follows the input; the bounds, twice the rules' hosts,
are repeated for every task.

Nulls and oddities: a NULL URL, or one without ``://``, has an empty host and path and fits no
rule, so it gets the default verdict; a very long URL is a row like others.  Repeated rows are judged each.
Rules with the same host and path: the one that sorts last by verdict wins.  An empty rule table or page
table gives defaults or no rows.  Other columns of any type pass; those named like the four made are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import columns, lower_ascii, shuffle_partitions
from .tokens import text_bytes

#: Bytes of rows that one task sorts.
TASK_BYTES = 64 << 20

#: Fixed rules of the query: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("verdict", "host", "path"), strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def host_key(host: Column) -> Column:
    """``a.b.c`` becomes ``c.b.a.``; an empty host sorts before all."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def bounds(rules: DataFrame) -> DataFrame:
    """``key, stack``: the rules open from each bound on.

    At a rule's start its host's own and all enclosing hosts' rules are open, at its end the
    enclosing ones: label prefixes, so an equi-join finds them, however many rules there are.
    """
    keyed = rules.select(host_key(F.col("host")).alias("hk"), F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.col("host"), F.col("path"), F.col("verdict")).alias("r"))
    labels = F.filter(F.split("hk", r"\."), lambda x: x != "")
    chain = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.concat(F.array_join(F.slice("labels", F.lit(1), i), "."), F.lit(".")))
    hosts = keyed.select("hk").distinct().withColumn("labels", labels).where(F.size("labels") > 0).withColumn("chain", chain)
    closing = F.concat(F.substr("hk", F.lit(1), F.length("hk") - 1), F.lit("/"))  # "/" follows "."
    both = hosts.select("hk", F.explode(F.array(F.struct(F.col("hk").alias("key"), F.col("chain")), F.struct(closing.alias("key"), F.slice("chain", F.lit(1), F.size("chain") - 1).alias("chain")))).alias("b"))
    opened = both.select("b.key", F.explode_outer("b.chain").alias("hk")).join(keyed, "hk", "left")
    return opened.groupBy("key").agg(F.collect_list("r").alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``pages``."""
    spark = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict")  # replaced by the columns of these names
    host, path = url_parts(F.col(url))
    tasks = max(shuffle_partitions(spark), text_bytes(pages, url) // TASK_BYTES)
    rows = pages.select(F.struct(*columns(pages)).alias("row"), host.alias("host"), path.alias("path"))
    rows = rows.select("row", "host", "path", host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(bounds(rules).schema["stack"].dataType).alias("stack"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tasks)).alias("task"))
    ends = bounds(rules).select(
        F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", F.lit(0).alias("kind"), "stack",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("task"),
    )
    sweep = Window.partitionBy("task").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.unionByName(ends).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    best = F.array_max(F.filter("open", lambda r: F.startswith(F.col("path"), r["path"])))
    out = swept.withColumn("best", best)
    return out.select(
        "row.*", "host", "path",
        F.when(F.col("best").isNotNull(), F.concat("best.host", "best.path")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def pages_query(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"), rule_table(pages.sparkSession)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
SQL = f"""WITH r(verdict, host, path) AS (VALUES {_VALUES}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
w AS (SELECT v.page_id, v.host, v.path, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host) + length(r.path)) AS best
  FROM v LEFT JOIN r ON (v.host = r.host OR ends_with(v.host, '.' || r.host)) AND starts_with(v.path, r.path) GROUP BY 1, 2, 3)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM w"""
