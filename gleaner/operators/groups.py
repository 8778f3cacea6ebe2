"""Grouping operators: exact duplicates, collisions, lattices, first and last of a kind, capped lists, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.scratch import materialize


def duplicate_groups(df: DataFrame, key: str, content: str, size: Column | None = None) -> DataFrame:
    """One row for each content that more than one row holds: its digest, least key, the other keys, count and wasted bytes.

    The digest travels, never the content, and a map-side partial aggregate collects the keys. Null and empty
    contents belong to no group.
    """
    size = F.octet_length(content) if size is None else size
    hashed = df.where(F.col(content).isNotNull()).select(F.col(key).alias("k"), F.sha2(F.col(content).cast("binary"), 256).alias("sha"), size.cast("long").alias("size")).where("size > 0")
    g = hashed.groupBy("sha").agg(F.sort_array(F.collect_list("k")).alias("keys"), F.min("size").alias("size"), F.count("*").alias("count")).where("count > 1")
    return g.select("sha", F.element_at("keys", 1).alias("path"), F.slice("keys", 2, F.greatest(F.size("keys") - 1, F.lit(0))).alias("related"), "count", (F.col("size") * (F.col("count") - 1)).alias("wasted"))


def case_collisions(df: DataFrame, name: str) -> DataFrame:
    """Groups of different names that lower-casing makes equal: folded name, least name, the others.

    Least and greatest name tell which groups hold more than one, by partial aggregation; only such are collected.
    """
    names = df.select(F.col(name).alias("n")).where("n is not null").distinct()
    several = names.groupBy(F.lower("n").alias("folded")).agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo <> hi").select("folded")
    g = names.withColumn("folded", F.lower("n")).join(several, "folded").groupBy("folded").agg(F.sort_array(F.collect_list("n")).alias("all"))
    return g.select("folded", F.element_at("all", 1).alias("path"), F.slice("all", 2, F.size("all") - 1).alias("related"))


#: Usage: a later state in this list overrides an earlier one.
UNUSED, POSSIBLY, USED = 0, 1, 2


def merge_usage(marks: DataFrame, key: list[str], status: str = "status", occurrence: str | None = None, order: str = "ord") -> DataFrame:
    """The strongest status of each key and, if asked, its occurrences in order."""
    aggs = [F.max(status).alias("status")]
    if occurrence:
        aggs.append(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(occurrence).alias("x")))), lambda s: s["x"]).alias("occurrences"))
    return marks.groupBy(*key).agg(*aggs)


def lookup_usage(items: DataFrame, usage: DataFrame, key: list[str]) -> DataFrame:
    """Every item with its status; what nothing marks is unused."""
    return items.join(usage, key, "left").withColumn("status", F.coalesce("status", F.lit(UNUSED)))


def propagate_variants(items: DataFrame, key: str = "path", parent: str = "variant_of", status: str = "status") -> DataFrame:
    """Variants and their parent share the strongest status among them."""
    family = F.coalesce(parent, key)
    best = items.groupBy(family.alias("_family")).agg(F.max(status).alias("_best"))
    return items.withColumn("_family", family).join(best, "_family").withColumn(status, F.col("_best")).drop("_family", "_best")


def first_wins(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def last_wins(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The value of each key's last row, by partial aggregation: no sort, and a hot key is combined map-side."""
    return df.groupBy(*key).agg(F.max_by(value, order).alias(value))


def capped(df: DataFrame, key: list[str], order: list[Column | str], most: int) -> DataFrame:
    """At most ``most`` rows of each key; Spark filters before the shuffle, so a hot key sends ``most`` rows a task."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most).drop("_i")


def counters(df: DataFrame, cases: dict[str, Column], sums: dict[str, Column] | None = None, by: list[str] = ()) -> DataFrame:
    """One pass over ``df`` for any number of conditional counts and sums."""
    aggs = [F.count_if(c).alias(k) for k, c in cases.items()] + [F.sum(c).alias(k) for k, c in (sums or {}).items()]
    return (df.groupBy(*by) if by else df).agg(*aggs)


def numbered(in_order: DataFrame, name: str) -> DataFrame:
    """A sorted table with each row's place, from 1: rows are numbered within their tasks, and only one count a task is summed up."""
    at = F.monotonically_increasing_id()  # the task's number above 33 bits of the row's
    rows = materialize(in_order.withColumn("_at", at), "numbered").withColumn("_task", F.shiftright("_at", 33))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_task").agg(F.count("*").alias("_n")).select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_start") + 1
    return rows.join(F.broadcast(starts), "_task").withColumn(name, place).drop("_at", "_task", "_start")
