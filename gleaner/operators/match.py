"""Joins with a preference: tiered matches, path prefixes, longest directories, anti-joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from gleaner.functions.paths import ancestors

#: Characters of a segment in which directories are looked for at once.
PIECE = 256
#: Characters of directories that a trie in each task may hold.
TRIE = 200_000


def _settled(refs: DataFrame, targets: DataFrame, ref_id: str, tiers: list[tuple[Column, Column]], target_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(ref, tier, _keys) of the first tier whose keys any target has, and the targets (_tier, _key, columns) by all their keys.

    Keys of all tiers meet in one join, and null keys never travel, so no task gets all rows that lack a tier's key.
    """
    def keys(sides: list[Column]) -> Column:
        pairs = F.array(*[F.struct(F.lit(i).alias("_tier"), k.cast("string").alias("_key")) for i, k in enumerate(sides)])
        return F.inline(F.filter(pairs, lambda x: x["_key"].isNotNull()))

    by_key = targets.select(keys([right for _, right in tiers]), *target_columns)
    met = refs.select(ref_id, keys([left for left, _ in tiers])).join(by_key.select("_tier", "_key").distinct(), ["_tier", "_key"], "left_semi")
    own = met.groupBy(ref_id).agg(F.min("_tier").alias("tier"), F.collect_set(F.struct("_tier", "_key")).alias("_keys"))
    return own.withColumn("_keys", F.filter("_keys", lambda x: x["_tier"] == F.col("tier"))), by_key


def match_cascade(refs: DataFrame, targets: DataFrame, ref_id: str, tiers: list[tuple[Column, Column]], target_columns: list[str]) -> DataFrame:
    """All targets of the first tier that has any, for each reference.

    A tier is a pair of key expressions, of the reference and of the target; a null key matches nothing. A reference
    first meets all tiers' distinct keys, which gives its tier; then it meets the targets of that tier alone. All of
    it is equi-joins, so Spark may broadcast or shuffle as the sizes suggest, and no tier's hits are made in vain.
    """
    own, by_key = _settled(refs, targets, ref_id, tiers, target_columns)
    hits = own.select(ref_id, F.inline("_keys")).join(by_key, ["_tier", "_key"])
    return hits.select(ref_id, (F.col("_tier") + 1).alias("tier"), *target_columns).distinct()


def cascade_totals(refs: DataFrame, targets: DataFrame, ref_id: str, tiers: list[tuple[Column, Column]], value: str) -> DataFrame:
    """(ref, tier, matches, first): number and least of the different values that ``match_cascade`` would give each reference.

    Targets are counted once for each key, before references meet them, so hits are never made; only a reference that
    stands for several keys of its tier meets their targets one by one.
    """
    own, by_key = _settled(refs, targets, ref_id, tiers, [value])
    totals = [F.count(value).alias("matches"), F.min(value).alias("first")]
    one, several = (own.where(c).select(ref_id, F.inline("_keys")) for c in ("size(_keys) = 1", "size(_keys) > 1"))
    out = one.join(by_key.distinct().groupBy("_tier", "_key").agg(*totals), ["_tier", "_key"]).select(ref_id, "_tier", "matches", "first")
    rest = several.join(by_key, ["_tier", "_key"]).select(ref_id, "_tier", value).distinct().groupBy(ref_id, "_tier").agg(*totals)
    return out.unionByName(rest).select(ref_id, (F.col("_tier") + 1).alias("tier"), "matches", "first")


def ancestor_table(df: DataFrame, key: str, path: str) -> DataFrame:
    """(key, ancestor): turns prefix and range conditions on paths into equi-joins."""
    return df.select(key, F.explode(ancestors(path)).alias("ancestor")).distinct()


def prefix_join(prefixes: DataFrame, prefix: str, items: DataFrame, key: str, path: str) -> DataFrame:
    """Every (prefix row, key) whose path lies below the prefix's directory."""
    table = ancestor_table(items, key, path).withColumnRenamed("ancestor", prefix)
    return prefixes.join(table, prefix)


def longest_directory(segments: DataFrame, ref_id: str, segment: str, dirs: DataFrame, directory: str, order: str) -> DataFrame:
    """The longest known directory that a segment of the reference contains; ties go to the first known.

    Containment starts anywhere. Where the directories are few, a segment's characters are walked along a trie of them,
    in the tasks that hold the segments, and a rank alone travels for each hit. Where they are many, substrings meet
    them by equality. Never is every segment compared with every directory.
    """
    known = dirs.where(F.length(directory) > 0)
    if (known.agg(F.sum(F.length(directory))).first()[0] or 0) > TRIE:
        return _longest_by_substrings(segments, ref_id, segment, known, directory, order)
    first = known.groupBy(directory).agg(F.min(order).alias("_o")).orderBy(F.length(directory).desc(), "_o", directory).select(directory)
    names = [r[0] for r in first.collect()]  # by rank: the longest first
    kind = segments.schema[ref_id].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        for rank, name in enumerate(names):
            node = root
            for c in name:
                node = node.setdefault(c, {})
            node[""] = rank
        none = len(names)
        for b in batches:
            at, ranks = [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                best, n = none, len(s)
                for start in range(n):
                    node, j = root.get(s[start]), start + 1
                    while node is not None:
                        best = min(best, node.get("", none))
                        if j == n:
                            break
                        node, j = node.get(s[j]), j + 1
                if best < none:
                    at.append(i)
                    ranks.append(best)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(ranks, pa.int32())], names=[ref_id, "_rank"])

    found = segments.where(F.length(segment) > 0).select(ref_id, F.col(segment).alias("_s")).mapInArrow(walk, f"`{ref_id}` {kind}, _rank int")
    ranked = segments.sparkSession.createDataFrame(list(enumerate(names)), StructType([StructField("_rank", IntegerType()), StructField(directory, StringType())]))
    return found.groupBy(ref_id).agg(F.min("_rank").alias("_rank")).join(F.broadcast(ranked), "_rank").select(ref_id, directory)


def _longest_by_substrings(segments: DataFrame, ref_id: str, segment: str, dirs: DataFrame, directory: str, order: str) -> DataFrame:
    """Candidates are all substrings as long as some directory: they are exploded from the segments, of any length.

    They meet directories by equality. Segments are cut into pieces that overlap by the longest directory, as a position is searched from
    a string's start.
    """
    lengths = dirs.where(F.length(directory) > 0).agg(F.collect_set(F.length(directory)).alias("_lengths"))
    cut = segments.where(F.length(segment) > 0).select(ref_id, F.col(segment).alias("_s")).crossJoin(F.broadcast(lengths)).where(F.size("_lengths") > 0)
    offsets = F.sequence(F.lit(1), F.length("_s"), F.lit(PIECE))
    pieces = F.transform(offsets, lambda o: F.substring(F.col("_s"), o, F.array_max("_lengths") + F.lit(PIECE - 1)))
    cut = cut.select(ref_id, "_lengths", F.explode(pieces).alias("_s"))
    n = F.length("_s")
    parts = F.flatten(F.transform(F.filter("_lengths", lambda k: k <= n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("_s"), i, k))))
    sub = cut.select(ref_id, F.explode(F.array_distinct(parts)).alias(directory))
    hit = sub.join(dirs.select(directory, order), directory)
    return hit.groupBy(ref_id).agg(F.min_by(directory, F.struct(-F.length(directory), F.col(order))).alias(directory))


def absent(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` that ``right`` lacks."""
    return left.join(right.select(*on).distinct(), on, "left_anti")
