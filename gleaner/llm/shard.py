"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has CELLS positions; a key falls into the cell of its hash, and a cell belongs to the first virtual node at
or after it. Every shard has a capacity, and the capacities add up to the number of rows: the first rows % shards
shards hold one more than the others. Rows that meet a full shard go on clockwise to the next one with room. Where
each cell's rows go is decided on the cells' counts alone, whose number is fixed; rows then find their place by their
rank within their cell.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table, with_rank
from gleaner.scratch import materialize

#: Ring positions and virtual nodes of each shard; they bound the plan, whatever the number of rows.
CELLS, VIRTUAL = 1 << 14, 64


def ring(shards: int, cells: int = CELLS, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(position, shard) of the virtual nodes, clockwise. A position that two nodes want goes to the lower shard, so
    a further shard takes only positions that were free or others' spans, never moves a node."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(virtual):
            at.setdefault(int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big") % cells, s)
    return sorted(at.items())


def route(counts: dict[int, int], shards: int, cells: int = CELLS, virtual: int = VIRTUAL) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, past-the-end rank, shard, first slot): where the rows of each cell go."""
    total, nodes = sum(counts.values()), ring(shards, cells, virtual)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    order = []  # for each arc, the distinct shards met clockwise
    for i in range(len(nodes)):
        seen: list[int] = []
        for j in range(len(nodes)):
            s = nodes[(i + j) % len(nodes)][1]
            if s not in seen:
                seen.append(s)
                if len(seen) == shards:
                    break
        order.append(seen + [s for s in range(shards) if s not in seen])
    starts = [p for p, _ in nodes]
    arc_of, arc = {}, 0
    for c in range(cells):
        while arc < len(starts) and starts[arc] < c:
            arc += 1
        arc_of[c] = arc % len(starts)
    left = {c: n for c, n in counts.items() if n}
    taken = {c: 0 for c in left}
    used, out = [0] * shards, []
    for k in range(shards):  # every row knocks at its k-th shard before any row goes on to its next one
        for c in sorted(left):
            s = order[arc_of[c]][k]
            n = min(left[c], room[s])
            if n:
                out.append((c, taken[c], taken[c] + n, s, used[s]))
                taken[c] += n
                used[s] += n
                room[s] -= n
                left[c] -= n
        left = {c: n for c, n in left.items() if n}
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row; law ``rows``: counts differ by one at most.

    A null id is a key like any other, and rows that share an id share a cell until a shard is full. A null text has
    size 1 and the CRC of no bytes. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.spark_partition_id().alias("pid"))
    slim = materialize(slim.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int")), "ring")
    counts = {r["cell"]: r["n"] for r in slim.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    schema = "cell int, lo long, hi long, shard int, base long"
    routes = route(counts, shards)
    plan = spark.createDataFrame(pd.DataFrame(routes, columns=["cell", "lo", "hi", "shard", "base"]), schema) if routes else spark.createDataFrame([], schema)
    ranked = with_rank(slim, ["cell"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "pid")
    # the plan has at most CELLS + shards * VIRTUAL * shards rows
    placed = ranked.join(F.broadcast(plan), "cell").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
