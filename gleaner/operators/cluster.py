"""Connected components of an undirected graph given as an edge table.

Distributed union-find: every task first contracts its own edges with an in-memory union-find whose size is bounded
by a chunk of edges, and only the resulting forest travels. Alternating large-star and small-star rounds then connect
the forests until no edge changes. Nothing but one counter per round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.scratch import drop, materialize

#: Edges that one local union-find holds at a time.
CHUNK = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}
    seen = 0

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush():
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], ["u", "v"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= CHUNK:
            yield flush()
            seen = 0
    if parent:
        yield flush()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node that an edge joins to another; component is the least node reachable.

    Self-loops, repeated edges and edges with a null end add nothing. An empty edge table gives an empty result.
    Ids may be integers or strings; strings compare by code point.
    """
    kind = dict(edges.dtypes)[src]
    schema = f"u {kind}, v {kind}"
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    cur = materialize(e.mapInArrow(_contract, schema), "forest")
    for _ in range(max_rounds):
        if cur.count() <= CHUNK:  # few enough for one local union-find, which then gives the whole answer
            small = materialize(cur.coalesce(1).mapInArrow(_contract, schema), "stars")
            drop(cur)
            cur = small
            break
        # large-star: each node's larger neighbours move to its least neighbour
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small-star: each node's smaller neighbours, and itself, move to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        nxt = materialize(small, "stars")
        # a fixed point is a set of stars: every node has one parent, and no parent has a parent
        bent = nxt.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or nxt.select("u").distinct().join(nxt.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        drop(cur)
        cur = nxt
        if not bent:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
