"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Each shingle draws one pseudo-random permutation of the signature's positions and gives position j the value
rank(j) + r, r uniform in [0, 1). A signature holds the least value at each position. Ranks of one shingle are
distinct, which lowers the variance against independent hashes, and once every position holds a value below k + 1,
ranks above k can't matter: long documents stop after two or three ranks. Permutations are affine maps modulo a prime,
so ranks at two positions are distributed as under a uniform permutation, and with them the estimate's variance.

Documents of equal shingle sets form a class and travel as its smallest id. Bands of five components name buckets; a
bucket is joined to its smallest member first, and only members that verified links have not already brought together
are compared with each other, and of these only such as are near in size. Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.bpe import Bounded
from gleaner.llm.common import only, per_row, table, without
from gleaner.operators.cluster import connected_components
from gleaner.scratch import drop, materialize

#: Signature positions (prime), components used, components in a band, and bits of each. A pair at similarity 0.8
#: shares no band with probability (1 - 0.8^5)^40, about 1e-7.
M, USED, ROWS, BITS = 211, 200, 5, 12
#: A pair is verified where this many of the components agree: six standard deviations below the mean at 0.8.
AGREE = 126


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words, ASCII letters lower-cased."""

    def __init__(self, size: int = 2):
        self.size, self.memo = size, Bounded(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        h = np.fromiter([memo[w] for w in words], np.uint64, len(words))
        if len(words) < self.size:
            return mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64))
        n, out = len(words) - self.size + 1, np.zeros(len(words) - self.size + 1, np.uint64)
        for i in range(self.size):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        return np.unique(mix(out))


def signature(x: np.ndarray) -> np.ndarray:
    """The SuperMinHash values of a set of 64-bit hashes at all positions: rank in the high, draw in the low 32 bits."""
    a = (mix(x + np.uint64(1)) % np.uint64(M - 1)).astype(np.int64) + 1
    c = (mix(x + np.uint64(2)) % np.uint64(M)).astype(np.int64)
    best, rank = np.full(M, np.iinfo(np.uint64).max, np.uint64), 0
    step = min(M, max(1, -(-1200 // len(x))))
    while rank < M:
        k = np.arange(rank, min(M, rank + step), dtype=np.int64)
        at = (a[:, None] * k + c[:, None]) % M
        draw = mix(x[:, None] + k.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)
        np.minimum.at(best, at.ravel(), (draw | (k.astype(np.uint64) << np.uint64(32))).ravel())
        rank = int(k[-1]) + 1
        if int(best.max()) >> 32 < rank:  # every position holds a rank that later ones can't undercut
            break
        step = max(1, step // 2)
    return best


def bands(x: np.ndarray) -> np.ndarray:
    """The signature's components, BITS bits each, ROWS of them to a 64-bit band."""
    c = mix(signature(x)[:USED]) & np.uint64((1 << BITS) - 1)
    return (c.reshape(-1, ROWS) << (np.arange(ROWS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64)


def _agreeing(a: str, b: str) -> F.Column:
    """How many components two band arrays share."""
    def lanes(x):
        return sum((F.shiftright(x, i * BITS).bitwiseAND(F.lit((1 << BITS) - 1)) == 0).cast("int") for i in range(ROWS))

    xor = F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))
    return F.aggregate(xor, F.lit(0), lambda s, x: s + lanes(x))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the (a, b) pairs whose full shingle sets are similar enough."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bands").alias("ba"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("bb"))
    likely = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    likely = materialize(likely.where(_agreeing("ba", "bb") >= AGREE).select("a", "b", "na", "nb"), "likely")
    wanted = likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))).distinct()
    texts = only(docs.select("doc_id", "text"), materialize(wanted, "wanted"), "doc_id")

    def make():
        shingle = Shingler(size)
        return lambda ts: ([shingle(t).view(np.int64) for t in ts],)

    sets = materialize(per_row(texts, ["doc_id"], "text", "s array<long>", make), "sets")
    both = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = materialize(both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct(), "links")
    drop(sets)
    drop(likely)
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents are linked where 100 * shared shingles >= ``percent`` * united shingles; component_id is the least id
    reachable. A text of fewer than ``size`` words is one shingle; null, empty and blank texts have none and are
    linked with nothing. Rows that share an id count as one document. Rows without an id are linked with nothing
    and kept. An empty table gives an empty result; columns other than the two named are not looked at.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def make():
        shingle = Shingler(size)

        def work(texts):
            n, f1, f2, sig = [], [], [], []
            for t in texts:
                x = shingle(t)
                n.append(len(x))
                if len(x):
                    d = xxhash.xxh3_128_intdigest(x.tobytes())
                    f1.append((d >> 64) - (1 << 63))
                    f2.append((d & (1 << 64) - 1) - (1 << 63))
                    sig.append(bands(x))
                else:
                    f1.append(None)
                    f2.append(None)
                    sig.append(None)
            return n, f1, f2, sig

        return work

    sketch = materialize(per_row(docs, ["doc_id"], "text", "n long, f1 long, f2 long, bands array<long>", make), "sketch")
    classes = sketch.where("f1 is not null and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = sketch.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"], "left_semi").select("doc_id", "n", "bands")
    reps = materialize(reps, "reps")

    spread = reps.select("doc_id", F.posexplode("bands").alias("i", "key")).select("doc_id", F.xxhash64("i", "key").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead <> last").select("bucket", "lead")
    members = materialize(spread.join(buckets, "bucket"), "members")
    stars = members.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = materialize(stars, "starpairs")
    links = _verified(stars, docs, reps, size, percent)
    grouped = connected_components(links, "a", "b")

    # members of one bucket that lie in different components so far may still be linked to each other
    placed = members.join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = materialize(placed, "placed")
    split = placed.groupBy("bucket").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi and c > 2").select("bucket")
    open_ = placed.join(split, "bucket", "left_semi").join(reps.select("doc_id", "n"), "doc_id")
    # sizes within the similarity fall into the same cell or neighbouring ones, so a crowded bucket is split by size
    width = F.lit(math.log(100 / percent) + 1e-9 if percent < 100 else 1e-9)
    cell = F.floor(F.log("n") / width)
    x = open_.withColumn("cell", cell).alias("x")
    y = open_.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).alias("y")
    cross = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
    cross = cross.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = _verified(cross, docs, reps, size, percent)
    parts = connected_components(links.union(more), "a", "b")
    final = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2").join(final, ["f1", "f2"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but the least id of every near-duplicate group.

    Where an id repeats, each of its different texts stays once, in the row whose other columns come first as JSON;
    rows without an id all stay. Other columns are kept whatever their names.
    """
    found = materialize(near_duplicates(docs, size, percent, id_col, text).select("doc_id", "kept"), "kept")
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias(id_col))
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    left = without(docs, gone, id_col)
    if again.limit(1).count():
        held = left.join(again, id_col, "left_semi").select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("t"))
        first = Window.partitionBy("id", "h", "t").orderBy(F.to_json("row"))
        once = held.withColumn("i", F.row_number().over(first)).where("i = 1").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
        left = left.join(again, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionAll(once)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, sh FROM s),
g AS (SELECT doc_id, n, unnest(sh) AS g FROM n),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x, min(y) AS component FROM r GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id,
  doc_id = coalesce(component, doc_id) AS kept FROM n LEFT JOIN m ON x = doc_id
"""
