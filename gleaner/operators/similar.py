"""Near-duplicate pairs: Hamming distance by exact banding or by blocks, and bigram overlap by blocks of near lengths."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.similarity import hamming
from gleaner.operators.cluster import connected_components
from gleaner.scratch import materialize

#: Classes of bigrams whose counts bound a pair's overlap.
CLASSES = 64
#: Texts, and bytes of their bigrams, that a block of comparisons holds.
TEXTS, BYTES = 8192, 32 << 20


#: Words that a block of comparisons holds, the largest threshold for which words meet by bands, members of a chunk.
BLOCK, BANDED, CHUNK = 16_384, 6, 1000


def _words(df: DataFrame, key: str, bits: str) -> DataFrame:
    return df.where(F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).cast("long").alias("h"))


def near_words(words: DataFrame, threshold: int, width: int = 64) -> DataFrame:
    """(x, y, distance) of all pairs of different words (h) at ``threshold`` differing bits or fewer, each once.

    Small thresholds meet by bands: of words cut into t + 1 bands, two that differ in t bits at most agree in one. For
    larger ones bands would be so narrow that a good part of all pairs met, so each pair of blocks is compared outright
    by a task that holds these two blocks alone; time grows with the square of the words, memory doesn't grow.
    """
    words = words.select("h").distinct()
    return _met_in_bands(words, threshold, width) if threshold <= BANDED else _met_in_blocks(words, threshold)


def _met_in_bands(words: DataFrame, threshold: int, width: int) -> DataFrame:
    bands = min(width, threshold + 1)
    edges = [round(i * width / bands) for i in range(bands + 1)]
    value = lambda lo, hi: F.shiftrightunsigned("h", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1))
    own = words.select("h", F.inline(F.array(*[F.struct(F.lit(i).alias("band"), value(lo, hi).alias("v")) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])))
    x, y = own.alias("x"), own.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.h") < F.col("y.h")))
    return met.select(F.col("x.h").alias("x"), F.col("y.h").alias("y"), hamming("x.h", "y.h").alias("distance")).where(F.col("distance") <= threshold).distinct()


def _met_in_blocks(words: DataFrame, threshold: int) -> DataFrame:
    words = materialize(words, "words")
    n = words.count()
    blocks = max(1, -(-n // BLOCK), min(8, n // 1024))
    own, other = F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    sent = words.select("h", own.cast("int"), other)
    sent = sent.select((F.least("own", "other") * blocks + F.greatest("own", "other")).alias("task"), (F.col("own") > F.col("other")).alias("second"), "h")
    sent = sent.repartition(min(4096, blocks * (blocks + 1) // 2), "task").sortWithinPartitions("task")

    def compare(task: int, second: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = task // blocks == task % blocks
        x = h[~second]
        y = x if same else h[second]
        for at in range(0, len(x), 64):
            part = x[at : at + 64]
            d = np.bitwise_count(part[:, None] ^ y[None, :])
            i, j = np.nonzero(d <= threshold)
            if same:  # each pair once
                i, j = i[j > i + at], j[j > i + at]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(part[i].view(np.int64)), pa.array(y[j].view(np.int64)), pa.array(d[i, j].astype(np.int32))], names=["x", "y", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for b in batches:
            task, second, h = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1), len(task)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if task[lo] != now and held:
                    yield from compare(now, *(np.concatenate(c) for c in zip(*held)))
                    held = []
                now = int(task[lo])
                held.append((second[lo:hi], h[lo:hi]))
        if held:
            yield from compare(now, *(np.concatenate(c) for c in zip(*held)))

    return sent.select(F.col("task").cast("long"), "second", "h").mapInArrow(run, "x long, y long, distance int")


def hamming_pairs(df: DataFrame, key: str, bits: str, threshold: int, width: int = 64) -> DataFrame:
    """Links (a, b, distance) that make the same clusters as all pairs at ``threshold`` differing bits or fewer.

    Near words are linked by their representatives, equal words by a star; ``all_hamming_pairs`` has every pair.
    """
    rows = _words(df, key, bits)
    reps = rows.groupBy("h").agg(F.min("k").alias("k"))
    rep = lambda side, name: reps.select(F.col("h").alias(side), F.col("k").alias(name))
    near = near_words(rows, threshold, width).join(rep("x", "kx"), "x").join(rep("y", "ky"), "y").where("kx <> ky")
    between = near.select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"), "distance").distinct()
    equal = rows.join(reps.withColumnRenamed("k", "rep"), "h").where("k <> rep").select(F.col("rep").alias("a"), F.col("k").alias("b"), F.lit(0).alias("distance"))
    return between.unionByName(equal)


def all_hamming_pairs(df: DataFrame, key: str, bits: str, threshold: int, width: int = 64) -> DataFrame:
    """Every pair (a, b, distance), a < b, at ``threshold`` differing bits or fewer, of equal words too.

    Pairs of words are found first; then members meet in chunks of about ``CHUNK``, so that a word of many members is
    shared out among tasks.
    """
    rows = _words(df, key, bits)
    counts = rows.groupBy("h").agg(F.count("*").alias("c")).withColumn("n", F.ceil(F.col("c") / CHUNK).cast("int"))
    counts = materialize(counts, "counts")
    members = rows.join(counts, "h").select("h", F.pmod(F.xxhash64("k"), F.col("n")).cast("int").alias("chunk"), "k")
    near = near_words(counts, threshold, width).unionByName(counts.where("c > 1").select(F.col("h").alias("x"), F.col("h").alias("y"), F.lit(0).alias("distance")))
    for side in ("x", "y"):
        near = near.join(counts.select(F.col("h").alias(side), F.col("n").alias(f"n{side}")), side)
        near = near.withColumn(f"c{side}", F.explode(F.sequence(F.lit(0), F.col(f"n{side}") - 1)))
    for side in ("x", "y"):
        near = near.join(members.select(F.col("h").alias(side), F.col("chunk").alias(f"c{side}"), F.col("k").alias(f"k{side}")), [side, f"c{side}"])
    found = near.where("kx < ky or x <> y and kx > ky")
    return found.select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"), "distance")


def hamming_clusters(df: DataFrame, key: str, bits: str, threshold: int, width: int = 64) -> DataFrame:
    """(node, component) of the clusters that all pairs make: words are clustered first, their members follow."""
    rows = _words(df, key, bits)
    words = connected_components(near_words(rows, threshold, width), "x", "y")
    members = materialize(rows.join(words, F.col("h") == F.col("node"), "left").select("k", F.coalesce("component", "h").alias("c")), "members")
    least = members.groupBy("c").agg(F.min("k").alias("rep"))
    return connected_components(members.join(least, "c").where("k <> rep"), "rep", "k")


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, text) to (k, digest, n, p): the number of bigrams, and their sorted codes and counts as bytes."""
    for b in batches:
        digests, ns, profiles = [], [], []
        for t in b.column(1).to_pylist():
            raw = t.encode("utf-8", "surrogatepass")
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            codes, counts = np.unique(c[:-1] << np.uint64(32) | c[1:], return_counts=True)
            narrow = not len(c) or int(c.max()) < 1 << 16
            codes = (codes >> np.uint64(16) | codes & np.uint64(0xFFFF)).astype(np.uint32) if narrow else codes
            digests.append(hashlib.sha256(raw).digest())
            ns.append(len(c) - 1)
            profiles.append((b"n" if narrow else b"w") + codes.tobytes() + counts.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(ns, pa.int64()), pa.array(profiles, pa.binary())], names=["k", "digest", "n", "p"])


def _unpack(p: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = (len(p) - 1) // (8 if p[:1] == b"n" else 12)
    if p[:1] == b"w":
        codes = np.frombuffer(p, np.uint64, m, 1)
    else:
        codes = np.frombuffer(p, np.uint32, m, 1).astype(np.uint64)
        codes = (codes >> np.uint64(16)) << np.uint64(32) | codes & np.uint64(0xFFFF)
    return codes, np.frombuffer(p, np.uint32, m, len(p) - 4 * m).astype(np.int64)


class _Side:
    """Texts of a block by length: sums of their bigrams by class, and all their bigrams in a row."""

    def __init__(self, rows: list[tuple]):
        rows.sort(key=lambda r: r[1])
        self.keys, self.n = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
        parts = [_unpack(r[2]) for r in rows]
        self.sizes = np.array([len(c) for c, _ in parts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.codes, self.counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        cls = (self.codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(np.int64)
        row = np.repeat(np.arange(len(rows)), self.sizes)
        self.fine = np.bincount(row * CLASSES + cls, self.counts, len(rows) * CLASSES).astype(np.int32).reshape(-1, CLASSES)
        self.coarse = self.fine.reshape(len(rows), 8, -1).sum(2, dtype=np.int32)


def _near_texts(x: _Side, y: _Side, ratio: float) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of x, each with the rows of y that it is near to; a text and itself included, where x is y."""
    vocabulary, ids = np.unique(np.concatenate([x.codes, y.codes]), return_inverse=True)
    xi, yi = ids[: len(x.codes)], ids[len(x.codes) :]
    dense = np.zeros(len(vocabulary), np.int64)
    q = ratio / (2 - ratio)
    for i, n in enumerate(x.n):
        lo, hi = np.searchsorted(y.n, n * q - 1e-6), np.searchsorted(y.n, n / q + 1e-6, "right")
        if x is y:
            lo = max(lo, i)
        js = np.arange(lo, hi)
        for a, b in ((x.coarse, y.coarse), (x.fine, y.fine)):  # overlap by classes is never less than by bigrams
            if len(js):
                js = js[2 * np.minimum(a[i], b[js]).sum(1) >= ratio * (n + y.n[js])]
        mine = slice(x.at[i], x.at[i + 1])
        dense[xi[mine]] = x.counts[mine]
        for part in range(0, len(js), 512):
            j = js[part : part + 512]
            ends = np.cumsum(y.sizes[j])
            take = np.repeat(y.at[j] - ends + y.sizes[j], y.sizes[j]) + np.arange(ends[-1])
            shared = np.add.reduceat(np.minimum(dense[yi[take]], y.counts[take]), ends - y.sizes[j])
            hit = j[2 * shared >= ratio * (n + y.n[j])]
            if len(hit):
                yield i, hit
        dense[xi[mine]] = 0


def dice_pairs(df: DataFrame, key: str, text: str, ratio: float) -> DataFrame:
    """Pairs (a, b) whose bigram multisets overlap by Dice's coefficient of ``ratio`` or more; equal texts always do.

    Texts shorter than two characters pair with their equals only, empty ones with nothing. Equal texts collapse to a
    representative first. Overlap cannot reach the ratio unless the smaller multiset has r / (2 - r) of the larger, so
    texts meet those of their own cell of lengths and of the next, in blocks: a task holds two blocks. Sums of bigrams
    by class bound the overlap from above; what passes is compared bigram by bigram. Time grows with the square of the
    texts of a length, memory doesn't grow.
    """
    rows = df.where(F.length(text) > 0).where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    all_ = materialize(rows.mapInArrow(_profiles, f"k {kind}, digest binary, n long, p binary"), "profiles")
    reps = all_.groupBy("digest").agg(F.min("k").alias("rep"))
    equal = all_.select("k", "digest").join(reps, "digest").where("k <> rep").select(F.col("rep").alias("a"), F.col("k").alias("b"))
    cell = F.floor(F.log("n") / F.lit(1e-6 - math.log(ratio / (2 - ratio)))).cast("int")
    own = all_.where("n > 0").join(reps, "digest").where("k = rep").dropDuplicates(["digest"]).withColumn("cell", cell)
    found = own.groupBy("cell").agg(F.count("*").alias("c"), F.sum(F.length("p")).alias("bytes")).collect()  # a row for each cell of lengths: a hundred or so
    blocks = {r["cell"]: max(-(-r["c"] // TEXTS), -(-r["bytes"] // BYTES)) for r in found}
    if not blocks:
        return equal
    count = F.create_map(*[F.lit(v) for kv in blocks.items() for v in kv])
    many = lambda c: F.coalesce(F.try_element_at(count, c), F.lit(0))
    own = own.withColumn("i", F.pmod(F.xxhash64("digest"), many(F.col("cell"))).cast("int"))
    others = lambda c: F.filter(F.sequence(F.lit(0), many(c)), lambda j: j < many(c))
    task = lambda c, i, step, j: F.concat_ws(".", c, i, c + step, j)
    c, i = F.col("cell"), F.col("i")
    same = F.transform(others(c), lambda j: F.struct(task(c, F.least(i, j), 0, F.greatest(i, j)).alias("task"), (i > j).alias("second")))
    up = F.transform(others(c + 1), lambda j: F.struct(task(c, i, 1, j).alias("task"), F.lit(False).alias("second")))
    down = F.transform(others(c - 1), lambda j: F.struct(task(c - 1, j, 1, i).alias("task"), F.lit(True).alias("second")))
    tasks = sum(n * (n + 1) // 2 + n * blocks.get(c_ + 1, 0) for c_, n in blocks.items())
    sent = own.select("k", "n", "p", F.inline(F.concat(same, up, down))).repartition(min(4096, max(tasks, 1)), "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_ = None

        def compare(name: str, held: tuple[list, list]) -> Iterator[pa.RecordBatch]:
            at = name.split(".")
            alone = at[:2] == at[2:]
            if not held[0] or not (alone or held[1]):
                return
            x = _Side(held[0])
            y = x if alone else _Side(held[1])
            a, b = [], []
            for i, js in _near_texts(x, y, ratio):
                for j in js:
                    k, l = x.keys[i], y.keys[j]
                    if k != l:
                        a.append(min(k, l))
                        b.append(max(k, l))
                if len(a) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a, type_), pa.array(b, type_)], names=["a", "b"])
                    a, b = [], []
            yield pa.RecordBatch.from_arrays([pa.array(a, type_), pa.array(b, type_)], names=["a", "b"])

        now, held = None, ([], [])
        for batch in batches:
            type_ = batch.column(3).type
            for name, second, n, k, p in zip(*(batch.column(m).to_pylist() for m in range(5))):
                if name != now:
                    if now is not None:
                        yield from compare(now, held)
                    now, held = name, ([], [])
                held[second].append((k, n, p))
        if now is not None:
            yield from compare(now, held)

    between = sent.select("task", "second", "n", "k", "p").mapInArrow(run, f"a {kind}, b {kind}")
    return between.unionByName(equal)
