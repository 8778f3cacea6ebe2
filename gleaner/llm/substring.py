"""Repeated passages by prefix-partitioned suffix trees.

A window is WINDOW consecutive words of one document; it counts as repeated where its word sequence starts anywhere
else. Not every suffix needs a partition of its own: in each window the ANCHOR-gram of least hash is its anchor, the
same in every copy of the window, so the suffixes that start in windows of one anchor travel together, as one span.

Spans are partitioned by prefix, the anchor's words first. A prefix that holds more than GROUP different spans is
lengthened, STEP words at a time and for each window's suffix by itself, until its group fits a task's memory; at the
window's own length equal prefixes are equal windows. The suffix tree of a group is its sorted suffixes with their
common-prefix lengths: internal nodes as deep as the window are maximal repeats, and the words on the way to them are
what repeats. Hashes only choose what is brought together: of spans that agree in their hash two are compared in the
tree, and prefixes that occur once are dropped before any text is touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bpe import Bounded
from gleaner.llm.common import let_go, packed, per_row, table, unpacked
from gleaner.llm.minhash import mix
from gleaner.scratch import drop, materialize

#: Words in a window and in an anchor; different spans of one prefix that one task takes; by how many words a crowded
#: prefix grows; words of all groups that are sorted together.
WINDOW, ANCHOR, GROUP, STEP, BATCH = 35, 8, 5_000, 8, 100_000
#: Bytes of words that are handed over at a time.
OUT = 2 << 20


class Words:
    """64-bit hashes of a text's words."""

    def __init__(self):
        self.memo = Bounded(xxhash.xxh3_64_intdigest)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        return np.fromiter([memo[w] for w in words], np.uint64, len(words))


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``n`` words."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return mix(out)


def anchors(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """For runs of windows with one anchor: the anchor's hash, a hash of the span, and (first window, how many) in one number.

    The anchor of a window is its leftmost least gram.
    """
    if len(h) < window:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    g, w = grams(h, anchor), window - anchor + 1
    # leftmost minimum of each run of w grams, by doubling
    at = np.arange(len(g))
    size = 1
    while size < w:
        step = min(size, w - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        size += step
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([edge, [len(at)]]))
    place = at[edge]
    # the span [first window, last window's end) by a positional sum: equal spans at equal distance to the anchor agree
    weight = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), weight)]), dtype=np.uint64)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix(h) * powers[:-1], dtype=np.uint64)])
    end = edge + count - 1 + window
    total = prefix[end] - prefix[edge]
    inverse = np.uint64(pow(int(weight), -1, 1 << 64))
    backs = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), inverse)]), dtype=np.uint64)
    span = mix(mix(total * backs[edge]) + (place - edge).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + count.astype(np.uint64))
    return g[place].view(np.int64), span.view(np.int64), edge << 16 | count << 8


#: A span's first window, out of what ``anchors`` gives.
_FIRST = "shiftright(at, 16)"


def node_depths(words: np.ndarray, sizes: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Depth of the deepest internal node above each suffix in ``starts``, as far as it is ``least`` or more; else 0.

    ``words`` are strings of ``sizes`` words one after another, and no suffix reaches beyond its string. Suffixes are
    ranked by 1, 2, 4, ... words, each round from the one before, then sorted; a suffix's deepest node is its longest
    common prefix with a neighbour, which the ranks give from the longest down.
    """
    ends = np.cumsum(sizes)
    _, rank = np.unique(words, return_inverse=True)
    room = np.insert(rank + len(sizes), ends, np.arange(len(sizes)))  # each string ends in a symbol of its own
    starts = starts + np.searchsorted(ends, starts, "right")
    rank, levels, h = room.astype(np.int64), [], 1
    while h <= int(sizes.max(initial=0)):
        levels.append((h, rank))
        nxt = np.concatenate([rank[h:], np.zeros(min(h, len(rank)), np.int64)])
        _, rank = np.unique(rank * (len(room) + 1) + nxt, return_inverse=True)
        h *= 2
        if h <= least:  # suffixes that no other begins like lead to no node
            starts = starts[np.bincount(rank)[rank[starts]] > 1]
    depth = np.zeros(len(room), np.int64)
    order = starts[np.argsort(rank[starts], kind="stable")]
    lcp = np.zeros(max(0, len(order) - 1), np.int64)
    for h, r in reversed(levels):
        a, b = order[:-1] + lcp, order[1:] + lcp
        inside = (a < len(r)) & (b < len(r))
        lcp += h * (inside & (r[np.minimum(a, len(r) - 1)] == r[np.minimum(b, len(r) - 1)]))
    lcp[lcp < least] = 0
    np.maximum.at(depth, order[1:], lcp)
    np.maximum.at(depth, order[:-1], lcp)
    return np.delete(depth, ends + np.arange(len(sizes)))


def repeated_words(words: np.ndarray, sizes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to) of the words that lie on the way to a node of depth ``window`` or more.

    The suffixes of a string are those of its first ``counts`` windows.
    """
    begin = np.cumsum(sizes) - sizes
    starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    depth = node_depths(words, sizes, starts, window)
    edge = np.zeros(len(words) + 1, np.int64)
    deep = np.flatnonzero(depth)
    np.add.at(edge, deep, 1)
    np.add.at(edge, deep + depth[deep], -1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.cumsum(edge[:-1]) > 0
    turn = np.concatenate([[True], (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])]) if len(words) else np.zeros(0, bool)
    lo = np.flatnonzero(turn)
    hi = np.concatenate([lo[1:], [len(words)]])[inside[lo]] if len(lo) else lo
    lo = lo[inside[lo]] if len(lo) else lo
    return row[lo], lo - begin[row[lo]], hi - begin[row[lo]]


def _trees(window: int) -> Callable:
    """Batches of (key, g, span, i, n, leaf, words), sorted by key, to (g, span, lo, hi): repeated words of each span.

    Groups are never parted; small ones are sorted together. Rows with ``leaf`` are copies that only confirm others.
    """

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        col = {c: t.column(c).to_numpy() for c in ("g", "span", "i", "n", "leaf")}
        text = t.column("words").combine_chunks() if t.num_rows else pa.array([], pa.binary())
        sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]) // 8
        at = np.frombuffer(text.buffers()[1], np.int32)[text.offset]
        words = np.frombuffer(text.buffers()[2], np.uint8)[at : at + 8 * int(sizes.sum())].copy().view(np.uint64)
        row, lo, hi = repeated_words(words, sizes, col["n"], window)
        own = ~col["leaf"][row].astype(bool)
        row, lo, hi = row[own], lo[own], hi[own]
        return pa.RecordBatch.from_arrays([pa.array(col["g"][row]), pa.array(col["span"][row]), pa.array(lo + col["i"][row]), pa.array(hi + col["i"][row])], names=["g", "span", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held, size, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("key").to_numpy()
            edges = np.flatnonzero(np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]]))
            done = 0
            for e in edges:  # a group begins here: what is held may go
                if e > done:
                    held.append(b.slice(done, e - done))
                    size += held[-1].column("words").nbytes // 8
                    done = e
                if size > BATCH:
                    yield solve(held)
                    held, size = [], 0
            held.append(b.slice(done))
            size += held[-1].column("words").nbytes // 8
            last = keys[-1]
        if held:
            yield solve(held)
        held = b = None  # noqa: F841
        let_go()

    return run


_TREE = "g long, span long, lo long, hi long"
_ROWS = "key long, g long, span long, i long, n long, leaf boolean, spans long, words binary"


def _planted(rows: DataFrame, window: int) -> DataFrame:
    """The trees of all groups of rows that share a ``key``."""
    slim = rows.select("key", "g", "span", "i", "n", "leaf", "words")
    return slim.repartition("key").sortWithinPartitions("key").mapInArrow(_trees(window), _TREE)


def _crowded(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """Repeated words of prefixes that hold too many spans: each window's suffix gets a longer prefix, until groups fit.

    At the window's length a group's windows are the same window: they repeat where there is more than one, and an
    aggregate with partial sums on the windows themselves says so, however many there are.
    """
    n = F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i")
    each = rows.select("g", "span", "leaf", "words", n).select("g", "span", "leaf", F.col("i").cast("long").alias("i"), F.lit(1).cast("long").alias("n"), F.expr(f"substring(words, 8 * i + 1, {8 * window})").alias("words"))
    each, out = materialize(each, "windows"), None
    for k in [*range(anchor + STEP, window, STEP), window]:
        if k == window:
            again = each.groupBy("words").agg(F.count("*").alias("c")).where("c > 1").select("words")
            part = each.join(again, "words", "left_semi").where("not leaf").select("g", "span", F.col("i").alias("lo"), (F.col("i") + window).alias("hi"))
        else:
            each = each.withColumn("key", F.xxhash64(F.substring("words", 1, 8 * k), "g"))
            sizes = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")  # alone with its prefix: no node
            each = materialize(each.join(sizes, "key"), "windows")
            part = _planted(each.where(F.col("c") <= GROUP), window)
            each = each.where(F.col("c") > GROUP).drop("key", "c")
        out = part if out is None else out.unionByName(part)
        if k < window and not each.limit(1).count():
            break
    return out


def repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of rows (file, row, rest, text): (file, row, rest, n_words, sha), and (file, row, lo, hi): words lo to hi repeat."""
    anchor = min(ANCHOR, window)

    def scan():
        word = Words()

        def work(texts):
            n, sha, gs, spans, ats = [], [], [], [], []
            for t in texts:
                ws = split(t)
                g, span, at = anchors(word(ws), window, anchor)
                n.append(len(ws))
                sha.append(hashlib.sha256(b" ".join(ws)).hexdigest() if digest else None)
                gs.append(g)
                spans.append(span)
                ats.append(at)
            return n, sha, gs, spans, ats

        return work

    keep = ["file", "row", *["rest"] * digest]
    scanned = materialize(per_row(docs, keep, "text", "n_words long, sha string, g array<long>, span array<long>, at array<long>", scan), "anchors")
    suffixes = scanned.where(F.size("g") > 0).select("file", "row", F.inline(F.arrays_zip("g", "span", "at")))
    # one row for each different span of a prefix, with two of its places; then what the prefix holds altogether
    place = F.struct("file", "row", "at")
    spans = suffixes.groupBy("g", "span").agg(F.count("*").alias("c"), F.min(place).alias("a"), F.max(place).alias("b"))
    groups = spans.groupBy("g").agg(F.count("*").alias("spans"), F.sum("c").alias("total")).where("total > 1")
    spans = materialize(spans.join(groups.select("g", "spans"), "g"), "spans")
    asked = F.when(F.col("c") > 1, F.array(F.struct("a.*", F.lit(False).alias("leaf")), F.struct("b.*", F.lit(True).alias("leaf")))).otherwise(F.array(F.struct("a.*", F.lit(False).alias("leaf"))))
    wanted = spans.select("g", "span", "spans", F.inline(asked))
    # a row lists anchors of one document, so it grows with that document's text alone
    wanted = wanted.groupBy("file", "row").agg(F.collect_list(F.struct("g", "span", "spans", "at", "leaf")).alias("w"))
    texts = docs.select("file", "row", "text").join(wanted, ["file", "row"]).select("text", "w")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        word, out, size = Words(), [], 0
        for b in batches:
            lists, texts_ = b.column("w"), b.column("text")
            for i in range(b.num_rows):
                h, v = word(split(texts_[i].as_py())), lists[i].values
                at = v.field("at").to_numpy()
                first, n = at >> 16, at >> 8 & 255
                words = [h[f : f + k + window - 1].tobytes() for f, k in zip(first.tolist(), n.tolist())]
                zero = np.zeros(len(at), np.int64)
                out.append(pa.RecordBatch.from_arrays([v.field("g"), v.field("g"), v.field("span"), pa.array(zero), pa.array(n), v.field("leaf"), v.field("spans"), pa.array(words, pa.binary())], names=["key", "g", "span", "i", "n", "leaf", "spans", "words"]))
                size += sum(map(len, words))
                if size > OUT:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, size = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        word = out = b = lists = texts_ = h = v = words = None  # noqa: F841
        let_go()

    cut_ = materialize(texts.mapInArrow(fetch, _ROWS), "spans-words")
    hits = _planted(cut_.where(F.col("spans") <= GROUP), window)
    if cut_.where(F.col("spans") > GROUP).limit(1).count():
        hits = hits.unionByName(_crowded(cut_.where(F.col("spans") > GROUP), window, anchor))
    hits = materialize(hits, "repeats")
    drop(cut_)
    first = F.expr(_FIRST)
    found = suffixes.join(hits, ["g", "span"]).select("file", "row", (F.col("lo") + first).alias("lo"), (F.col("hi") + first).alias("hi"))
    return scanned.select(*keep, "n_words", "sha"), found


def covered(n_words: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of a document's words lie in one of the stretches."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0


def _from_files(docs: DataFrame) -> bool:
    """Whether the rows are read straight from files, so that a file and a place in it name a row in every scan."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.deterministic() and plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and "_metadata" not in docs.columns:
        plan = plan.children().apply(0)
    try:
        return plan.nodeName() == "LogicalRelation" and docs.select("_metadata.row_index") is not None
    except Exception as e:
        if "UNRESOLVED" in str(e) or "FIELD_NOT_FOUND" in str(e):  # a format without places
            return False
        raise


def named(docs: DataFrame, text: str) -> DataFrame:
    """(rest, text, file, row): rows by where they lie, the same in every scan whatever its splits or executors.

    Rows that don't come straight from files are written down first.
    """
    rest = F.col("_rest").alias("rest")
    if _from_files(docs):
        where = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
        cols = [c for c in docs.columns if c != text]
        return docs.select(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).alias("rest"), F.col(f"`{text}`").alias("text"), *where)
    held = materialize(packed(docs, text), "docs")
    return held.select(rest, F.col("_text").alias("text"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", digest: bool = False) -> DataFrame:
    """Cut every word that a repeated window covers; all copies lose it.

    Appends n_words, n_removed and, as asked, kept_sha256 or the new text: kept words joined by one space, or the old
    text untouched where nothing was cut. Null texts have no words and stay null; empty texts and texts shorter than a
    window lose nothing. Rows may repeat in every column: each counts as a document of its own, so two equal texts lose
    all windows. A text of any length is one row in Python; its anchors grow with it. Windows are 8 to 70 words. Columns named like the added ones are replaced; an empty table gives an empty result.
    """
    if not ANCHOR <= window <= 70:
        raise ValueError("windows of 8 to 70 words only")
    held = named(docs, text)
    scanned, found = repeats(held, window, digest)
    hits = materialize(found.groupBy("file", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("w")), "hits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            n, gone, sha, new, size, begin = [], [], [], [], 0, 0
            t, lists = b.column("text"), b.column("w")

            def out(end: int) -> pa.RecordBatch:
                part = b.slice(begin, end - begin)
                kept = [part.column("file"), part.column("row")] if digest else [part.column("rest")]
                return pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha if digest else new, pa.string())], names=[*(["file", "row"] if digest else ["rest"]), "n_words", "n_removed", "result"])

            for i in range(b.num_rows):
                old = t[i].as_py()
                ws, v = split(old), lists[i].values
                out_ = covered(len(ws), v.field("lo").to_numpy(), v.field("hi").to_numpy()) if v is not None and len(v) else None
                n.append(len(ws))
                gone.append(0 if out_ is None else int(out_.sum()))
                kept = None if out_ is None else b" ".join([w for w, x in zip(ws, out_.tolist()) if not x])
                if digest:
                    sha.append(hashlib.sha256(kept if kept is not None else b" ".join(ws)).hexdigest())
                else:
                    new.append(old if kept is None else kept.decode("utf-8", "replace"))
                    size += len(old or "")
                if size > OUT:
                    yield out(i + 1)
                    n, gone, sha, new, size, begin = [], [], [], [], 0, i + 1
            if n:
                yield out(b.num_rows)

    added = ("n_words", "n_removed", "kept_sha256")
    if digest:  # untouched texts keep the digest of the first scan
        changed = held.select("file", "row", "text").join(hits, ["file", "row"]).select("file", "row", "text", "w").mapInArrow(cut, "file long, row long, n_words long, n_removed long, result string")
        done = scanned.join(changed.select("file", "row", F.col("n_removed").alias("gone"), "result"), ["file", "row"], "left")
        done = done.select(F.col("rest").alias("_rest"), "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("result", "sha").alias("kept_sha256"))
    else:
        kind = dict(held.dtypes)["rest"]
        done = held.join(hits, ["file", "row"], "left").select("rest", "text", "w").mapInArrow(cut, f"rest {kind}, n_words long, n_removed long, result string").withColumnRenamed("rest", "_rest")
    back: list[Column] = [c for n, c in zip(docs.columns, unpacked(docs, text, F.lit(None) if digest else F.col("result"))) if n not in added and not (digest and n == text)]
    return done.select(*back, "n_words", "n_removed", *["kept_sha256"] * digest)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
h AS (SELECT p.doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM p JOIN w USING (doc_id)),
r AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i FROM h JOIN r USING (k)), (SELECT unnest(range(0, 35)) AS j)),
l AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ')
    ELSE coalesce(array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN l ON w.doc_id = l.doc_id
"""
