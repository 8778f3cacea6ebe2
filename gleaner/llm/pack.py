"""Packing token runs into fixed windows by minimum bin slack.

A document's ids are cut into full windows and one remainder. The remainders' lengths form a histogram of at most
``window - 1`` entries whatever the corpus; the plan is made on that alone. For each window the longest length left
is placed first, and a bitset subset-sum over the other lengths finds the multiset that comes closest to what is
left; backtracking gives how often each length is used, and the pattern repeats as often as the counts allow.
Documents then find their place by their rank among those of equal remainder.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.bpe import Bounded
from gleaner.llm.common import hold, per_row, table, vocabulary, with_rank
from gleaner.scratch import materialize

WINDOW, END = 4096, 2


#: Words of one generation of the memo; two generations live at a time, some 200 bytes a word.
WORDS = 300_000
#: Words of these characters alone are split here; all others go to the tokenizer library as they are.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_names() -> dict[int, int]:
    """The printable stand-ins of all bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class WordIds:
    """Ids of whole texts, as the tokenizer library gives them, little-endian; memoized by word.

    Text between ASCII white space is encoded on its own, which is exact for vocabularies whose pieces never hold
    white space. Plain words skip the library's normalizer and go straight to its merges.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.model = self.t.model.tokenize
        self.names = _byte_names()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.piece = Bounded(self._piece)
        self.memo = Bounded(self._one, WORDS)
        self.marks = {c: self._piece(chr(c)) for c in b".,;:!?"}
        probe = "One  two,\nthree's\t4 <|x|> \r\nß. Été token=\"a1B2\" -- n°5"
        if self.ids(probe) != np.asarray(self.t.encode(probe, add_special_tokens=False).ids, "<u4").tobytes():
            raise ValueError("this tokenizer isn't of the kind that is encoded here")

    def _piece(self, piece: str) -> bytes:
        s = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.names)
        return array("I", [t.id for t in self.model(s)]).tobytes()

    def _one(self, word: bytes) -> bytes:
        # a letter before a last mark, and ASCII capitals, change nothing but the memo's key
        if word[-1] in b".,;:!?" and word[-2:-1].isalpha():
            return self.memo[word[:-1]] + self.marks[word[-1]]
        if word.isalpha() and not word.islower():
            return self.memo[word.lower()]
        s = word.decode("utf-8", "replace")
        if not _PLAIN.fullmatch(s) or ("<|" in s and any(t in s for t in self.special)):
            return np.asarray(self.t.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        s = s.lower()
        if s.isalpha():
            return self._piece(s)
        piece = self.piece
        return b"".join([piece[p] if len(p) < 64 else self._piece(p) for p in _PIECES.findall(s)])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        memo = self.memo
        return b"".join([memo[w] if len(w) < 64 else self._one(w) for w in text.encode("utf-8", "replace").split()])


def fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of available lengths whose sum comes closest to ``capacity`` from below.

    Bit t of the set says that some multiset sums to t. The sets before each length are kept, so that the counts
    can be read off backwards.
    """
    mask, bits, trail = (1 << (capacity + 1)) - 1, 1, []
    for n in lengths:
        if n > capacity or not counts[n]:
            continue
        before, left, k = bits, min(counts[n], capacity // n), 1
        while left:  # doubling: k, 2k, 4k, ... copies reach every number up to the limit
            k = min(k, left)
            bits |= (bits << (n * k)) & mask
            left, k = left - k, 2 * k
        trail.append((n, before))
        if bits >> capacity & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for n, before in reversed(trail):
        k = 0
        while not before >> at & 1:
            k, at = k + 1, at - n
        if k:
            used[n] = k
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Segments (length, first rank, past-the-end rank, first sequence, uses a window, offset in it) and the windows."""
    counts, placed, segments, windows = dict(counts), {n: 0 for n in counts}, [], 0
    lengths = sorted(counts, reverse=True)
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        used = fill(lengths, counts, window - top)
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            segments.append((n, placed[n], placed[n] + times * k, windows, k, offset))
            placed[n] += times * k
            counts[n] -= times * k
            offset += n * k
        windows += times
        lengths = [n for n in lengths if counts[n]]
    return segments, windows


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document, and in which sequence at which offset.

    Every id lies in exactly one piece. Null and empty texts consist of the end id alone. Repeated ids and rows are
    packed as often as they occur; columns other than the two named are not looked at. An empty table packs nothing.
    """
    spark, key = docs.sparkSession, ("words", path)

    def make():
        enc, stop = hold(key, lambda: WordIds(path)), np.asarray([end], "<u4").tobytes()
        step = 4 * window

        def work(texts):
            n, crcs, ids = [], [], []
            for t in texts:
                b = enc.ids(t) + stop
                n.append(len(b) // 4)
                crcs.append([zlib.crc32(b[i : i + step]) for i in range(0, len(b), step)])
                if with_ids:
                    ids.append(b)
            return (n, crcs, ids) if with_ids else (n, crcs)

        return work

    slim = docs.select(F.col(id_col).alias("doc_id"), text).withColumn("pid", F.spark_partition_id())
    cut = per_row(slim, ["doc_id", "pid"], text, "doc_tokens long, crcs array<long>" + ", ids binary" * with_ids, make, held=key)
    cut = materialize(cut.withColumn("uid", F.monotonically_increasing_id()), "cut")
    cut = cut.withColumn("rest", (F.col("doc_tokens") % window).cast("int")).withColumn("full", F.floor(F.col("doc_tokens") / window).cast("long"))
    counts = {r["rest"]: r["n"] for r in cut.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}  # below `window` rows
    segments, windows = plan(counts, window)

    # full windows are numbered after the packed ones: a running total within each input partition, shifted by those before
    per = cut.groupBy("pid").agg(F.sum("full").alias("f"))
    shift = per.select("pid", F.coalesce(F.sum("f").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    inner = Window.partitionBy("pid").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.where("full > 0").withColumn("run", F.coalesce(F.sum("full").over(inner), F.lit(0))).join(shift, "pid")
    whole = whole.select("doc_id", "doc_tokens", "crcs", *["ids"] * with_ids, (F.col("run") + F.col("shift") + windows).alias("base"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("i"))
    whole = whole.select("doc_id", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.element_at("crcs", (F.col("i") + 1).cast("int")).alias("ids_crc32"), "doc_tokens", (F.col("base") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)

    schema = "rest int, lo long, hi long, first long, uses long, at long"
    places = spark.createDataFrame(pd.DataFrame(segments, columns=["rest", "lo", "hi", "first", "uses", "at"]), schema) if segments else spark.createDataFrame([], schema)
    rests = with_rank(cut.where("rest > 0"), ["rest"], [F.col("uid")], "pid")
    # the plan has a bound of its own: a few segments for each of fewer than `window` lengths
    rests = rests.join(F.broadcast(places), "rest").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    r = F.col("rank") - F.col("lo")
    rests = rests.select("doc_id", (F.col("full") * window).alias("start"), F.col("rest").cast("long").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens", (F.col("first") + F.floor(r / F.col("uses"))).cast("long").alias("sequence_id"), (F.col("at") + (r % F.col("uses")) * F.col("rest")).cast("long").alias("offset"), *["ids"] * with_ids)
    out = whole.unionByName(rests)
    if with_ids:  # four little-endian bytes an id
        out = out.withColumn("ids", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))"))
    return out


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
