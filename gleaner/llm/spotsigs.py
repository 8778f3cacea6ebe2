"""Document fingerprints by SpotSigs, in DataFrame operations only.

Wherever a common word occurs as a word of its own, the chain of the two content words that follow it (further
common words are passed over) forms a signature. As a supplement to SpotSigs, wherever no common word is among a word and
the STRETCH words after it, that word and the next form a signature too. A fingerprint is the set of a text's signatures. Likeness is the
sets' Jaccard similarity. ``similar_pairs`` compares whole corpora: partitions of near set lengths meet on the rarest
signatures of their members only, and length bounds prune what is left before sets are intersected.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import BROADCAST_BYTES, table
from gleaner.scratch import materialize

#: Common words of English, German, French and Spanish.
COMMON = """the of and to in is that with by for was this are be on as at or it an he she from have has had not but his her
they which their been were will would there der die das und zu den von nicht mit sich ein eine ist im dem auf des als auch
für le la les et du un une que qui dans pour par au sur est ne pas il elle ce avec aux en de el los las se por con para y del
su lo es al como más o""".split()
_STOP = "(?:" + "|".join(sorted(set(COMMON), key=lambda w: (-len(w), w))) + ")"
#: Words without a common word that make a stretch, besides the first.
STRETCH = 4
_COMMON = rf"(?<= )(?={_STOP} )"
#: An anchor, common words being marked, and in look-ahead the two content words after it.
_ANCHOR = r"~([^ ]++)(?= (?:~[^ ]++ )*+([^ ]++) (?:~[^ ]++ )*+([^ ]++) )"
#: A word and in look-ahead the next one. What must not follow is asked first: groups of a failed attempt would stay set.
_PAIR = r"(?![^ ]++ (?:[^ ]++ ){0,%d}~)([^~ ][^ ]*+)(?= ([^~ ][^ ]*+) )" % (STRETCH - 1)
#: Rows of neighbouring ids that one window orders, about.
RUN = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def signatures(text: Column) -> Column:
    """The sorted distinct 32-bit signature hashes of a text, never empty.

    Pairs of neighbouring words stand in where common words are rare (lists, other languages), by what follows each
    word alone, so that an edit changes the signatures around it and no others; a text without chain or pair is a single
    signature. Null is taken as empty. Case, punctuation and the kind of white space don't count.
    """
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    marked = F.regexp_replace(norm, _COMMON, "~")
    found = lambda t: F.filter(F.split(F.regexp_replace(t, f"(?<= )(?:{_ANCHOR}|{_PAIR})", "<$1:$2$4:$3$5"), " ", -1), lambda w: w.startswith("<"))
    hashes = lambda sigs: F.array_sort(F.array_distinct(F.transform(sigs, lambda w: F.hash(w))))
    return _let(marked, lambda t: _let(found(t), lambda sigs: F.when(F.size(sigs) > 0, hashes(sigs)).otherwise(F.array(F.hash(t)))))


def likeness(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _text(s: Column) -> Column:
    return F.array_join(s.cast("array<string>"), ",")


def _runs(docs: DataFrame) -> tuple[Column, int]:
    """A number for each row that grows with doc_id and cuts the ids into runs of about RUN rows each, nulls lowest; and how many follow a knot.

    The knots are 256 quantiles of the ids at most, whatever the rows.
    """
    n, lo, hi = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    if lo is None or lo == hi:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0).cast("long"), 1
    knots = docs.agg(F.percentile_approx("doc_id", [i / 256 for i in range(257)], 20_000)).first()[0]
    knots = sorted({lo, *knots, hi})
    per = max(1, -(-n // (RUN * (len(knots) - 1))))
    edges = F.lit([int(k) for k in knots])
    i = F.greatest(F.size(F.filter(edges, lambda k: k < F.col("doc_id"))), F.lit(1))
    a = F.element_at(edges, i)
    b = F.coalesce(F.try_element_at(edges, i + 1), a + 1)
    within = F.floor((F.col("doc_id") - a) * per / F.greatest(b - a, F.lit(1)))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(i * (per + 1) + F.least(within, F.lit(per))).cast("long"), per + 1


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint and its edited text's, and its likeness to that and to the next document.

    The edited text has the last third of the code points replaced by the first as many of the next document in
    descending order of ids; the last document's next is the first. Rows of equal id follow each other by the CRC of
    their texts, rows without an id come last. Null texts are empty; equal texts, repeated rows included, have equal
    fingerprints. An empty table gives an empty result. A very long text is one row, and the work on it grows with its
    length. All rows of one id are ordered by one task. Columns other than the two named are not looked at.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    run, per = _runs(docs.select("doc_id"))
    tie = F.crc32(F.col("text").cast("binary"))
    # the first row of each run also closes the run above it; the run numbers and their highest ids are one small row each
    heads = docs.select("doc_id", run.alias("run")).groupBy("run").agg(F.max("doc_id").alias("top"))
    # within a knot's runs the next one is the window's; behind the last it is the first run of a later knot, or the very first
    heads = heads.withColumn("knot", F.floor(F.col("run") / per))
    firsts = sorted(r["run"] for r in heads.groupBy("knot").agg(F.min("run").alias("run")).collect())  # a row a knot
    after = F.element_at(F.filter(F.lit(firsts or [0]).cast("array<long>"), lambda v: v > F.col("run")), 1)
    following = F.when(F.col("run") < F.lit(firsts[-1] if firsts else 0), after).otherwise(F.lit(firsts[0] if firsts else 0).cast("long"))
    heads = heads.withColumn("to", F.coalesce(F.lead("run").over(Window.partitionBy("knot").orderBy("run")), following))
    heads = materialize(heads.select(F.col("run").alias("of"), "top", "to"), "heads")
    if heads.count() * 64 <= BROADCAST_BYTES:  # else both sides are shuffled
        heads = F.broadcast(heads)
    own = docs.withColumn("tie", tie).withColumn("run", run)
    first = own.join(heads, (F.col("run") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    first = first.withColumn("i", F.row_number().over(Window.partitionBy("of").orderBy("tie"))).where("i = 1")
    rows = own.select("run", F.lit(0).alias("guest"), "doc_id", "tie", "text").union(first.select("to", F.lit(1), "doc_id", "tie", "text"))
    # texts alone travel; signatures are made where they are ordered
    rows = rows.repartition("run").withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("run").orderBy("guest", F.desc_nulls_last("doc_id"), "tie")
    rows = rows.select("guest", "doc_id", "text", "sigs", F.lead("text").over(order).alias("next"), F.lead("sigs").over(order).alias("next_sigs")).where("guest = 0")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next"), F.lit(1), third)).alias("edited"))
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _text(F.col("sigs")).alias("fingerprint"), _text(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def similar_pairs(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (a, b, likeness) of class representatives with likeness of ``percent`` hundredths or more, and nothing else.

    Documents of equal fingerprint form a class, named by its least id; ``classes`` gives the membership. Sets are
    partitioned by length so that only neighbouring partitions can hold similar ones, and meet on the signatures that
    are rarest over all documents: two sets that similar share one of the first n - ceil(percent * n / 100) + 1.
    """
    sets = classes(docs, id_col, text).groupBy("sigs").agg(F.min("doc_id").alias("rep")).withColumn("n", F.size("sigs"))
    every = sets.select("rep", "n", F.explode("sigs").alias("sig"))
    ranked = every.join(every.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    prefix = ranked.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("df", "sig"))).where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    width = F.lit(-math.log(percent / 100))
    cell = F.floor(F.log("n") / width) if percent < 100 else F.col("n")
    left = prefix.select("sig", F.col("rep").alias("a"), F.col("n").alias("na"), cell.alias("cell"))
    right = left.select("sig", F.col("a").alias("b"), F.col("na").alias("nb"), F.explode(F.array(F.col("cell"), F.col("cell") - 1, F.col("cell") + 1)).alias("cell"))
    met = left.join(right, ["sig", "cell"]).where((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b").distinct()
    both = met.join(sets.select(F.col("rep").alias("a"), F.col("sigs").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("sigs").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness"))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sigs): the signature set of each document that has an id."""
    return docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc_id"), signatures(F.col(f"`{text}`")).alias("sigs"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
