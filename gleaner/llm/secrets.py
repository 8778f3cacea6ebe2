"""Secret scans: patterns, and character Markov models that tell random strings from ordinary identifiers.

Two first-order Markov chains over character classes are estimated from labelled samples, one from random strings and
one from ordinary identifiers and words. The mean log-likelihood ratio of a token's transitions decides. All of it,
training included, is DataFrame operations: transitions are counted by a group-by, and a token's score is a fold over
its characters into a literal table of integer weights.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import packed, table, unpacked

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
#: What the models judge: runs of these characters, of this length at least.
CANDIDATE, SHORTEST = r"[A-Za-z0-9+/_=-]+", 20
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST
#: Assignments with a value long enough; wherever ASSIGN finds such a one, this does too.
LONG_ASSIGN = ASSIGN.replace("+)", "{12,})")
#: Characters of the models: each letter and digit, and one for all others.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
WIDTH = len(ALPHABET) + 1
#: Weights are natural logarithms times SCALE, rounded: sums are exact. A token with a letter counts as random where its
#: mean transition favours the random model by this many hundredths of a nat; without a digit it takes the second.
SCALE, MARGIN, LETTERS_MARGIN = 1000, 40, 60

_WORDS = """the of and to in is for that with this from are be was were by on not have has had but they which you all their
an will would there what about when who make can time just him know take people into year your good some could them see other
than then now look only come its over think also back after use two how our work first well way even new want because any these
give day most us get value index count name type list item data user path file size config default request response handler
buffer string number object array length result error message status table column schema query session token password secret
key client server service update create delete insert select order group window parse format render load save read write open
close start stop begin end next previous left right width height color style button label image source target version build
der die das und ist nicht mit ein eine auf den von sich auch werden haben oder nach wird bei einer schule zeit jahr leben
le la les des une est pour dans que qui sur pas plus avec tout faire comme mais nous vous leur bien sans temps annee maison
el los las una por con para como mas pero sus este esta todo cuando sobre entre hasta desde donde tiempo casa mundo ciudad
tion ing ment keit lich heit schaft ungen able ness less ieren eaux elle oire cion idad mente aire""".split()


def labelled_samples(n: int = 3000, seed: int = 17) -> list[tuple[str, bool]]:
    """``n`` random strings and ``n`` ordinary identifiers, the same on every run."""
    r = random.Random(seed)
    kinds = ["0123456789abcdef", ALPHABET, ALPHABET + "+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET + "_-"]
    out = [("".join(r.choice(kinds[i % len(kinds)]) for _ in range(r.randint(20, 48))), True) for i in range(n)]
    for i in range(n):
        words = [r.choice(_WORDS) for _ in range(r.randint(3, 7))]
        shape = i % 6
        if shape == 0:
            w = words[0] + "".join(x.title() for x in words[1:])
        elif shape == 1:
            w = "_".join(words)
        elif shape == 2:
            w = "-".join(words) + str(r.choice(["", r.randint(0, 99)]))
        elif shape == 3:
            w = "".join(words)
        elif shape == 4:
            w = "_".join(x.upper() for x in words)
        else:
            w = "/".join(words) + r.choice(["", "/v1", "/v2", "/2024", "/index_01"])
        out.append((w, False))
    return out


def sample_table(spark: SparkSession) -> DataFrame:
    """``labelled_samples`` as (value, is_secret), from literals: nothing but the JVM takes part."""
    rows = labelled_samples()
    text = {y: "\n".join(v for v, label in rows if label == y) for y in (True, False)}
    halves = [spark.range(1).select(F.explode(F.split(F.lit(t), "\n")).alias("value"), F.lit(y).alias("is_secret")) for y, t in text.items()]
    return halves[0].union(halves[1])


def weights(samples: DataFrame, value: str = "value", label: str = "is_secret") -> list[int]:
    """The integer log-likelihood ratios of all WIDTH * WIDTH transitions, add-one smoothed.

    ``samples`` are labelled rows; null values and labels are left out. Without any the weights are all zero.
    """
    s = samples.where(F.col(value).isNotNull() & F.col(label).isNotNull() & (F.length(value) > 1))
    steps = s.select(F.col(label).alias("y"), F.explode(F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substring(F.col(value), i, F.lit(2)))).alias("t"))
    coded = steps.select("y", (F.instr(F.lit(ALPHABET), F.col("t").substr(1, 1)) * WIDTH + F.instr(F.lit(ALPHABET), F.col("t").substr(2, 1))).alias("k"))
    counts = {(r["y"], r["k"]): r["n"] for r in coded.groupBy("y", "k").agg(F.count("*").alias("n")).collect()}  # 2 * WIDTH^2 rows at most
    return _ratios(counts)


def _ratios(counts: dict[tuple[bool, int], int]) -> list[int]:
    """Counts of transitions by label to scaled log-likelihood ratios."""
    rows = {y: [sum(counts.get((y, a * WIDTH + b), 0) for b in range(WIDTH)) for a in range(WIDTH)] for y in (True, False)}

    def log_p(y: bool, a: int, b: int) -> float:
        return math.log((counts.get((y, a * WIDTH + b), 0) + 0.5) / (rows[y][a] + 0.5 * WIDTH))

    return [round(SCALE * (log_p(True, a, b) - log_p(False, a, b))) if counts else 0 for a in range(WIDTH) for b in range(WIDTH)]


def _score(token: Column, table_: Column) -> Column:
    """The summed weights of a token's transitions."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.lit(0).alias("sum"), F.element_at(codes, 1).alias("at"))
    fold = F.aggregate(F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), start, lambda s, c: F.struct((s["sum"] + F.get(table_, s["at"] * WIDTH + c)).alias("sum"), c.alias("at")))
    return fold["sum"]


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or running anything associative, of an array of longs: log n rounds over the whole array."""

    def one(acc: Column, k: Column) -> Column:
        back = F.slice(F.concat(F.array_repeat(F.lit(None).cast("long"), F.pow(F.lit(2.0), k).cast("int")), acc), 1, F.size(acc))
        return F.zip_with(acc, back, lambda x, y: F.when(y.isNull(), x).otherwise(op(x, y)))

    rounds = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)
    return _let(values, lambda v: F.when(F.size(v) > 1, F.aggregate(rounds(v), v, one)).otherwise(v))


def _matches(text: Column, pattern: str, kind: str, measured: int, least: int) -> Column:
    """The leftmost non-overlapping matches as structs (start, k, end, value), those with a short group dropped.

    Regular expressions here tell no positions, but the pieces between the matches do: a match ends where the running
    sum of the pieces and matches up to it says.
    """
    order = {"assign": 0, "access": 1, "hex": 2, "markov": 3}[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(measured)) if measured else whole
    gaps = F.split(text, pattern, -1)

    def placed(w: Column) -> Column:
        ends = _running(F.zip_with(w, F.slice(gaps, 1, F.size(w)), lambda m, gap: (F.length(gap) + F.length(m)).cast("long")), lambda x, y: x + y)
        spans = F.zip_with(w, ends, lambda m, e: F.struct((e - F.length(m)).cast("int").alias("start"), F.lit(order).alias("k"), e.cast("int").alias("end"), m.alias("value")))
        if not measured:
            return F.filter(spans, lambda s: F.length(s["value"]) >= least)
        both = F.filter(F.zip_with(spans, group, lambda s, g: F.struct(s.alias("s"), (F.length(g) >= least).alias("ok"))), lambda x: x["ok"])
        return F.transform(both, lambda x: x["s"])

    empty = F.expr("cast(array() as array<struct<start:int,k:int,end:int,value:string>>)")
    return F.when(text.rlike(pattern), _let(whole, placed)).otherwise(empty)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _looks_random(value: Column, model: Column) -> Column:
    """Whether the models take a token for random, by the mean of its transitions; tokens without a digit need more."""
    least = F.when(value.rlike("[0-9]"), F.lit(MARGIN)).otherwise(F.lit(LETTERS_MARGIN))
    return value.rlike("[A-Za-z]") & (_score(value, model) * 100 > least * SCALE * (F.length(value) - 1))


def _outside(spans: Column) -> Column:
    """Sorted spans without those of the models that lie wholly inside another span: these add nothing."""
    reach = _running(F.transform(spans, lambda s: F.when(s["k"] < 3, s["end"]).otherwise(0).cast("long")), lambda x, y: F.greatest(x, y))
    kept = F.filter(F.zip_with(spans, reach, lambda s, r: F.struct(s.alias("s"), ((s["k"] < 3) | (r < s["end"])).alias("ok"))), lambda x: x["ok"])
    return F.transform(kept, lambda x: x["s"])


def scan(docs: DataFrame, samples: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Append ``found``: all spans of each text as array<struct<start, k, end, value>>, sorted.

    k is 0 for assignments, 1 for access keys, 2 for hexadecimal runs and 3 for what the models add: whole tokens that
    look random and don't lie inside another span. ``samples`` are labelled rows (value, is_secret) that the models
    are trained on; without them it is the built-in ones. Offsets are code points, ends exclusive. Null and empty texts
    have no spans. A very long text is one row, and the work grows with its length and the number of its spans. Rows are
    independent, so repeated rows repeat their spans; other columns stay as they are whatever their names, except that
    a column ``found`` is replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = F.lit(weights(sample_table(spark) if samples is None else samples))
    df = packed(docs, text)
    t = F.coalesce(F.col("_text"), F.lit(""))
    hexes = r"[0-9a-f]{16,}"  # the long matches of [0-9a-f]+ are its maximal runs, so the length may be asked for at once
    base = F.concat(_matches(t, ASSIGN, "assign", 2, 12), _matches(t, r"AKIA[A-Z0-9]{14,}", "access", 0, 18), _matches(t, hexes, "hex", 0, 16))
    judged = F.filter(_matches(t, TOKEN, "markov", 0, SHORTEST), lambda m: _looks_random(m["value"], model))
    df = df.withColumn("_base", base).withColumn("_more", judged)
    all_ = F.when(F.size("_more") > 0, _let(F.array_sort(F.concat("_base", "_more")), _outside)).otherwise(F.array_sort("_base"))
    cols = [c for n, c in zip(docs.columns, unpacked(docs, text)) if n != "found"]
    return df.withColumn("_found", all_).select(*cols, F.col("_found").alias("found"))


def _names(spans: Column) -> Column:
    names = F.array(F.lit("assign"), F.lit("access"), F.lit("hex"), F.lit("markov"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, samples: DataFrame | None = None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret replaced by ``mark``.

    Whatever ``scan`` finds goes: assignments first, then whole tokens that look random, then access keys and
    hexadecimal runs in what is left. The text is put together again from the pieces around the tokens, in one pass.
    Null and empty texts stay as they are; ties, repeated rows and other columns need no care.
    """
    model = F.lit(weights(sample_table(docs.sparkSession) if samples is None else samples))
    plain = mark.replace("\\", r"\\").replace("$", r"\$")
    t = F.regexp_replace(F.col("_text"), LONG_ASSIGN, plain)
    fresh = lambda w: F.when(_looks_random(w, model), F.lit(mark)).otherwise(w)
    joined = lambda s: F.array_join(F.zip_with(F.split(s, TOKEN, -1), F.transform(F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)), fresh), lambda gap, w: F.concat(gap, F.coalesce(w, F.lit("")))), "")
    tokens = _let(t, lambda s: F.when(s.rlike(TOKEN), joined(s)).otherwise(s))
    clean = F.regexp_replace(tokens, r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", plain)
    return packed(docs, text).withColumn("_clean", clean).select(*unpacked(docs, text, "_clean"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("found", lambda s: s["k"] == k)).cast("long")
    base = F.filter("found", lambda s: s["k"] < 3)
    return df.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_names(base), 256).alias("base_sha256"), _names(F.col("found")).alias("spans"))


def oracle() -> str:
    """The query in SQL, with the weights of the built-in samples written out."""
    counts: dict[tuple[bool, int], int] = {}
    for v, y in labelled_samples():
        c = [ALPHABET.find(x) + 1 for x in v]
        for a, b in zip(c, c[1:]):
            counts[y, a * WIDTH + b] = counts.get((y, a * WIDTH + b), 0) + 1
    patterns = [(ASSIGN.replace("'", "''"), 2, 12), (ACCESS, 0, 18), (HEX, 0, 16), (CANDIDATE, 0, SHORTEST)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, {least} AS least, regexp_extract_all(t, '{p}') AS w, regexp_extract_all(t, '{p}', {g}) AS g, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')"
        for k, (p, g, least) in enumerate(patterns)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
e AS (SELECT doc_id, k, least, unnest(w) AS w, unnest(g) AS g, unnest(gaps[1:len(w)]) AS gap, unnest(range(1, len(w) + 1)) AS i FROM m),
p AS (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id, k ORDER BY i) AS fin FROM e),
s AS (SELECT doc_id, k, CAST(fin - length(w) AS BIGINT) AS a, CAST(fin AS BIGINT) AS b, w FROM p WHERE length(g) >= least),
l AS (SELECT {_ratios(counts)} AS l),
r AS (SELECT s.* FROM s, l WHERE k = 3 AND regexp_matches(w, '[A-Za-z]')
  AND list_sum(list_transform(range(1, length(w)), lambda i: l[strpos('{ALPHABET}', w[i]) * {WIDTH} + strpos('{ALPHABET}', w[i + 1]) + 1])) * 100
    > CASE WHEN regexp_matches(w, '[0-9]') THEN {MARGIN} ELSE {LETTERS_MARGIN} END * {SCALE} * (length(w) - 1)
  AND NOT EXISTS (SELECT 1 FROM s x WHERE x.doc_id = s.doc_id AND x.k < 3 AND x.a <= s.a AND s.b <= x.b)),
u AS (SELECT doc_id, k, a, b, ['assign', 'access', 'hex', 'markov'][k + 1] || ':' || a || ':' || b AS name FROM (SELECT * FROM s WHERE k < 3 UNION ALL SELECT * FROM r))
SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  sha256(coalesce(string_agg(name, ',' ORDER BY a, k) FILTER (WHERE k < 3), '')) AS base_sha256, coalesce(string_agg(name, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN u ON u.doc_id = d.doc_id GROUP BY d.doc_id
"""
