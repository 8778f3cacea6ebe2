"""From string expressions to asset usage.

Constants and generated accessors form a dictionary that is small beside the code that uses it; it is counted, cut down
to what expressions lead to where it isn't, and resolved where expressions are, from a broadcast copy. All matching between resolved values and assets is joins.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import paths as P
from gleaner.operators import groups, match
from gleaner.scratch import materialize
from gleaner.sources.project import Project
from gleaner.sources.rows import map_rows

EXACT, PARTIAL = "exact", "partial"
#: Occurrences kept with an asset: as many as a finding shows.
SHOWN = 5


@dataclass
class Resolution:
    """Each part is written down when it is first asked for."""

    references: DataFrame
    parts: dict[str, DataFrame]

    def _part(self, name: str) -> DataFrame:
        return materialize(self.parts[name], name)

    dynamic = cached_property(lambda self: self._part("dynamic"))
    unresolvable = cached_property(lambda self: self._part("unresolvable"))
    unmatched = cached_property(lambda self: self._part("unmatched"))
    usage = cached_property(lambda self: self._part("usage"))


class Names:
    """Resolves expressions and dotted names; results are (exact, None), (None, segments) or (None, None)."""

    def __init__(self, constants: dict, members: dict, fallback: dict):
        self.constants, self.members, self.fallback = constants, members, fallback
        self.known: dict = {}
        self.open: set = set()
        self.generated: set = set()

    def resolve(self, e):
        kind = e[0]
        if kind == "lit":
            return e[1], None
        if kind == "ref":
            return self.name(e[1])
        if kind == "seq":
            return self.sequence(e[1])
        return None, None

    def sequence(self, parts):
        segments, text, whole = [], "", True
        for part in parts:
            exact, inner = (None, None) if part is None else self.resolve(part)
            if exact is not None:
                text += exact
                continue
            whole = False
            if text:
                segments.append(text)
                text = ""
            segments += inner or []
        if whole:
            return text, None
        if text:
            segments.append(text)
        return None, segments or None

    def name(self, n: str):
        if n in self.known:
            return self.known[n]
        g = self.accessor(n)
        if g is not None:
            self.generated.add(n)
            self.known[n] = (g, None)
            return self.known[n]
        e = self.constants.get(n)
        if e is None or n in self.open:
            return None, None
        self.open.add(n)
        out = self.resolve(e if isinstance(e, list) else json.loads(e))
        self.open.discard(n)
        self.known[n] = out
        return out

    def accessor(self, dotted: str) -> str | None:
        parts = dotted.split(".")
        if len(parts) < 2:
            return None
        owner = parts[0]
        for p in parts[1:]:
            value = self.members.get((owner, p))
            if value is None:
                break
            if value[0] == "lit":
                return value[1]
            if value[0] != "class":
                break
            owner = value[1]
        for end in [len(parts), *range(len(parts) - 1, 1, -1)]:
            hit = self.fallback.get(".".join(parts[:end]))
            if hit is not None:
                return hit
        return None


def fallback_accessors(assets: DataFrame) -> DataFrame:
    """(accessor, package_path): the names that generated code would give each asset; the last asset keeps a name."""
    parts = F.split("package_path", "/")
    bare = F.when(F.get(parts, 0) == "assets", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    a = assets.where("variant_of is null").select("path", "package_path", F.explode(F.array(bare, parts)).alias("p")).where(F.size("p") > 0)
    last = F.element_at("p", -1)
    stem = F.when(P.extension(last) != "", F.regexp_replace(last, r"(?s)\.[^.]*$", "")).otherwise(last)
    ext = F.regexp_replace(F.regexp_extract(last, r"(?s)^.+(\.[^.]*)$", 1), r"^\.", "")
    dirs = F.transform(F.slice("p", 1, F.size("p") - 1), lambda d: P.camel_case(d))
    # chains are joined by dots; a lone ending keeps its own
    base = F.concat(F.array(F.lit("Assets")), dirs)
    name = lambda leaf: F.array_join(F.concat(base, F.array(P.camel_case(leaf))), ".")
    forms = a.select("path", "package_path", F.explode(F.array(name(stem), name(F.concat(stem, F.lit("_"), ext)))).alias("accessor"))
    return groups.last_wins(forms, ["accessor"], "package_path", "path")





#: Names that are taken as they are, and that a dictionary may hold at all: it is broadcast.
SMALL, MOST = 200_000, 2_000_000
_REF = r'\["ref", ?"((?:[^"\\]|\\.)*)"'


def _dictionary(project: Project, roots: DataFrame) -> tuple[dict, dict, dict]:
    """Constants, accessors and fallback names: one row for each name, last and first definitions by their order.

    ``roots`` (expr) are the expressions to resolve. Where there are many names, those that no expression leads to stay out.
    """
    src = project.source
    constants = groups.last_wins(src.where("kind = 'constant'"), ["name"], "expr", "ord")
    members = src.where("kind = 'member'").groupBy("owner", "name").agg(F.min_by("expr", "ord").alias("expr"))
    fallback = fallback_accessors(project.assets)
    if src.where("kind in ('constant', 'member')").count() + 4 * project.assets.count() > SMALL:
        constants, members, fallback = (materialize(t, "dictionary") for t in _needed(roots, constants, members, fallback))
        n = constants.count() + members.count() + fallback.count()
        if n > MOST:
            raise RuntimeError(f"expressions lead to {n} names; more than {MOST} can't be resolved at once")
    columns = lambda df: [c.to_pylist() for c in df.toArrow().columns]
    owners, names, exprs = columns(members.select("owner", "name", "expr"))
    return (
        dict(zip(*columns(constants.select("name", "expr")))),
        {(o, n): json.loads(e) for o, n, e in zip(owners, names, exprs)},
        dict(zip(*columns(fallback.select("accessor", "package_path")))),
    )


def _needed(roots: DataFrame, constants: DataFrame, members: DataFrame, fallback: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The entries that the expressions' names lead to: constants by constants, members and accessors by parts of names."""
    refs = lambda df: df.select(F.explode(F.regexp_extract_all("expr", F.lit(_REF), F.lit(1))).alias("name")).distinct()
    constants = materialize(constants, "constants")
    known = fresh = materialize(refs(roots), "names")
    while fresh.limit(1).count():  # as often as constants are made of constants
        fresh = materialize(match.absent(refs(constants.join(fresh, "name", "left_semi")), known, ["name"]), "names")
        known = known.unionByName(fresh)
    parts = F.split("name", r"\.")
    heads = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("accessor")).distinct()
    leaves = known.select(F.explode(parts).alias("name")).distinct()
    return constants.join(known, "name", "left_semi"), members.join(leaves, "name", "left_semi"), fallback.join(heads, "accessor", "left_semi")


def resolve(project: Project) -> Resolution:
    spark, config, src, assets = project.assets.sparkSession, project.config, project.source, project.assets
    occ = F.struct("file", "line", "column", "snippet").alias("occ")
    none = F.lit(None).cast("string")
    candidates = src.where("kind = 'candidate'").select(F.lit(1).alias("stage"), F.col("ord"), "package", "explicit_package", "how", none.alias("via"), "load", F.when(F.col("load"), F.col("snippet")).alias("source"), occ, "expr")
    first = src.where("kind = 'use'").groupBy("name").agg(F.min("ord").alias("first"))
    # the cap is for the whole project: a file already stops at as many uses of a name
    uses = groups.capped(src.where("kind = 'use'"), ["name"], ["ord"], 20).join(first, "name")
    uses = uses.select(F.lit(2).alias("stage"), F.col("first").alias("ord"), none.alias("package"), none.alias("explicit_package"), F.lit("constant").alias("how"), F.col("name").alias("via"), F.lit(False).alias("load"), none.alias("source"), occ, F.to_json(F.array(F.lit("ref"), F.col("name"))).alias("expr"))
    calls = src.where("kind = 'call'").select(F.col("name").alias("fn"), F.col("expr").alias("arguments"))
    pending = src.where("kind = 'pending'").select(F.col("ord"), "package", F.col("name").alias("fn"), "parameter", "index", F.col("snippet").alias("source"), occ)
    sites = pending.join(calls, "fn", "left")

    def make_names():
        n = Names(*names.value)

        def run(r: dict):
            e = r.pop("expr")
            r["exact"], r["segments"] = n.resolve(json.loads(e)) if e else (None, None)
            if r["stage"] == 2 and r["via"] in n.generated:
                r["how"] = "flutterGen"
            yield r

        return run

    occ_type = "struct<file:string,line:int,column:int,snippet:string>"
    # the argument that a call site passes for the awaited parameter
    argument = F.get(F.from_json("arguments", "array<string>"), F.col("index"))
    cut = sites.select(F.lit(3).alias("stage"), "ord", "package", none.alias("explicit_package"), F.lit("constant").alias("how"), F.concat("fn", F.lit("("), "parameter", F.lit(")")).alias("via"), F.lit(False).alias("load"), "source", "occ", argument.alias("expr"))
    everything = candidates.unionByName(uses).unionByName(cut).withColumn("occ", F.to_json("occ"))
    names = spark.sparkContext.broadcast(_dictionary(project, everything.select("expr")))
    schema = "stage int, ord long, package string, explicit_package string, how string, via string, load boolean, source string, occ string, exact string, segments array<string>"
    resolved = map_rows(everything, make_names, schema).withColumn("occ", F.from_json("occ", occ_type))
    resolved = materialize(resolved.withColumn("ref", F.monotonically_increasing_id()), "resolved")

    unknown = resolved.where("exact is null and segments is null")
    runtime = F.lit("The path is computed at run time and traces back to no literal or directory.")
    lost = unknown.where("load").select("stage", "ord", F.coalesce("source", F.lit("<expression>")).alias("expression"), "occ", runtime.alias("reason"))
    met = resolved.where("stage = 3 and (exact is not null or segments is not null)").select("ord").distinct()
    unmet = match.absent(pending, met, ["ord"])
    why = F.concat(F.lit("`"), "parameter", F.lit("` is a parameter of `"), "fn", F.lit("` and no call site passes a value that can be traced."))
    unresolvable = lost.unionByName(unmet.select(F.lit(3).alias("stage"), "ord", F.col("source").alias("expression"), "occ", why.alias("reason")))

    # exact values
    native = _native(project)
    exact = resolved.where("exact is not null").select("ref", "stage", "ord", "package", "explicit_package", "how", "via", F.col("exact").alias("value"), "occ")
    exact = materialize(exact.unionByName(native).withColumn("norm", P.normalize_asset_path("value")), "exact")
    pack = P.package_reference("norm")
    key = lambda a, b: F.concat_ws("\x00", a, b)
    other = F.when(pack.isNull(), F.col("norm"))
    target = assets.select("path", F.col("package").alias("owner"), "package_path")
    tiers = [
        (F.when(pack.isNotNull(), key(pack["package"], pack["rest"])), key("owner", "package_path")),
        (F.when(F.col("explicit_package").isNotNull() & other.isNotNull(), key("explicit_package", other)), key("owner", "package_path")),
        (F.when(F.col("package").isNotNull() & other.isNotNull(), key("package", other)), key("owner", "package_path")),
        (other, F.col("package_path")),
        (other, F.col("path")),
    ]
    hits = materialize(match.match_cascade(exact, target, "ref", tiers, ["path"]).select("ref", "path"), "hits")
    matched = exact.join(hits.select("ref").distinct(), "ref", "left_semi")
    shaped = P.looks_like_asset_path("value")
    roots = _directories(assets).select(F.split("dir", "/")[0].alias("first")).union(spark.createDataFrame([("assets",), ("fonts",)], "first string")).distinct()
    unmatched = exact.where("stage < 4").join(hits.select("ref").distinct(), "ref", "left_anti").where(shaped).withColumn("first", F.split("value", "/")[0]).join(roots, "first", "left_semi").drop("first")
    used = exact.join(hits, "ref").select("path", "stage", "ord", "occ", F.lit(groups.USED).alias("status"))

    # partial values: a directory pins them, or else a file's name
    partial = resolved.where("segments is not null")
    seg = partial.select("ref", F.explode("segments").alias("s")).withColumn("s", P.normalize_asset_path("s"))
    pinned = match.longest_directory(seg, "ref", "s", _directories(assets), "dir", "i").withColumnRenamed("dir", "prefix")
    pinned = materialize(pinned, "pinned")
    names_ = assets.select("path", P.basename("path").alias("base"))
    loose = seg.join(pinned.select("ref"), "ref", "left_anti").select("ref", P.basename("s").alias("base")).where(F.col("base").contains(".")).distinct()
    by_name = loose.join(names_.select("base").distinct(), "base", "left_semi")
    raw = F.coalesce("source", F.array_join("segments", "${…}"))
    pins = pinned.select("ref", "prefix").unionByName(by_name.select("ref").distinct().withColumn("prefix", F.lit("")))
    dynamic = partial.join(pins, "ref").select("stage", "ord", "prefix", raw.alias("raw"), "occ", "via", "ref")
    # a mark's reach: whole paths, or what all assets below a directory or of a name share
    marks = [(used, None)]
    if config.treat_dynamic_as_used:
        at = partial.select("ref", "stage", "ord", "occ", F.lit(groups.POSSIBLY).alias("status"))
        marks.append((pinned.join(at, "ref").withColumnRenamed("prefix", "key").drop("ref"), _ancestors(assets).withColumnRenamed("dir", "key")))
        marks.append((by_name.join(at, "ref").withColumnRenamed("base", "key").drop("ref"), names_.withColumnRenamed("base", "key")))
    if config.treat_unresolvable_as_wildcard:
        one = unresolvable.agg(F.min_by("occ", F.struct("stage", "ord")).alias("occ")).where("occ is not null")
        marks.append((assets.select("path").crossJoin(one).select("path", F.lit(5).alias("stage"), F.lit(0).cast("long").alias("ord"), "occ", F.lit(groups.POSSIBLY).alias("status")), None))
    usage = groups.merge_usage(_first_marks(marks), ["path"], "status", "occ", "at")
    full = groups.lookup_usage(assets, usage.withColumn("occurrences", F.slice("occurrences", 1, SHOWN)), ["path"])
    full = groups.propagate_variants(full).withColumn("occurrences", F.coalesce("occurrences", F.expr(f"cast(array() as array<{occ_type}>)")))
    references = matched.unionByName(unmatched.select(matched.columns))
    return Resolution(references, {"dynamic": dynamic, "unresolvable": unresolvable, "unmatched": unmatched, "usage": full})


def _first_marks(marks: list[tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """The first ``SHOWN`` marks of each path and status, of marks on paths and of marks on keys with the paths of each key.

    All paths of a key share its marks, so these are cut to the first ones before they meet the paths: a directory of n
    assets that m references reach costs n + m rows, not n times m.
    """
    order = ["stage", "ord", "occ"]
    out = []
    for rows, paths in marks:
        if paths is not None:
            rows = groups.capped(rows, ["key", "status"], order, SHOWN).join(paths, "key")
        out.append(rows.select("path", "stage", "ord", "occ", "status"))
    all_ = out[0]
    for o in out[1:]:
        all_ = all_.unionByName(o)
    return groups.capped(all_, ["path", "status"], order, SHOWN).withColumn("at", F.struct("stage", "ord"))


def _directories(assets: DataFrame) -> DataFrame:
    """(dir, i): every directory above an asset, by either path, with what orders it: its first asset, the longer first."""
    first = _ancestors(assets).groupBy("dir").agg(F.min("path").alias("path"))
    return first.select("dir", F.struct("path", (-F.length("dir")).alias("n"), F.col("dir").alias("d")).alias("i"))


def _ancestors(assets: DataFrame) -> DataFrame:
    both = F.array_union(P.ancestors("path"), P.ancestors("package_path"))
    return assets.select("path", F.explode(both).alias("dir"))


def _native(project: Project) -> DataFrame:
    """References from platform text: the whole path where it is one, else every asset of that name."""
    assets = project.assets
    direct = groups.first_wins(assets, ["package_path"], ["path"]).select(F.col("package_path").alias("token"), F.col("path").alias("hit"), F.col("package_path").alias("value"))
    t = project.native
    whole = t.join(direct, "token").select("file", "ord", "i", "raw", "hit", "value")
    rest = t.join(direct, "token", "left_anti").withColumn("base", P.basename("token"))
    named = rest.join(assets.select(P.basename("path").alias("base"), F.col("path").alias("hit"), F.col("package_path").alias("value")), "base").select("file", "ord", "i", "raw", "hit", "value")
    once = groups.first_wins(whole.unionByName(named), ["hit", "file"], ["ord", "i"])
    none = F.lit(None).cast("string")
    occ = F.struct("file", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.col("raw").alias("snippet"))
    order = (F.col("ord") * 1_000_000 + F.col("i")).cast("long")
    return once.select((-1 - F.monotonically_increasing_id()).alias("ref"), F.lit(4).alias("stage"), order.alias("ord"), none.alias("package"), none.alias("explicit_package"), F.lit("native").alias("how"), none.alias("via"), "value", occ.alias("occ"))

