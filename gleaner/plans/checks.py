"""The eighteen findings, each a query over the project's tables."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.config import SEVERITIES, AuditConfig
from gleaner.functions import paths as P
from gleaner.functions import similarity, svg
from gleaner.operators import groups, match, similar
from gleaner.operators.cluster import connected_components
from gleaner.plans.resolve import Resolution
from gleaner.scratch import materialize, new_path
from gleaner.sources import images
from gleaner.sources.project import OCC, Project
from gleaner.sources.rows import map_rows

FINDING = f"severity string, code string, message string, path string, occurrences array<{OCC}>, related_paths array<string>, data string, reclaimable_bytes long"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


#: Pixels (height x width x channels) to width, height, d_hash, has_alpha and uses_transparency; null for no picture.
Hasher = Callable[[np.ndarray | None], dict | None]


@dataclass
class Context:
    project: Project
    resolution: Resolution | Callable[[], Resolution]
    config: AuditConfig
    kept: dict = field(default_factory=dict)
    hasher: Hasher = images.fingerprint

    @cached_property
    def usage(self) -> Resolution:
        """What code reaches; resolved when a check first asks for it."""
        return self.resolution() if callable(self.resolution) else self.resolution

    @property
    def assets(self) -> DataFrame:
        """Assets with status and occurrences."""
        return self.usage.usage


def finding(df: DataFrame, severity: str, code: Column | str, message: Column, path: Column | str | None, occurrences: Column = None, related: Column = None, data: dict[str, Column] | None = None, reclaimable: Column = None) -> DataFrame:
    """Rows of ``df`` in the findings' schema. Data keys keep their order; nulls among them stay."""
    data_ = F.to_json(F.struct(*[v.alias(k) for k, v in (data or {}).items()]), {"ignoreNullFields": "false"}) if data else F.lit(None).cast("string")
    return df.select(
        F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), message.alias("message"),
        (F.lit(None).cast("string") if path is None else F.col(path) if isinstance(path, str) else path).alias("path"),
        (_none(OCC) if occurrences is None else occurrences.cast(f"array<{OCC}>")).alias("occurrences"), (_none("string") if related is None else related).alias("related_paths"),
        data_.alias("data"), (F.lit(0).cast("long") if reclaimable is None else reclaimable.cast("long")).alias("reclaimable_bytes"),
    )


def _say(*parts: Column | str) -> Column:
    """Text with columns in it; column names come as ``{name}``."""
    out = []
    for p in parts:
        if isinstance(p, Column):
            out.append(p.cast("string"))
        elif p.startswith("{") and p.endswith("}"):
            out.append(F.col(p[1:-1]).cast("string"))
        else:
            out.append(F.lit(p))
    return F.concat(*out)


#: Bytes of lists that may be broadcast.
LISTS = 48 << 20


def _lookup(df: DataFrame, lists: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` left-joined with a long list for each of few keys. Lists travel to the rows where they are small enough."""
    lists = materialize(lists, "lists")
    size = lists.agg(F.sum(F.length(F.array_join(value, ",")))).first()[0] or 0
    return df.join(F.broadcast(lists) if size <= LISTS else lists, key, "left")


# -- unused


def unused(ctx: Context) -> list[DataFrame]:
    return [unused_assets(ctx), possibly_used(ctx), dynamic_references(ctx), unresolvable(ctx)]


def unused_assets(ctx: Context) -> DataFrame:
    a = ctx.assets
    own = a.where("variant_of is null")
    variants = a.where("variant_of is not null").groupBy(F.col("variant_of").alias("path")).agg(F.sort_array(F.collect_list("path")).alias("variants"), F.sum("size_bytes").alias("variant_bytes"), F.count("*").cast("int").alias("n_variants"))
    dead = own.where(F.col("status") == groups.UNUSED).join(variants, "path", "left")
    total = F.col("size_bytes") + F.coalesce("variant_bytes", F.lit(0))
    data = {"reclaimableBytes": total, "sizeBytes": F.col("size_bytes"), "package": F.col("package"), "declared": F.col("declared_by").isNotNull(), "variantCount": F.coalesce("n_variants", F.lit(0))}
    return finding(dead, "warning", "UNUSED_ASSET", _say("No reference reaches ", "{path}", " (", P.human_bytes("size_bytes"), ")."), "path", related=F.coalesce("variants", _none("string")), data=data, reclaimable=total)


def possibly_used(ctx: Context) -> DataFrame:
    maybe = ctx.assets.where("variant_of is null").where(F.col("status") == groups.POSSIBLY)
    return finding(maybe, "info", "POSSIBLY_USED_ASSET", _say("Dynamic references alone can reach ", "{path}", "; it is never reported as unused and never deleted."), "path", F.slice("occurrences", 1, 5), data={"sizeBytes": F.col("size_bytes"), "package": F.col("package")})


def dynamic_references(ctx: Context) -> DataFrame:
    a, d = ctx.project.assets, ctx.usage.dynamic
    # what lies below a directory is gathered once for all references that it pins
    dirs = d.where("prefix <> ''").select(F.col("prefix").alias("dir")).distinct()
    below = dirs.join(a.select("path", F.explode(F.array_union(P.ancestors("path"), P.ancestors("package_path"))).alias("dir")), "dir")
    below = below.groupBy(F.col("dir").alias("prefix")).agg(F.sort_array(F.collect_set("path")).alias("covered"))
    d = _lookup(d, below, "prefix", "covered").withColumn("covered", F.coalesce("covered", _none("string"))).withColumn("n", F.size("covered"))
    text = F.when(F.col("prefix") == "", _say("Dynamic path `", "{raw}", "` is known by file name only; check that it covers what is meant.")).otherwise(_say("Dynamic path `", "{raw}", "` stays below ", "{prefix}", "/, so the ", "{n}", " file(s) there count as possibly used."))
    return finding(d, "info", "DYNAMIC_REFERENCE", text, F.when(F.col("prefix") != "", F.col("prefix")), F.array("occ"), F.col("covered"), {"prefix": F.col("prefix"), "via": F.col("via"), "coveredCount": F.col("n")})


def unresolvable(ctx: Context) -> DataFrame:
    u = ctx.usage.unresolvable
    return finding(u, "warning", "UNRESOLVABLE_DYNAMIC_REFERENCE", _say("Load `", "{expression}", "` can't be resolved. ", "{reason}", " Look at it by hand: it may reach assets that no audit sees."), None, F.array("occ"), data={"reason": F.col("reason")})


# -- missing


def missing_declared(ctx: Context) -> DataFrame:
    return finding(ctx.project.missing, "error", "MISSING_DECLARED_ASSET", _say("{package}", " declares `", "{raw_entry}", "`, and there is nothing at that path."), "path", F.array("origin"), data={"package": F.col("package"), "entry": F.col("raw_entry"), "kind": F.col("kind")})


def undeclared_reference(ctx: Context) -> DataFrame:
    p = ctx.project
    flutter = p.packages.agg(F.max("is_flutter").alias("any")).where("any")
    first = groups.first_wins(ctx.usage.unmatched, ["value"], ["stage", "ord"]).crossJoin(F.broadcast(flutter))
    bases = p.packages.select(F.col("root")).union(p.packages.sparkSession.createDataFrame([(ctx.config.root,)], "root string")).distinct()
    exists = first.select("value").crossJoin(F.broadcast(bases)).select("value", F.concat("root", F.lit("/"), "value").alias("absolute")).join(p.listing.where("not is_dir").select("absolute"), "absolute", "left_semi").select("value").distinct().withColumn("there", F.lit(True))
    first = first.join(exists, "value", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    text = F.when(F.col("there"), _say("Code names `", "{value}", "`; the file is there but no manifest entry covers it, so the bundle will lack it.")).otherwise(_say("Code names `", "{value}", "`, which is neither on disk nor declared."))
    return finding(first, "error", "UNDECLARED_REFERENCE", text, "value", F.array("occ"), data={"existsOnDisk": F.col("there"), "via": F.col("via")})


def undeclared_on_disk(ctx: Context) -> DataFrame:
    stray = ctx.project.assets.where("variant_of is null and declared_by is null")
    return finding(stray, "warning", "UNDECLARED_ON_DISK", _say("{path}", " lies in an asset directory, yet no manifest entry covers it; it won't ship."), "path", data={"package": F.col("package"), "sizeBytes": F.col("size_bytes")})


def missing(ctx: Context) -> list[DataFrame]:
    return [missing_declared(ctx), undeclared_reference(ctx), undeclared_on_disk(ctx)]


# -- contents

_CONTENT = "path string, sha string, width int, height int, d_hash long, has_alpha boolean, uses_transparency boolean, svg_hash string, path_data string"


def contents(ctx: Context) -> DataFrame:
    """Digest, fingerprint and SVG forms of each asset; what can't be read or decoded is null there."""
    if "contents" in ctx.kept:
        return ctx.kept["contents"]
    most = ctx.config.max_hash_size

    hasher = ctx.hasher

    def make():
        def read(f: dict):
            low = f["path"].lower()
            picture, vector = low.endswith(".png") and f["size_bytes"] <= most, low.endswith(".svg")
            try:
                with open(f["absolute_path"], "rb") as h:
                    if not (picture or vector):  # of any size, so digested as it is read
                        yield {"path": f["path"], "sha": hashlib.file_digest(h, "sha256").hexdigest()}
                        return
                    data = h.read()
            except OSError:
                return
            row = {"path": f["path"], "sha": hashlib.sha256(data).hexdigest()}
            if picture:
                row |= hasher(images.decode_png(data)) or {}
            if vector:
                try:
                    norm = svg.normalize(data.decode("utf-8"))
                except UnicodeDecodeError:
                    norm = None
                if norm is not None:
                    row |= {"svg_hash": hashlib.sha256(norm.encode()).hexdigest(), "path_data": svg.path_data(norm)}
            yield row

        return read

    files = ctx.project.assets.select("absolute_path", "path", "size_bytes")
    found = map_rows(files, make, _CONTENT)
    other = _jvm_images(ctx)
    if other is not None:
        found = found.join(other, "path", "left")
        for c in ("width", "height", "d_hash", "has_alpha", "uses_transparency"):
            found = found.withColumn(c, F.coalesce(c, f"o_{c}")).drop(f"o_{c}")
    ctx.kept["contents"] = materialize(ctx.project.assets.join(found, "path"), "contents")
    return ctx.kept["contents"]


def _jvm_images(ctx: Context) -> DataFrame | None:
    """Fingerprints of JPEG, GIF and BMP files by Spark's image source, which skips names that start with ``_``: copies are read for those."""
    rows = ctx.project.assets.where(P.extension("path").isin(".jpg", ".jpeg", ".gif", ".bmp") & (F.col("size_bytes") <= ctx.config.max_hash_size)).select("absolute_path", "path").collect()  # paths alone
    if not rows:
        return None
    spark = ctx.project.assets.sparkSession
    names = ctx.project.assets.select("absolute_path", "path")
    hidden = [r for r in rows if os.path.basename(r["path"]).startswith("_")]
    seen = [r["absolute_path"].replace(",", "?") for r in rows if not os.path.basename(r["path"]).startswith("_")]
    if hidden:
        folder, jvm_path = new_path(spark, "images"), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        copies = [f"{folder}/{i}{os.path.splitext(r['path'])[1]}" for i, r in enumerate(hidden)]
        for at, r in zip(copies, hidden):
            to = jvm_path(at)
            to.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(jvm_path("file", None, r["absolute_path"]), to)
        seen += copies
        names = names.unionByName(spark.createDataFrame([(re.sub("^file:(//)?", "", at), r["path"]) for at, r in zip(copies, hidden)], "absolute_path string, path string"))
    hasher = ctx.hasher
    pixels = spark.read.format("image").option("dropInvalid", True).load(seen)

    def make():
        def work(r: dict):
            a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
            a = a[:, :, [2, 1, 0, *range(3, a.shape[2])]] if a.shape[2] >= 3 else a
            yield {"absolute_path": re.sub("^file:(//)?", "", r["origin"])} | {f"o_{k}": v for k, v in (hasher(a) or {}).items()}

        return work

    prints = map_rows(pixels.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data"), make, "absolute_path string, o_width int, o_height int, o_d_hash long, o_has_alpha boolean, o_uses_transparency boolean")
    return prints.join(names, "absolute_path").drop("absolute_path")


def duplicates(ctx: Context) -> list[DataFrame]:
    empty = finding(ctx.project.assets.where("size_bytes = 0"), "warning", "EMPTY_FILE", _say("{path}", " holds no bytes."), "path", data={"package": F.col("package")})
    c = contents(ctx).where("size_bytes > 0")
    g = c.groupBy("sha").agg(F.sort_array(F.collect_list("path")).alias("all"), F.min("size_bytes").alias("size")).withColumn("n", F.size("all")).where("n > 1").withColumn("wasted", F.col("size") * (F.col("n") - 1))
    text = _say("{n}", " files hold the same bytes (", P.human_bytes("size"), " each, ", P.human_bytes("wasted"), " wasted).")
    return [empty, finding(g, "warning", "DUPLICATE_ASSETS", text, F.get("all", 0), related=F.slice("all", 2, F.col("n") - 1), data={"sha256": F.col("sha"), "count": F.col("n"), "sizeBytes": F.col("size"), "reclaimableBytes": F.col("wasted")}, reclaimable=F.col("wasted"))]


def _clusters(pairs: DataFrame, members: DataFrame) -> DataFrame:
    return connected_components(pairs, "a", "b").withColumnRenamed("node", "path").join(members, "path")


def similar_assets(ctx: Context) -> list[DataFrame]:
    return [similar_pictures(ctx), similar_svg(ctx)]


def _distinct(ctx: Context) -> DataFrame:
    """One asset of each content, variants left out."""
    return groups.first_wins(contents(ctx).where("variant_of is null"), ["sha"], ["path"])


def similar_pictures(ctx: Context) -> DataFrame:
    t = ctx.config.similarity_threshold
    raster = _distinct(ctx).where("d_hash is not null")
    pairs = similar.hamming_pairs(raster, "path", "d_hash", t)
    m = _clusters(pairs, raster.select("path", "size_bytes", "width", "height", "d_hash"))
    kinds = m.groupBy("component", "d_hash").agg((F.countDistinct("width", "height") > 1).alias("s")).groupBy("component").agg(F.max("s").alias("scaled"))
    dims = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.concat("width", F.lit("x"), "height").alias("d")))))
    g = m.groupBy("component").agg(F.sort_array(F.collect_list("path")).alias("all"), (F.sum("size_bytes") - F.max("size_bytes")).alias("spare"), dims.alias("dims")).join(kinds, "component").withColumn("n", F.size("all"))
    text = F.when(F.col("scaled"), _say("{n}", " files show one image at several pixel sizes; if that is meant, resolution folders such as `2.0x/` let the device choose.")).otherwise(_say("{n}", " images look almost the same (within ", F.lit(t), " of 64 bits)."))
    data = {"count": F.col("n"), "threshold": F.lit(t), "dimensions": F.col("dims"), "reclaimableBytes": F.col("spare")}
    return finding(g, "warning", F.when(F.col("scaled"), "SCALED_VARIANT").otherwise("SIMILAR_ASSETS"), text, F.get("all", 0), related=F.slice("all", 2, F.col("n") - 1), data=data, reclaimable=F.col("spare"))


def similar_svg(ctx: Context) -> DataFrame:
    t = ctx.config.similarity_threshold
    vector = _distinct(ctx).where("svg_hash is not null")
    same = vector.groupBy("svg_hash").agg(F.min("path").alias("rep"))
    star = vector.join(same, "svg_hash").where("path <> rep").select(F.col("rep").alias("a"), F.col("path").alias("b"))
    near = similar.dice_pairs(vector, "path", "path_data", similarity.similarity_ratio(t))
    m = _clusters(star.union(near), vector.select("path", "size_bytes", "svg_hash"))
    g = m.groupBy("component").agg(F.sort_array(F.collect_list("path")).alias("all"), (F.sum("size_bytes") - F.max("size_bytes")).alias("spare"), (F.countDistinct("svg_hash") == 1).alias("equal")).withColumn("n", F.size("all"))
    text = F.when(F.col("equal"), _say("{n}", " SVGs are the same but for ids, comments and blanks.")).otherwise(_say("{n}", " SVGs have almost the same path geometry."))
    return finding(g, "warning", "SIMILAR_SVG", text, F.get("all", 0), related=F.slice("all", 2, F.col("n") - 1), data={"count": F.col("n"), "normalizedIdentical": F.col("equal"), "reclaimableBytes": F.col("spare")}, reclaimable=F.col("spare"))


# -- hygiene


def hygiene(ctx: Context) -> list[DataFrame]:
    return [*file_hygiene(ctx), unused_fonts(ctx), empty_directories(ctx)]


def file_hygiene(ctx: Context) -> list[DataFrame]:
    a, limit = ctx.project.assets, ctx.config.max_file_size_kb
    size = {"sizeBytes": F.col("size_bytes")}
    out = [finding(a.where(F.col("size_bytes") > limit * 1024), "warning", "LARGE_ASSET", _say("{path}", " takes ", P.human_bytes("size_bytes"), f" (limit {limit} KB). A WebP, or a smaller source with `2.0x/` variants, would help."), "path", data=size | {"limitKb": F.lit(limit)})]
    png = contents(ctx).where((P.extension("path") == ".png") & F.col("d_hash").isNotNull())
    out.append(finding(png.where("not has_alpha"), "info", "PNG_WITHOUT_ALPHA", _say("{path}", " is a PNG without alpha; WebP or JPEG is usually smaller."), "path", data=size))
    out.append(finding(png.where("has_alpha and not uses_transparency"), "info", "PNG_WITHOUT_ALPHA", _say("{path}", " has an alpha channel, and every pixel is opaque."), "path", data=size | {"alphaUnused": F.lit(True)}))
    odd = a.withColumn("problems", P.filename_problems(P.basename("path"))).where(F.size("problems") > 0)
    out.append(finding(odd, "warning", "PROBLEMATIC_FILENAME", _say("{path}", " contains ", F.array_join("problems", " and "), "; devices compare names byte by byte."), "path", data={"problems": F.col("problems")}))
    out.append(case_collisions(a))
    return out


def unused_fonts(ctx: Context) -> DataFrame:
    names = ctx.project.source.where("kind = 'literal'").select(F.col("name").alias("family"))
    fonts = match.absent(ctx.project.fonts, names, ["family"])
    return finding(fonts, "warning", "UNUSED_FONT_FAMILY", _say('Font family "', "{family}", '" of ', "{package}", " is named in no string, so no style selects it."), F.get("asset_paths", 0), F.array("origin"), F.slice("asset_paths", 2, F.greatest(F.size("asset_paths") - 1, F.lit(0))), {"package": F.col("package"), "family": F.col("family")})


def empty_directories(ctx: Context) -> DataFrame:
    return finding(ctx.project.empty_dirs, "warning", "EMPTY_ASSET_DIRECTORY", _say("{package}", " declares `", "{raw_entry}", "`, a directory without files."), "path", F.array("origin"), data={"package": F.col("package")})


def case_collisions(assets: DataFrame) -> DataFrame:
    g = groups.case_collisions(assets, "path").withColumn("n", F.size("related") + 1)
    return finding(g, "error", "CASE_COLLISION", _say("{n}", " paths differ in case alone: fine on some systems, broken where case counts."), "path", related=F.col("related"))


Check = Callable[[Context], list[DataFrame]]
REGISTRY: dict[str, Check] = {"unused": unused, "missing": missing, "duplicates": duplicates, "similar": similar_assets, "hygiene": hygiene}


def ordered(findings: DataFrame) -> DataFrame:
    """Most severe first, then code, then path."""
    rank = F.lit(0)
    for k, v in SEVERITIES.items():
        rank = F.when(F.col("severity") == k, v).otherwise(rank)
    return findings.orderBy(rank.desc(), "code", F.coalesce("path", F.lit("")), "message")
