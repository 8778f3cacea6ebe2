"""A project tree as tables: packages, declarations, fonts, assets, source rows, platform text tokens.

Listing is the driver's (Spark's own listing hides names that start with ``_`` or ``.`` and empty directories); file
contents are read and parsed by the executors, which share the tree.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import AuditConfig, ConfigError
from gleaner.functions import paths as P
from gleaner.operators import groups, match
from gleaner.scratch import materialize
from gleaner.sources import dart, manifest
from gleaner.sources.manifest import SKIPPED, Package, relative
from gleaner.sources.rows import map_rows

OCC = "struct<file:string,line:int,column:int,snippet:string>"
SOURCE_DIRS = ("lib", "test", "integration_test", "bin", "tool")
NATIVE_DIRS = ("android", "ios", "web", "macos", "windows", "linux")
NATIVE_TEXT = frozenset(".xml .plist .html .json .gradle .kts .pbxproj .storyboard .xib .entitlements .properties .cfg .rc .swift .kt .java .m .h .cc .cpp .yaml .yml".split())
NATIVE_BYTES = 2 << 20
_ROW = "kind string, file string, package string, ord long, owner string, name string, expr string, how string, load boolean, explicit_package string, parameter string, index int, line int, column int, snippet string"


@dataclass
class Project:
    config: AuditConfig
    packages: DataFrame
    declarations: DataFrame
    fonts: DataFrame
    assets: DataFrame
    read_source: DataFrame
    read_native: DataFrame
    missing: DataFrame
    empty_dirs: DataFrame
    listing: DataFrame
    package_list: list[Package]

    @cached_property
    def source(self) -> DataFrame:
        """Rows of all source files, read when they are first asked for."""
        return materialize(self.read_source, "source")

    @cached_property
    def native(self) -> DataFrame:
        """Tokens of all platform text, read when they are first asked for."""
        return materialize(self.read_native, "native")


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _walk(top: str) -> Iterator[tuple[str, bool, int]]:
    """(path, is a directory, size) below ``top``, in path order, links not followed."""
    try:
        entries = sorted(os.scandir(top), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        try:
            if e.is_symlink():
                continue
            if e.is_dir():
                yield e.path, True, 0
                yield from _walk(e.path)
            elif e.is_file():
                yield e.path, False, e.stat().st_size
        except OSError:
            continue


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    rows = [(p, relative(p, root), d, n) for p, d, n in _walk(root)]
    return table(spark, rows, "absolute string, path string, is_dir boolean, size long")


def _schema_packages(spark: SparkSession, packages: list[Package]) -> DataFrame:
    return table(spark, [(p.name, p.root, p.manifest, p.is_flutter, i) for i, p in enumerate(packages)], "name string, root string, pubspec string, is_flutter boolean, ord int")


def load(spark: SparkSession, config: AuditConfig) -> Project:
    packages = manifest.discover(config.root)
    if not packages:
        raise ConfigError(f"No pubspec.yaml below {config.root}; point --path at a project or workspace root.")
    return assemble(spark, config, packages, list_tree(spark, config.root), read_sources(spark, config, packages), read_native(spark, config, packages))


def assemble(spark: SparkSession, config: AuditConfig, packages: list[Package], listing: DataFrame, source: DataFrame, native: DataFrame) -> Project:
    """A project from its packages and three tables: what lies in the tree, source rows, platform tokens."""
    pkgs = _schema_packages(spark, packages)
    decls, fonts, n = [], [], 0
    for p in packages:
        for d in p.declarations:
            decls.append((d["raw_entry"], p.name, d["path"], d["kind"], tuple(d["origin"].values()), d["flavors"], n))
            n += 1
        for f in p.fonts:
            fonts.append((f["family"], f["paths"], p.name, tuple(f["origin"].values()), len(fonts)))
            for a in f["paths"]:
                decls.append((a, p.name, a, "file", tuple(f["origin"].values()), [], n))
                n += 1
    declarations = table(spark, decls, f"raw_entry string, package string, path string, kind string, origin {OCC}, flavors array<string>, ord int")
    fonts_df = table(spark, fonts, f"family string, asset_paths array<string>, package string, origin {OCC}, ord int")
    assets = materialize(find_assets(spark, config, packages, listing, declarations), "assets")
    missing = match.absent(declarations, listing.select("path"), ["path"])
    files = listing.where("not is_dir").where(~P.basename("path").startswith("."))
    held = files.select(F.explode(P.ancestors("path")).alias("path")).distinct()
    dirs = declarations.where("kind = 'directory'").join(listing.where("is_dir").select("path"), "path", "left_semi")
    empty = match.absent(dirs, held, ["path"])
    return Project(config, pkgs, declarations, fonts_df, assets, source, native, missing, empty, listing, packages)


def roots_of(package: Package, root: str) -> list[str]:
    """The directories of one package in which assets are looked for; none lies within another."""
    at = {d["path"] if d["kind"] == "directory" else os.path.dirname(d["path"]) for d in package.declarations}
    at |= {os.path.dirname(a) for f in package.fonts for a in f["paths"]}
    base = relative(package.root, root)
    for d in ("assets", "fonts"):
        if os.path.isdir(os.path.join(package.root, d)):
            at.add(f"{base}/{d}" if base else d)
    at = {a if a != "." else "" for a in at}
    return sorted(a for a in at if not any(o != a and (o == "" or a.startswith(o + "/")) for o in at))


def find_assets(spark: SparkSession, config: AuditConfig, packages: list[Package], listing: DataFrame, declarations: DataFrame) -> DataFrame:
    """Files below the packages' asset roots, with package, variant parent and covering declaration."""
    rows = [(r, p.name, relative(p.root, config.root), i) for i, p in enumerate(packages) for r in roots_of(p, config.root)]
    roots = table(spark, rows, "asset_root string, package string, base string, pkg_ord int")
    files = listing.where("not is_dir").where(~P.is_ignored("path", list(config.ignore)))
    # a root is one of a file's ancestors, so files meet roots by equality
    under = files.withColumn("asset_root", F.explode(F.concat(F.array(F.lit("")), P.ancestors("path"))))
    found = under.join(F.broadcast(roots), "asset_root")
    inner = F.when(F.col("asset_root") == "", F.col("path")).otherwise(F.expr("substring(path, length(asset_root) + 2)"))
    parts = F.split(inner, "/")
    hidden = F.exists(parts, lambda s: s.startswith(".")) | F.arrays_overlap(parts, F.array(*[F.lit(s) for s in sorted(SKIPPED)]))
    found = groups.first_wins(found.where(~hidden), ["path"], ["pkg_ord", "asset_root"])
    package_path = F.when(F.col("base") == "", F.col("path")).when(F.col("path").startswith(F.concat("base", F.lit("/"))), F.expr("substring(path, length(base) + 2)")).otherwise(F.col("path"))
    a = found.select(F.col("absolute").alias("absolute_path"), "path", "package", package_path.alias("package_path"), F.col("size").alias("size_bytes"))
    folder = P.dirname("path")
    scale = P.variant_scale(P.basename(folder))
    up = P.dirname(folder)
    parent = F.when(scale.isNotNull(), F.concat(up, F.when(up == "", "").otherwise("/"), P.basename("path")))
    a = a.withColumn("_scale", scale).withColumn("_parent", parent)
    # files without a parent meet nothing, each under a key of its own: nulls would all go to one task
    a = a.join(a.select(F.col("path").alias("_known")), F.coalesce("_parent", F.concat(F.lit("\x00"), "path")) == F.col("_known"), "left")
    a = a.withColumn("variant_of", F.col("_known")).withColumn("variant_scale", F.when(F.col("_known").isNotNull(), F.col("_scale"))).drop("_scale", "_parent", "_known")
    cover = F.coalesce("variant_of", "path")
    firsts = {k: groups.first_wins(declarations.where(F.col("kind") == k), ["path"], ["ord"]) for k in ("file", "directory")}
    own = firsts["file"].select(F.col("path").alias("_f"), F.col("raw_entry").alias("_fe"))
    direct = firsts["directory"].select(F.when(F.col("path") == ".", "").otherwise(F.col("path")).alias("_d"), F.col("raw_entry").alias("_de"))
    a = a.join(F.broadcast(own), cover == F.col("_f"), "left").join(F.broadcast(direct), P.dirname(cover) == F.col("_d"), "left")
    return a.withColumn("declared_by", F.coalesce("_fe", "_de")).drop("_f", "_fe", "_d", "_de")


def read_sources(spark: SparkSession, config: AuditConfig, packages: list[Package]) -> DataFrame:
    """One pass over all source files; each row has the position that orders it among all others."""
    files = []
    for p in packages:
        for d in SOURCE_DIRS:
            for path, is_dir, _ in _walk(os.path.join(p.root, d)):
                if not is_dir and path.endswith(".dart") and not SKIPPED & set(path.split(os.sep)):
                    files.append((path, relative(path, config.root), p.name, len(files)))
    df = table(spark, files, "absolute string, file string, package string, ord long")
    df = df.where(~P.is_ignored("file", list(config.ignore))).repartition(max(1, min(len(files) // 16 + 1, 4096)), "file")

    def make():
        def read(f: dict):
            try:
                with open(f["absolute"], encoding="utf-8", newline="") as h:
                    yield from _source_rows(f, h.read())
            except (OSError, UnicodeDecodeError):
                return

        return read

    return map_rows(df.select("absolute", "file", "package", "ord"), make, _ROW)


def parse_sources(texts: DataFrame) -> DataFrame:
    """The same rows from a table (file, package, ord, text) of sources; tasks hold so many files, not bytes, as reading is slow."""
    texts = texts.select("file", "package", "ord", "text")
    return map_rows(texts.repartition(max(1, min(texts.count() // 5000 + 1, 4096)), "file"), lambda: lambda f: _source_rows(f, f["text"]), _ROW)


def _source_rows(f: dict, src: str) -> Iterator[dict]:
    at, common = f["ord"] * 1_000_000, {"file": f["file"], "package": f["package"]}
    yield common | {"kind": "file", "ord": at, "load": False}
    for i, r in enumerate(dart.read(src, os.path.basename(f["file"])), 1):
        r["explicit_package"] = r.pop("package", None)
        yield {"load": False} | r | common | {"ord": at + i}


def read_native(spark: SparkSession, config: AuditConfig, packages: list[Package]) -> DataFrame:
    """(file, token, ord): file-like tokens in the platforms' text files. Ignore globs don't apply here."""
    files = []
    for p in packages:
        for d in NATIVE_DIRS:
            for path, is_dir, size in _walk(os.path.join(p.root, d)):
                ext = os.path.splitext(path)[1].lower()
                if not is_dir and ext in NATIVE_TEXT and size <= NATIVE_BYTES and not SKIPPED & set(path.split(os.sep)):
                    files.append((path, relative(path, config.root), len(files)))
    df = table(spark, files, "absolute string, file string, ord long")

    def make():
        def read(f: dict):
            try:
                with open(f["absolute"], encoding="utf-8") as h:
                    yield {"file": f["file"], "text": h.read(), "ord": f["ord"]}
            except (OSError, UnicodeDecodeError):
                return

        return read

    return native_tokens(map_rows(df, make, "file string, text string, ord long"))


def native_tokens(text: DataFrame) -> DataFrame:
    """(file, ord, i, raw, token) of a table (file, text, ord)."""
    tokens = F.regexp_extract_all("text", F.lit(r"[\w./\\-]+\.\w{2,5}"), F.lit(0))
    return text.select("file", "ord", F.posexplode(tokens).alias("i", "raw")).withColumn("token", P.normalize_asset_path("raw"))
