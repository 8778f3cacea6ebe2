"""A project tree on disk, written from the nations' table, and what the scans read from it; pure functions over rows.

The root and one package for each nation: some without assets, some with a manifest that can't be read, all with files
that a scan must pass over. SQL derives from the same table what manifests, trees, sources and platform texts hold.
"""

from __future__ import annotations

import os
import struct
import subprocess
import tempfile
import zlib
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import delete, report
from gleaner.config import AuditConfig, load_config
from gleaner.functions import paths as P
from gleaner.functions import svg
from gleaner.plans import audit, checks
from gleaner.scratch import shared_dir
from gleaner.sources import images
from gleaner.sources.rows import map_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_runs: dict[tuple[str, str], audit.Audit] = {}

_BASE = """
n AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region, n_nationkey % 7 = 6 AS broken, n_nationkey % 5 = 4 AS bare, 'packages/n' || n_nationkey AS root FROM nation),
ok AS (SELECT *, row_number() OVER (ORDER BY root) AS ord FROM n WHERE NOT broken),
full_ AS (SELECT * FROM ok WHERE NOT bare)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {_BASE.strip()}{sql}"
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_tree(root: str, nations: list[tuple[int, str]]) -> None:
    files = {"pubspec.yaml": "name: root_app\n", "lib/main.dart": "void main() {}\n"}
    for k, name in nations:
        at, manifest = f"packages/n{k}", f"name: pkg_{k}\n"
        if k % 5 != 4:
            manifest += f"dependencies:\n  flutter:\n    sdk: flutter\nflutter:\n  assets:\n    - assets/n{k}/\n    - path: assets/extra/e{k}.txt\n      flavors: [red, blue]\n  fonts:\n    - family: Fam{k}\n      fonts:\n        - asset: fonts/f{k}.ttf\n"
        files[f"{at}/pubspec.yaml"] = "name: [\n" if k % 7 == 6 else manifest
        files[f"{at}/assets/n{k}/a.txt"] = name
        files[f"{at}/assets/n{k}/orphan.txt"] = name.lower()
        files[f"{at}/assets/n{k}/build/x.txt"] = files[f"{at}/assets/n{k}/.hidden"] = "passed over"
        files[f"{at}/assets/n{k}/3.0x/a.txt"] = name * 3
        files[f"{at}/lib/a{k}.dart"] = f"// 'assets/no/comment.txt'\nfinal a = Image.asset('packages/pkg_{k}/assets/n{k}/a.txt');\nfinal f = 'Fam{k}';\n"
        files[f"{at}/lib/g{k}.gen.dart"] = f"/// FlutterGen\nclass $AssetsGen {{\n  AssetGenImage get pic{k} => const AssetGenImage('assets/n{k}/a.txt');\n}}\n"
        files[f"{at}/lib/build/skip.dart"] = files[f"{at}/lib/note.txt"] = "passed over"
        files[f"{at}/android/r{k}.xml"] = f"<icon src='@drawable/ic_{k}.png'/>"
        files[f"{at}/android/r{k}.bin"] = "ic_no.png"
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def _folder(spark: SparkSession) -> str:
    """A folder for a tree: shared with the executors where the shared folder is a plain one."""
    at = shared_dir(spark)
    base = at[7:] if at.startswith("file://") else at if at.startswith("/") else None
    if base:
        os.makedirs(f"{base}/gleaner", exist_ok=True)
    return tempfile.mkdtemp(prefix="tree-", dir=f"{base}/gleaner" if base else None)


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    return [(r[0], r[1]) for r in _t(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]  # as many as there are nations


def run(spark: SparkSession, sf_dir: str) -> audit.Audit:
    """The audit of the tree; made once for a session and a folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        root = _folder(spark)
        write_tree(root, _nations(spark, sf_dir))
        _runs[key] = audit.run(spark, AuditConfig(root, checks=frozenset(["unused", "missing", "hygiene"])))
    return _runs[key]


@query(""" SELECT 'root_app' AS name, '' AS root, false AS is_flutter, 0 AS ord UNION ALL SELECT 'pkg_' || k, root, NOT bare, CAST(ord AS INTEGER) FROM ok""")
def tree_packages(spark, sf_dir):
    """Packages below a root, its own first; manifests that can't be read are none."""
    a = run(spark, sf_dir)
    root = a.context.config.root
    return a.context.project.packages.select("name", F.when(F.col("root") == root, "").otherwise(P.relative_posix("root", root)).alias("root"), "is_flutter", "ord")


@query(""" SELECT 'pkg_' || k AS package, 'assets/n' || k || '/' AS raw_entry, root || '/assets/n' || k AS path, 'directory' AS kind, 7 AS line, '' AS flavors FROM full_
  UNION ALL SELECT 'pkg_' || k, 'assets/extra/e' || k || '.txt', root || '/assets/extra/e' || k || '.txt', 'file', 8, 'red,blue' FROM full_
  UNION ALL SELECT 'pkg_' || k, root || '/fonts/f' || k || '.ttf', root || '/fonts/f' || k || '.ttf', 'file', 11, '' FROM full_""")
def tree_entries(spark, sf_dir):
    """Declared assets with their lines and flavours, fonts' files included."""
    d = run(spark, sf_dir).context.project.declarations
    return d.select("package", "raw_entry", "path", "kind", "origin.line", F.array_join("flavors", ",").alias("flavors"))


@query(""" SELECT 'Fam' || k AS family, root || '/fonts/f' || k || '.ttf' AS assets, 'pkg_' || k AS package, 11 AS line FROM full_""")
def tree_fonts(spark, sf_dir):
    """Font families and their files."""
    return run(spark, sf_dir).context.project.fonts.select("family", F.array_join("asset_paths", ",").alias("assets"), "package", "origin.line")


_TREE_ASSETS = """, t AS (SELECT k, bare, root, name, unnest(['a.txt', 'orphan.txt', '3.0x/a.txt']) AS f FROM ok),
ta AS (SELECT root || '/assets/n' || k || '/' || f AS path, 'pkg_' || k AS package, 'assets/n' || k || '/' || f AS package_path, CAST(length(name) * CASE f WHEN '3.0x/a.txt' THEN 3 ELSE 1 END AS BIGINT) AS size_bytes,
  CASE f WHEN '3.0x/a.txt' THEN root || '/assets/n' || k || '/a.txt' END AS variant_of, CASE f WHEN '3.0x/a.txt' THEN 3.0 END::DOUBLE AS variant_scale, CASE WHEN NOT bare THEN 'assets/n' || k || '/' END AS declared_by, f, k FROM t)"""


@query(f"""{_TREE_ASSETS} SELECT path, package, package_path, size_bytes, variant_of, variant_scale, declared_by FROM ta""")
def tree_assets(spark, sf_dir):
    """Files below asset roots; hidden ones and build folders are passed over."""
    return run(spark, sf_dir).context.project.assets.select("path", "package", "package_path", "size_bytes", "variant_of", "variant_scale", "declared_by")


@query(""" SELECT 'lib/main.dart' AS file, 'root_app' AS package UNION ALL SELECT root || '/lib/' || unnest(['a' || k, 'g' || k || '.gen']) || '.dart', 'pkg_' || k FROM ok""")
def tree_sources(spark, sf_dir):
    """Source files that are read."""
    return run(spark, sf_dir).context.project.source.where("kind = 'file'").select("file", "package")


@query(""" SELECT root || '/lib/g' || k || '.gen.dart' AS file, '$AssetsGen' AS owner, 'pic' || k AS name, 'assets/n' || k || '/a.txt' AS value FROM ok""")
def tree_members(spark, sf_dir):
    """Accessors of generated files."""
    m = run(spark, sf_dir).context.project.source.where("kind = 'member'")
    return m.select("file", "owner", "name", F.get_json_object("expr", "$[1]").alias("value"))


@query(""" SELECT root || '/lib/a' || k || '.dart' AS file, 2 AS line, 11 AS "column", 'packages/pkg_' || k || '/assets/n' || k || '/a.txt' AS value FROM ok""")
def tree_loads(spark, sf_dir):
    """Loads with their places; comments hold none."""
    s = run(spark, sf_dir).context.project.source.where("kind = 'candidate' and load")
    return s.select("file", "line", "column", F.get_json_object("expr", "$[1]").alias("value"))


@query(""" SELECT root || '/android/r' || k || '.xml' AS file, 'drawable/ic_' || k || '.png' AS token FROM ok""")
def tree_native(spark, sf_dir):
    """File-like tokens of platform text files; other files aren't read."""
    return run(spark, sf_dir).context.project.native.select("file", "token")


@query(f"""{_TREE_ASSETS}, u AS (SELECT ta.*, max(CASE f WHEN 'a.txt' THEN 2 ELSE 0 END) OVER (PARTITION BY coalesce(variant_of, path)) AS s FROM ta) SELECT path, CAST(s AS INTEGER) AS status FROM u""")
def tree_usage(spark, sf_dir):
    """States of the tree's assets; a variant follows its parent."""
    return run(spark, sf_dir).context.assets.select("path", "status")


@query(f"""{_TREE_ASSETS} SELECT path, sha256(CASE f WHEN 'a.txt' THEN name WHEN 'orphan.txt' THEN lower(name) ELSE repeat(name, 3) END) AS sha FROM ta JOIN nation ON n_nationkey = k JOIN (SELECT k AS k2, name FROM n) ON k2 = k""")
def tree_contents(spark, sf_dir):
    """Digests of the files' bytes."""
    return checks.contents(run(spark, sf_dir).context).select("path", "sha")


_TREE_FINDINGS = _TREE_ASSETS + """, f AS (SELECT 'warning' AS severity, 'UNUSED_ASSET' AS code, path FROM ta WHERE f = 'orphan.txt' UNION ALL SELECT 'error', 'MISSING_DECLARED_ASSET', root || unnest(['/assets/extra/e' || k || '.txt', '/fonts/f' || k || '.ttf']) FROM full_
  UNION ALL SELECT 'warning', 'UNDECLARED_ON_DISK', path FROM ta WHERE declared_by IS NULL AND variant_of IS NULL)"""


@query(f"""{_TREE_FINDINGS} SELECT severity, code, path FROM f""")
def tree_report_json(spark, sf_dir):
    """What the JSON report says (X20, the JSON reporter)."""
    body = F.lit(report.as_json(run(spark, sf_dir), None))
    one = F.explode(F.from_json(F.get_json_object(body, "$.findings"), "array<struct<severity:string,code:string,path:string>>")).alias("f")
    return spark.range(1).select(one).select("f.severity", "f.code", "f.path")


@query(f"""{_TREE_FINDINGS} SELECT severity, path FROM f""")
def tree_report_markdown(spark, sf_dir):
    """Rows of the Markdown report's tables (X21, the Markdown reporter)."""
    lines = spark.range(1).select(F.explode(F.split(F.lit(report.as_markdown(run(spark, sf_dir))), "\n")).alias("line"))
    row = r"^\| (error|warning|info) \| `([^`]+)` \|"
    return lines.where(F.col("line").rlike(row)).select(F.regexp_extract("line", row, 1).alias("severity"), F.regexp_extract("line", row, 2).alias("path"))


@query(f"""{_TREE_FINDINGS} SELECT path FROM f""")
def tree_report_text(spark, sf_dir):
    """Paths in the terminal report (the text reporter)."""
    lines = spark.range(1).select(F.explode(F.split(F.lit(report.as_text(run(spark, sf_dir))), "\n")).alias("line"))
    row = r"^  (?:error|warning|info) +(\S+)$"
    return lines.where(F.col("line").rlike(row)).select(F.regexp_extract("line", row, 1).alias("path"))


@query(f"""{_TREE_FINDINGS} SELECT level AS fail_on, CASE level WHEN 'error' THEN count_if(severity = 'error') > 0 ELSE count(*) > 0 END AS should_fail FROM f, (VALUES ('error'), ('warning'), ('info')) AS l(level) GROUP BY level UNION ALL SELECT 'none', false""")
def tree_gate(spark, sf_dir):
    """Whether a run fails at each level."""
    a = run(spark, sf_dir)
    return spark.createDataFrame([(k, a.should_fail(None if k == "none" else k)) for k in ("none", "info", "warning", "error")], "fail_on string, should_fail boolean")


@query(f"""{_TREE_ASSETS} SELECT 'deleted' AS kind, path FROM ta WHERE f = 'orphan.txt' UNION ALL SELECT 'left', path FROM ta WHERE f <> 'orphan.txt'""")
def tree_deleted(spark, sf_dir):
    """A deletion in a clean git tree after a yes: what goes and what stays (J18, the deleter)."""
    root = _folder(spark)
    write_tree(root, _nations(spark, sf_dir))
    for c in (["init", "-q"], ["add", "-A"], ["-c", "user.name=x", "-c", "user.email=x@x", "commit", "-qm", "tree"]):
        subprocess.run(["git", *c], cwd=root, check=True, capture_output=True)
    a = audit.run(spark, AuditConfig(root, checks=frozenset(["unused"]), delete_unused=True, dry_run=False))
    done = delete.run(a, lambda _: None, lambda: "yes")
    left = [r["path"] for r in a.context.project.assets.select("path", "absolute_path").collect() if os.path.exists(r["absolute_path"])]  # one row a file of this tree
    return spark.createDataFrame([("deleted", p) for p in done.deleted] + [("left", p) for p in left], "kind string, path string")


@query(""" SELECT k, CAST(k % 65 AS INTEGER) AS threshold, CAST(k * 10 AS INTEGER) AS kb, CAST(k % 3 * 1048576 AS BIGINT) AS hash_size, ['none', 'warning', 'error'][k % 3 + 1] AS fail_on, k % 2 = 0 AS dynamic, 'a' || k || '/**' AS ignored FROM n""")
def config_settings(spark, sf_dir):
    """Settings from a project's file over the defaults (S15, 2.12)."""
    rows = []
    for k, _ in _nations(spark, sf_dir):
        with tempfile.TemporaryDirectory() as d:
            with open(f"{d}/gleaner.yaml", "w") as f:
                f.write(f"ignore: ['a{k}/**']\nsimilarity_threshold: {k % 65}\nmax_file_size_kb: '{k * 10}'\nmax_hash_size_mb: {k % 3}\nfail_on: {('none', 'warn', 'error')[k % 3]}\ntreat_dynamic_as_used: {'true' if k % 2 == 0 else 'false'}\n")
            c = load_config(d)
        rows.append((k, c.similarity_threshold, c.max_file_size_kb, c.max_hash_size, c.fail_on or "none", c.treat_dynamic_as_used, c.ignore[0]))
    return spark.createDataFrame(rows, "k int, threshold int, kb int, hash_size long, fail_on string, dynamic boolean, ignored string")


@query(""" SELECT c AS "check", sel AS selected, sel = 'all' OR sel = c AS runs FROM (VALUES ('unused'), ('missing'), ('duplicates'), ('similar'), ('hygiene')) AS a(c), (VALUES ('all'), ('unused'), ('similar')) AS b(sel)""")
def selected_checks(spark, sf_dir):
    """Which checks of the registry run (F4, 2.9)."""
    base = AuditConfig("/")
    rows = [(c, s, replace(base, checks=frozenset([s])).runs(c)) for c in checks.REGISTRY for s in ("all", "unused", "similar")]
    return spark.createDataFrame(rows, "check string, selected string, runs boolean")


# -- pictures and vector files


def _png(values: np.ndarray, kind: int, alpha: int, lace: bool) -> bytes:
    """A PNG of grey values: 0 grey, 1 colour, 2 with alpha; interlaced or not."""
    h, w = values.shape
    img = values[:, :, None] if kind == 0 else np.repeat(values[:, :, None], 3, 2)
    if kind == 2:
        img = np.concatenate([img, np.full((h, w, 1), alpha, np.uint8)], 2)
    passes = images._PASSES if lace else ((0, 0, 1, 1),)
    raw = b"".join(b"\0" + row.tobytes() for x, y, dx, dy in passes for row in np.ascontiguousarray(img[y::dy, x::dx]) if img[y::dy, x::dx].size)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, (0, 2, 6)[kind], 0, 0, int(lace))) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@query(""", q AS (SELECT vec_id, vec_id % 10 = 9 AS cut, list_transform(range(0, 72), lambda i: greatest(0, least(255, CAST(floor((CAST(embedding[i % 64 + 1] AS DOUBLE) + 0.5) * 255) AS INTEGER)))) AS v FROM embeddings),
b AS (SELECT vec_id, cut, list_transform(range(0, 64), lambda i: v[(i // 8) * 9 + i % 8 + 1] > v[(i // 8) * 9 + i % 8 + 2]) AS bits FROM q)
SELECT vec_id, CASE WHEN NOT cut THEN 9 END AS width, CASE WHEN NOT cut THEN 8 END AS height,
  CASE WHEN NOT cut THEN CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN bits[i + 1] THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)) + CASE WHEN bits[64] THEN CAST(-9223372036854775808 AS HUGEINT) ELSE 0 END AS BIGINT) END AS d_hash,
  CASE WHEN NOT cut THEN vec_id % 3 = 2 END AS has_alpha, CASE WHEN NOT cut THEN vec_id % 3 = 2 AND vec_id % 2 = 0 END AS uses_transparency FROM b""")
def image_fingerprints(spark, sf_dir):
    """PNGs of grey, colour and alpha, interlaced or not, decoded and fingerprinted; cut ones give nulls."""

    def make():
        def work(r: dict):
            k = r["vec_id"]
            v = np.clip(np.floor((np.array(r["embedding"], np.float64) + 0.5) * 255), 0, 255).astype(np.uint8)
            data = _png(v[np.arange(72) % 64].reshape(8, 9), k % 3, 255 if k % 2 else 90, k % 4 == 3)
            yield {"vec_id": k} | (images.fingerprint(images.decode_png(data[:60] if k % 10 == 9 else data)) or {})

        return work

    return map_rows(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), make, "vec_id long, width int, height int, d_hash long, has_alpha boolean, uses_transparency boolean")


@query(""", q AS (SELECT p_partkey AS k, 'M' || p_partkey // 100 || ' ' || p_size || ' L' || p_partkey AS head FROM part)
SELECT k, sha256('<svg><path d="' || head || '.13 4"/><g><path d="M1 2.5"/></g></svg>') AS svg_hash, head || '.13 4 M1 2.5' AS path_data FROM q WHERE k % 9 <> 8""")
def svg_forms(spark, sf_dir):
    """Normal forms without prologue, comments, ids and far decimals, and path geometry; what is no SVG has none."""
    k = F.col("p_partkey")
    head = F.concat(F.lit("M"), F.floor(k / 100), F.lit(" "), "p_size", F.lit(" L"), k)
    text = F.concat(F.lit('<?xml version="1.0"?><!DOCTYPE svg>\n<!-- made\nby -->\n<svg id="a'), k, F.lit('">\n  <path id="p" d="'), head, F.lit('.12600 4.000"/>  <g data-name=\'x\'>\n<path d="M1 2.5"/></g></svg> '))
    text = F.when(k % 9 == 8, "<html/>").otherwise(text)

    def make():
        def work(r: dict):
            norm = svg.normalize(r["text"])
            if norm is not None:
                yield {"k": r["k"], "norm": norm, "path_data": svg.path_data(norm)}

        return work

    forms = map_rows(_t(spark, sf_dir, "part").select(k.alias("k"), text.alias("text")), make, "k long, norm string, path_data string")
    return forms.select("k", F.sha2("norm", 256).alias("svg_hash"), "path_data")


# -- functions


@query(r""", q AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'packages/' || p_type || '/' || p_name ELSE p_type || '/' || p_name END AS path FROM part) SELECT k, CASE WHEN k % 3 = 0 THEN split_part(path, '/', 2) END AS package, CASE WHEN k % 3 = 0 THEN split_part(path, '/', 3) END AS rest FROM q""")
def package_references(spark, sf_dir):
    """Paths of the form packages/<package>/<rest>."""
    path = F.concat(F.when(F.col("p_partkey") % 3 == 0, "packages/").otherwise(""), "p_type", F.lit("/"), "p_name")
    d = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), P.package_reference(path).alias("r"))
    return d.select("k", "r.package", "r.rest")


@query(r""" SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 0.5 END::DOUBLE AS scale FROM part""")
def variant_scales(spark, sf_dir):
    """Scales that directory names such as 2.0x state."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(k % 4 == 0, F.concat(n, F.lit("x"))).when(k % 4 == 1, F.concat(n, F.lit(".5x"))).when(k % 4 == 2, F.concat(F.lit("x"), n)).otherwise(F.concat(n, F.lit(".x")))
    return _t(spark, sf_dir, "part").select(k.alias("k"), P.variant_scale(name).alias("scale"))


@query(r""" SELECT p_partkey AS k, lower(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || upper(p_type[1]) || p_type[2:] || p_size AS name FROM part""")
def camel_names(spark, sf_dir):
    """Names as generated code would spell them."""
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), P.camel_case(F.concat("p_name", F.lit("__"), "p_type", F.lit("-."), "p_size")).alias("name"))


@query(r""", q AS (SELECT conv_id, turn, regexp_replace(text, '[ \t\r\n\v\f]+', ' ', 'g') AS t FROM conversations) SELECT conv_id, turn, CASE WHEN length(t) > 120 THEN t[1:119] || '…' ELSE t END AS short, replace(replace(t || '|', '|', '\|'), chr(10), ' ') AS escaped FROM q""")
def shortened_texts(spark, sf_dir):
    """Text cut for display, and escaped for tables."""
    t = F.regexp_replace("text", "[ \\t\\r\\n\\x0b\\f]+", " ")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", P.truncate("text").alias("short"), P.markdown_escape(F.concat(t, F.lit("|"))).alias("escaped"))


@query(r""" SELECT l_orderkey, l_linenumber, 'o' || l_orderkey || CASE WHEN l_linenumber > 1 THEN ':' || l_linenumber || CASE WHEN l_quantity > 25 THEN ':' || l_partkey ELSE '' END ELSE '' END AS place FROM lineitem""")
def displayed_places(spark, sf_dir):
    """Places as file[:line[:column]]."""
    li = _t(spark, sf_dir, "lineitem")
    line = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber"))
    occ = F.struct(F.concat(F.lit("o"), "l_orderkey").alias("file"), line.alias("line"), F.when(F.col("l_quantity") > 25, F.col("l_partkey")).alias("column"))
    return li.select("l_orderkey", "l_linenumber", P.display(occ).alias("place"))


@query(r""", q AS (SELECT page_id, ['assets/' || page_id || '.png', 'http://x/' || page_id || '.png', '/assets/a.png', 'assets/a.dart', 'assets/*.png', 'a.png', 'assets/$x.png', 'assets/' || repeat('a', 300) || '.png', 'assets/noext', 'assets/f.longext', 'package:a/b.png', 'assets/a.MD'][page_id % 12 + 1] AS v FROM pages) SELECT page_id, page_id % 12 = 0 AS shaped FROM q""")
def asset_shapes(spark, sf_dir):
    """Strings that have the shape of an asset's path."""
    i = F.col("page_id")
    v = F.array(F.concat(F.lit("assets/"), i, F.lit(".png")), F.concat(F.lit("http://x/"), i, F.lit(".png")), *map(F.lit, ("/assets/a.png", "assets/a.dart", "assets/*.png", "a.png", "assets/$x.png", f"assets/{'a' * 300}.png", "assets/noext", "assets/f.longext", "package:a/b.png", "assets/a.MD")))
    return _t(spark, sf_dir, "pages").select("page_id", P.looks_like_asset_path(F.get(v, (i % 12).cast("int"))).alias("shaped"))


@query(r""" SELECT p_partkey AS k, p_type || '/' || p_name || '.TxT' AS path, p_name || '.TxT' AS base, p_type AS dir, '.txt' AS ext FROM part""")
def path_parts(spark, sf_dir):
    """Base names, directories and extensions."""
    path = F.concat("p_type", F.lit("/"), "p_name", F.lit(".TxT"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), path.alias("path"), P.basename(path).alias("base"), P.dirname(path).alias("dir"), P.extension(path).alias("ext"))
