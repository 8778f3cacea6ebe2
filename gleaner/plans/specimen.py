"""A project made of the ordinary tables: its findings, at any size, and SQL that derives the same from the same tables.

Parts are assets in a directory for each brand, some with a variant or a twin in capitals; suppliers are icons of a
second package; each customer is a source file that refers to a part in one of twelve ways; each nation is a platform
text. Everything from there on is the audit's own: asset roots, coverage, the source reader, resolution, findings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import AuditConfig
from gleaner.functions import paths as P
from gleaner.functions import similarity
from gleaner.operators import groups
from gleaner.plans import audit, checks
from gleaner.plans.resolve import fallback_accessors, resolve
from gleaner.sources.manifest import Package
from gleaner.sources.project import assemble, native_tokens, parse_sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ROOT, BRANDS, FORMS = "/specimen", 25, 12
_made: dict[tuple[str, str], checks.Context] = {}

#: The tables as SQL: parts and their names, all assets, what each customer's file says, marks and states.
_BASE = """
p AS (SELECT p_partkey AS k, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand, 'assets/' || replace(lower(p_brand), '#', '_') AS dir, p_size, p_type, p_name,
  CASE WHEN p_partkey % 50 = 7 THEN 'P ' ELSE 'p' END || p_partkey || ['.png', '.jpg', '.svg', '.json'][p_partkey % 4 + 1] AS name FROM part),
b AS (SELECT dir || '/' || name AS path, 'app' AS package, dir || '/' || name AS package_path, CASE WHEN p_size = 13 THEN 0 ELSE p_size * 12000 + k % 7 END AS size, CAST(NULL AS VARCHAR) AS variant_of, k, brand, dir FROM p
  UNION ALL SELECT dir || '/P' || k || ['.png', '.jpg', '.svg', '.json'][k % 4 + 1], 'app', dir || '/P' || k || ['.png', '.jpg', '.svg', '.json'][k % 4 + 1], 77, NULL, k, brand, dir FROM p WHERE k % 100 = 9
  UNION ALL SELECT dir || '/2.0x/' || name, 'app', dir || '/2.0x/' || name, 5000 + k, dir || '/' || name, k, brand, dir FROM p WHERE k % 10 = 2
  UNION ALL SELECT 'packages/design/assets/icons/s' || s_suppkey || '.png', 'design', 'assets/icons/s' || s_suppkey || '.png', s_suppkey * 10 + 1, NULL, s_suppkey, 0, 'packages/design/assets/icons' FROM supplier),
a AS (SELECT path, package, package_path, CAST(size AS BIGINT) AS size, variant_of, k, brand, dir,
  CASE WHEN package = 'design' THEN 'assets/icons/' WHEN brand <> 25 THEN dir || '/' END AS declared_by FROM b),
r AS (SELECT c_custkey AS c, c_custkey % 12 AS form, p.k, p.dir, p.name, p.brand, p.dir || '/' || p.name AS path, 'lib/c' || c_custkey || '.dart' AS file,
  'packages/design/assets/icons/s' || (c_custkey % (SELECT count(*) FROM supplier)) || '.png' AS icon
  FROM customer JOIN p ON p.k = (c_custkey * 7) % (SELECT count(*) FROM part)),
dyn AS (SELECT * FROM r WHERE form = 4 AND brand <= 3),
hit AS (SELECT path FROM r WHERE form IN (0, 1, 3, 6, 8, 11) OR form = 4 AND brand > 3
  UNION ALL SELECT icon FROM r WHERE form IN (9, 10)
  UNION ALL SELECT a.path FROM a JOIN nation ON regexp_replace(a.path, '^.*/', '') = 'p' || n_nationkey * 4 || '.png'),
mark AS (SELECT path, 2 AS s FROM hit UNION ALL SELECT a.path, 1 FROM a JOIN (SELECT DISTINCT dir FROM dyn) d ON starts_with(a.path, d.dir || '/')),
own AS (SELECT a.path, a.variant_of, coalesce(max(s), 0) AS s FROM a LEFT JOIN mark ON mark.path = a.path GROUP BY ALL),
u AS (SELECT path, CAST(max(s) OVER (PARTITION BY coalesce(variant_of, path)) AS INTEGER) AS status FROM own),
au AS (SELECT a.*, u.status FROM a JOIN u ON a.path = u.path)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH RECURSIVE {_BASE.strip()}{sql}"
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.get(F.array(*map(F.lit, (".png", ".jpg", ".svg", ".json"))), (k % 4).cast("int"))
    folder = F.concat(F.lit("assets/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")))
    name = F.concat(F.when(k % 50 == 7, "P ").otherwise("p"), k.cast("string"), ext)
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    return _t(spark, sf_dir, "part").select(k.alias("k"), brand.alias("brand"), folder.alias("dir"), "p_size", "p_type", "p_name", ext.alias("ext"), name.alias("name"))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _parts(spark, sf_dir), F.col("k")
    file = lambda df, path, size: df.select(path.alias("path"), F.lit(False).alias("is_dir"), size.cast("long").alias("size"))
    size = F.when(F.col("p_size") == 13, 0).otherwise(F.col("p_size") * 12000 + k % 7)
    out = file(p, F.concat_ws("/", "dir", "name"), size)
    out = out.union(file(p.where(k % 100 == 9), F.concat("dir", F.lit("/P"), k, "ext"), F.lit(77)))
    out = out.union(file(p.where(k % 10 == 2), F.concat("dir", F.lit("/2.0x/"), "name"), k + 5000))
    s = _t(spark, sf_dir, "supplier")
    out = out.union(file(s, F.concat(F.lit("packages/design/assets/icons/s"), "s_suppkey", F.lit(".png")), F.col("s_suppkey") * 10 + 1))
    dirs = p.select("dir").distinct().union(spark.createDataFrame([("assets/empty",), ("packages/design/assets/icons",)], "dir string"))
    out = out.union(dirs.select(F.col("dir"), F.lit(True), F.lit(0).cast("long")))
    return out.select(F.concat(F.lit(ROOT + "/"), "path").alias("absolute"), "path", "is_dir", "size")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each customer."""
    parts, suppliers = (F.lit(_t(spark, sf_dir, t).count()) for t in ("part", "supplier"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), ((F.col("c_custkey") * 7) % parts).alias("k"), (F.col("c_custkey") % suppliers).cast("string").alias("s"))
    d = c.join(_parts(spark, sf_dir).select("k", "dir", "name", "brand"), "k").withColumn("path", F.concat_ws("/", "dir", "name"))

    def say(form: str):
        """Text with columns in braces."""
        bits = form.replace("{", "\x00{").replace("}", "}\x00").split("\x00")
        return F.concat(*[F.col(b[1:-1]).cast("string") if b[:1] == "{" and b[1:-1] in ("c", "s", "k", "dir", "name", "path", "brand") else F.lit(b.replace("«", "{").replace("»", "}")) for b in bits if b])

    load = "Future<String> load{c}(String path) async => rootBundle.loadString(path);\n"
    forms = [
        "final a{c} = Image.asset('{path}');\n", "class C{c} «\n  static const logo = '{path}';\n»\nfinal b{c} = Image.asset(C{c}.logo);\n", "class D{c} «\n  static const never = '{path}';\n»\n",
        "final c{c} = show('{dir}/'\n    '{name}');\n", "Widget d{c}(String x) => Image.asset('{dir}/$x.png');\n", "final e{c} = Image.asset('{dir}/missing{c}.png');\n", "const base{c} = '{dir}/';\nfinal f{c} = Image.asset(base{c} + '{name}');\n",
        load, load + "void call{c}() «\n  load{c}('{path}');\n»\n", "final g{c} = Image.asset('packages/design/assets/icons/s{s}.png');\n", "final h{c} = Image.asset('assets/icons/s{s}.png', package: 'design');\n", "Widget i{c}() => Assets.brand{brand}.p{k}.image();\n",
    ]
    form = (F.col("c") % FORMS).cast("int")
    text = F.when((form == 4) & (F.col("brand") > 3), say(forms[0]))
    for i, f in enumerate(forms):
        text = text.when(form == i, say(f))
    return d.select(F.concat(F.lit("lib/c"), "c", F.lit(".dart")).alias("file"), F.lit("app").alias("package"), F.col("c").cast("long").alias("ord"), text.alias("text"))


def context(spark: SparkSession, sf_dir: str) -> checks.Context:
    """The project, resolved; made once for a session and a folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        origin = lambda line, text: {"file": "pubspec.yaml", "line": line, "column": None, "snippet": text}
        entry = lambda raw, path, kind, line: {"raw_entry": raw, "path": path, "kind": kind, "origin": origin(line, raw), "flavors": []}
        dirs = [entry(f"assets/brand_{i}/", f"assets/brand_{i}", "directory", i) for i in range(1, BRANDS)]
        app = Package("app", ROOT, f"{ROOT}/pubspec.yaml", True, [*dirs, entry("assets/empty/", "assets/empty", "directory", 30), entry("assets/readme.txt", "assets/readme.txt", "file", 31)])
        app.fonts = [{"family": "Roboto", "paths": ["fonts/roboto.ttf"], "origin": origin(40, "Roboto")}]
        design = Package("design", f"{ROOT}/packages/design", f"{ROOT}/packages/design/pubspec.yaml", True, [entry("assets/icons/", "packages/design/assets/icons", "directory", 5)])
        n = _t(spark, sf_dir, "nation").select(F.concat(F.lit("web/n"), "n_nationkey", F.lit(".html")).alias("file"), F.concat(F.lit("<img src='splash/p"), F.col("n_nationkey") * 4, F.lit(".png'> v1.0")).alias("text"), F.col("n_nationkey").cast("long").alias("ord"))
        project = assemble(spark, AuditConfig(ROOT), [app, design], _listing(spark, sf_dir), parse_sources(_texts(spark, sf_dir)), native_tokens(n))
        made = checks.Context(project, lambda: resolve(project), project.config)
        made.kept["contents"] = _contents(spark, sf_dir, project.assets)
        _made[key] = made
    return _made[key]


def _contents(spark: SparkSession, sf_dir: str, assets: DataFrame) -> DataFrame:
    """Digests and fingerprints in place of files: parts of one size and type are copies; pictures are embeddings."""
    p = _parts(spark, sf_dir)
    vectors = _t(spark, sf_dir, "embeddings").select("vec_id", "label", similarity.sign_bits("embedding", 63).alias("h"))
    n = vectors.count()
    own = p.withColumn("path", F.concat_ws("/", "dir", "name")).join(F.broadcast(vectors), F.col("vec_id") == F.col("k") % n)
    png, vector = F.col("ext") == ".png", F.col("ext") == ".svg"
    found = own.select(
        "path", F.sha2(F.concat_ws("/", "p_size", "p_type"), 256).alias("sha"), F.when(png, F.lit(64)).alias("width"), F.when(png, (F.col("k") % 3 + 62).cast("int")).alias("height"),
        F.when(png, F.col("h")).alias("d_hash"), F.when(png, F.col("label") % 3 > 0).alias("has_alpha"), F.when(png, F.col("label") % 3 == 2).alias("uses_transparency"),
        F.when(vector, F.sha2("p_type", 256)).alias("svg_hash"), F.when(vector, F.col("p_name")).alias("path_data"),
    )
    return assets.join(found, "path")


def _flat(findings: DataFrame) -> DataFrame:
    """Findings without arrays."""
    occ = F.array_join(F.transform("occurrences", P.display), ",")
    return findings.select("severity", "code", "message", "path", occ.alias("occ"), F.array_join("related_paths", ",").alias("related"), "data", "reclaimable_bytes")


def _of(parts: list[DataFrame], code: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _flat(out.where(F.col("code") == code))


@query("SELECT path, package, package_path, size AS size_bytes, variant_of, CASE WHEN variant_of IS NOT NULL THEN 2.0 END::DOUBLE AS variant_scale, declared_by FROM a")
def project_assets(spark, sf_dir):
    """Files below the asset roots, with package, variant parent and covering declaration."""
    return context(spark, sf_dir).project.assets.select("path", "package", "package_path", "size_bytes", "variant_of", "variant_scale", "declared_by")


@query("""SELECT * FROM (VALUES ('pubspec.yaml', 'app', true, 0), ('packages/design/pubspec.yaml', 'design', true, 1)) AS t(manifest, name, is_flutter, ord)""")
def project_packages(spark, sf_dir):
    """Packages in order, the root's own first."""
    p = context(spark, sf_dir).project.packages
    return p.select(P.relative_posix("pubspec", ROOT).alias("manifest"), "name", "is_flutter", "ord")


@query("""SELECT path, status, status = 2 AS used FROM u""")
def project_usage(spark, sf_dir):
    """What code can reach: constants, sums, call sites, accessors, prefixes, other packages, platform text."""
    return context(spark, sf_dir).assets.select("path", "status", (F.col("status") == 2).alias("used"))


@query("""SELECT file, CAST(1 AS INTEGER) AS line, dir AS prefix, 'Image.asset(''' || dir || '/$x.png'')' AS raw FROM dyn""")
def project_dynamic(spark, sf_dir):
    """References that a directory pins."""
    return context(spark, sf_dir).usage.dynamic.select("occ.file", "occ.line", "prefix", "raw")


@query("""SELECT file, 'rootBundle.loadString(path)' AS expression, '`path` is a parameter of `load' || c || '` and no call site passes a value that can be traced.' AS reason FROM r WHERE form = 7""")
def project_unresolvable(spark, sf_dir):
    """Loads that no call site makes known."""
    return context(spark, sf_dir).usage.unresolvable.select("occ.file", "expression", "reason")


@query("""SELECT file, dir || '/missing' || c || '.png' AS value FROM r WHERE form = 5""")
def project_unmatched(spark, sf_dir):
    """Strings of an asset path's shape that match nothing."""
    return context(spark, sf_dir).usage.unmatched.select("occ.file", "value").distinct()


@query("""SELECT how, count(DISTINCT file) AS files, count(DISTINCT value) AS values_ FROM (
  SELECT 'native' AS how, 'web/n' || n_nationkey || '.html' AS file, a.path AS value FROM a JOIN nation ON regexp_replace(a.path, '^.*/', '') = 'p' || n_nationkey * 4 || '.png'
  UNION ALL SELECT 'flutterGen', file, path FROM r WHERE form = 11) GROUP BY how""")
def project_references(spark, sf_dir):
    """Matched references from platform text and by generated names."""
    r = context(spark, sf_dir).usage.references.where(F.col("how").isin("native", "flutterGen"))
    return r.groupBy("how").agg(F.countDistinct("occ.file").alias("files"), F.countDistinct("value").alias("values_"))


@query("""SELECT 'C' || c || '.logo' AS name, path AS value FROM r WHERE form = 1 UNION ALL SELECT 'D' || c || '.never', path FROM r WHERE form = 2 UNION ALL SELECT 'base' || c, dir || '/' FROM r WHERE form = 6""")
def project_constants(spark, sf_dir):
    """Constants by qualified name, as the source reader finds them."""
    src = context(spark, sf_dir).project.source.where("kind = 'constant'")
    last = src.groupBy("name").agg(F.max_by("expr", "ord").alias("expr"))
    simple = last.withColumn("value", F.get_json_object("expr", "$[1]"))
    dotted = simple.where("name like 'C%.%' or name like 'D%.%' or name like 'base%'")
    return dotted.select("name", "value")


@query("""SELECT 'Assets.brand' || brand || '.p' || k AS accessor, max(path) AS package_path FROM a WHERE variant_of IS NULL AND package = 'app' GROUP BY 1""")
def project_accessors(spark, sf_dir):
    """Names that generated code would give the assets; the last asset keeps a name."""
    f = fallback_accessors(context(spark, sf_dir).project.assets)
    return f.where(r"accessor rlike '^Assets\\.brand[0-9]+\\.p[0-9]+$'").select("accessor", "package_path")


@query("""SELECT file, 'load' || c AS fn, 'path' AS parameter, 0 AS "index" FROM r WHERE form IN (7, 8)""")
def project_pending(spark, sf_dir):
    """Parameters that loads wait for."""
    s = context(spark, sf_dir).project.source.where("kind = 'pending'")
    return s.select("file", F.col("name").alias("fn"), "parameter", "index")


@query("""SELECT 'web/n' || n_nationkey || '.html' AS file, unnest(['splash/p' || n_nationkey * 4 || '.png']) AS token FROM nation""")
def project_native_tokens(spark, sf_dir):
    """File-like tokens of platform text, in one spelling."""
    return context(spark, sf_dir).project.native.where("token like '%.png'").select("file", "token")


def _bytes_sql(n: str) -> str:
    """Sizes in words, halves rounded up as Java does."""
    one = lambda d, unit: f"printf('%.1f {unit}', floor({n} / {d} * 10 + 0.5) / 10)"
    return f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} >= 104857600 THEN printf('%.0f MB', floor({n} / 1048576 + 0.5)) WHEN {n} >= 1048576 THEN {one(1048576, 'MB')} WHEN {n} >= 102400 THEN printf('%.0f KB', floor({n} / 1024 + 0.5)) ELSE {one(1024, 'KB')} END"


_NO = "CAST(NULL AS VARCHAR)"


@query(f""", v AS (SELECT variant_of AS path, string_agg(path, ',' ORDER BY path) AS related, count(*) AS n, sum(size) AS bytes FROM a WHERE variant_of IS NOT NULL GROUP BY 1)
SELECT 'warning' AS severity, 'UNUSED_ASSET' AS code, 'No reference reaches ' || au.path || ' (' || {_bytes_sql('size')} || ').' AS message, au.path, '' AS occ, coalesce(related, '') AS related,
  '{{"reclaimableBytes":' || (size + coalesce(bytes, 0)) || ',"sizeBytes":' || size || ',"package":"' || package || '","declared":' || (declared_by IS NOT NULL) || ',"variantCount":' || coalesce(n, 0) || '}}' AS data,
  CAST(size + coalesce(bytes, 0) AS BIGINT) AS reclaimable_bytes FROM au LEFT JOIN v ON au.path = v.path WHERE variant_of IS NULL AND status = 0""")
def finding_unused_asset(spark, sf_dir):
    """UNUSED_ASSET, with variants' number and bytes."""
    return _flat(checks.unused_assets(context(spark, sf_dir)))


@query(""" SELECT 'info' AS severity, 'POSSIBLY_USED_ASSET' AS code, 'Dynamic references alone can reach ' || path || '; it is never reported as unused and never deleted.' AS message, path,
  (SELECT string_agg(file || ':1:' || col, ',' ORDER BY c) FROM (SELECT file, c, 23 + length(CAST(c AS VARCHAR)) AS col, row_number() OVER (ORDER BY c) AS i FROM dyn WHERE dyn.dir = au.dir) WHERE i <= 5) AS occ, '' AS related,
  '{"sizeBytes":' || size || ',"package":"' || package || '"}' AS data, CAST(0 AS BIGINT) AS reclaimable_bytes FROM au WHERE variant_of IS NULL AND status = 1""")
def finding_possibly_used(spark, sf_dir):
    """POSSIBLY_USED_ASSET with its first five occurrences."""
    return _flat(checks.possibly_used(context(spark, sf_dir)))


@query(""", n AS (SELECT dyn.c, count(*) AS n, string_agg(a.path, ',' ORDER BY a.path) AS related FROM dyn JOIN a ON starts_with(a.path, dyn.dir || '/') GROUP BY dyn.c)
SELECT 'info' AS severity, 'DYNAMIC_REFERENCE' AS code, 'Dynamic path `Image.asset(''' || dir || '/$x.png'')` stays below ' || dir || '/, so the ' || n || ' file(s) there count as possibly used.' AS message, dir AS path,
  file || ':1:' || (23 + length(CAST(dyn.c AS VARCHAR))) AS occ, related, '{"prefix":"' || dir || '","via":null,"coveredCount":' || n || '}' AS data, CAST(0 AS BIGINT) AS reclaimable_bytes FROM dyn JOIN n ON n.c = dyn.c""")
def finding_dynamic_reference(spark, sf_dir):
    """DYNAMIC_REFERENCE with all that it covers."""
    return _flat(checks.dynamic_references(context(spark, sf_dir)))


@query(f""" SELECT 'warning' AS severity, 'UNRESOLVABLE_DYNAMIC_REFERENCE' AS code, {_NO} AS path, '{{"reason":"`path` is a parameter of `load' || c || '` and no call site passes a value that can be traced."}}' AS data, file FROM r WHERE form = 7""")
def finding_unresolvable(spark, sf_dir):
    """UNRESOLVABLE_DYNAMIC_REFERENCE."""
    f = _flat(checks.unresolvable(context(spark, sf_dir)))
    return f.select("severity", "code", "path", "data", F.regexp_extract("occ", "^[^:]+", 0).alias("file"))


@query(""" SELECT * FROM (VALUES ('error', 'MISSING_DECLARED_ASSET', 'app declares `assets/readme.txt`, and there is nothing at that path.', 'assets/readme.txt', 'pubspec.yaml:31', '', '{"package":"app","entry":"assets/readme.txt","kind":"file"}', CAST(0 AS BIGINT)),
  ('error', 'MISSING_DECLARED_ASSET', 'app declares `fonts/roboto.ttf`, and there is nothing at that path.', 'fonts/roboto.ttf', 'pubspec.yaml:40', '', '{"package":"app","entry":"fonts/roboto.ttf","kind":"file"}', 0))
  AS t(severity, code, message, path, occ, related, data, reclaimable_bytes)""")
def finding_missing(spark, sf_dir):
    """MISSING_DECLARED_ASSET."""
    return _flat(checks.missing_declared(context(spark, sf_dir)))


@query(""" SELECT 'error' AS severity, 'UNDECLARED_REFERENCE' AS code, 'Code names `' || v || '`, which is neither on disk nor declared.' AS message, v AS path, file || ':1:' || (11 + length(CAST(c AS VARCHAR))) AS occ, '' AS related,
  '{"existsOnDisk":false,"via":null}' AS data, CAST(0 AS BIGINT) AS reclaimable_bytes FROM (SELECT *, dir || '/missing' || c || '.png' AS v FROM r WHERE form = 5)""")
def finding_undeclared_reference(spark, sf_dir):
    """UNDECLARED_REFERENCE, the first of each value."""
    return _flat(checks.undeclared_reference(context(spark, sf_dir)))


@query(""" SELECT 'warning' AS severity, 'UNDECLARED_ON_DISK' AS code, path || ' lies in an asset directory, yet no manifest entry covers it; it won''t ship.' AS message, path, '' AS occ, '' AS related,
  '{"package":"' || package || '","sizeBytes":' || size || '}' AS data, CAST(0 AS BIGINT) AS reclaimable_bytes FROM a WHERE variant_of IS NULL AND declared_by IS NULL""")
def finding_undeclared_on_disk(spark, sf_dir):
    """UNDECLARED_ON_DISK; variants are left out."""
    return _flat(checks.undeclared_on_disk(context(spark, sf_dir)))


@query(""" SELECT 'warning' AS severity, 'EMPTY_FILE' AS code, path || ' holds no bytes.' AS message, path, '' AS occ, '' AS related, '{"package":"' || package || '"}' AS data, CAST(0 AS BIGINT) AS reclaimable_bytes FROM a WHERE size = 0""")
def finding_empty_file(spark, sf_dir):
    """EMPTY_FILE."""
    return _of(checks.duplicates(context(spark, sf_dir)), "EMPTY_FILE")


_CONTENT = """, v AS (SELECT vec_id, label, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INTEGER) ELSE 0 END)) AS BIGINT) AS h FROM embeddings),
ct AS (SELECT p.dir || '/' || name AS path, CASE WHEN p_size = 13 THEN 0 ELSE p_size * 12000 + p.k % 7 END AS size, sha256(p_size || '/' || p_type) AS sha, p.k, label, name, p_name, p_type,
  CASE WHEN p.k % 4 = 0 THEN h END AS h, 62 + p.k % 3 AS height FROM p JOIN v ON vec_id = p.k % (SELECT count(*) FROM embeddings))"""


@query(f"""{_CONTENT}, g AS (SELECT sha, count(*) AS n, min(size) AS size, min(path) AS path, array_to_string(list_sort(list(path))[2:], ',') AS related FROM ct WHERE size > 0 GROUP BY sha HAVING count(*) > 1)
SELECT 'warning' AS severity, 'DUPLICATE_ASSETS' AS code, n || ' files hold the same bytes (' || {_bytes_sql('size')} || ' each, ' || {_bytes_sql('(size * (n - 1))')} || ' wasted).' AS message, path, '' AS occ, related,
  '{{"sha256":"' || sha || '","count":' || n || ',"sizeBytes":' || size || ',"reclaimableBytes":' || size * (n - 1) || '}}' AS data, CAST(size * (n - 1) AS BIGINT) AS reclaimable_bytes FROM g""")
def finding_duplicates(spark, sf_dir):
    """DUPLICATE_ASSETS."""
    return _of(checks.duplicates(context(spark, sf_dir)), "DUPLICATE_ASSETS")


@query(f"""{_CONTENT}, reps AS (SELECT sha, min(path) AS path FROM ct GROUP BY sha), m AS (SELECT ct.* FROM ct JOIN reps ON ct.path = reps.path WHERE h IS NOT NULL),
e AS (SELECT x.path AS a, y.path AS b FROM m x JOIN m y ON x.path <> y.path AND bit_count(xor(x.h, y.h)) <= 5),
w AS (SELECT a AS x, a AS y FROM e UNION SELECT w.x, e.b FROM w JOIN e ON w.y = e.a), c AS (SELECT x AS path, min(y) AS component FROM w GROUP BY x),
k AS (SELECT component, max(s) AS scaled FROM (SELECT component, h, count(DISTINCT height) > 1 AS s FROM c JOIN m ON c.path = m.path GROUP BY 1, 2) GROUP BY 1)
SELECT CASE WHEN scaled THEN 'SCALED_VARIANT' ELSE 'SIMILAR_ASSETS' END AS code, min(m.path) AS path, array_to_string(list_sort(list(m.path))[2:], ',') AS related,
  '{{"count":' || count(*) || ',"threshold":5,"dimensions":{{' || string_agg('"' || m.path || '":"64x' || height || '"', ',' ORDER BY m.path) || '}},"reclaimableBytes":' || CAST(sum(size) - max(size) AS BIGINT) || '}}' AS data,
  CAST(sum(size) - max(size) AS BIGINT) AS reclaimable_bytes FROM c JOIN m ON c.path = m.path JOIN k ON c.component = k.component GROUP BY c.component, scaled""")
def finding_similar_assets(spark, sf_dir):
    """SIMILAR_ASSETS and SCALED_VARIANT: one of each content, clustered by fingerprint."""
    return _flat(checks.similar_pictures(context(spark, sf_dir))).select("code", "path", "related", "data", "reclaimable_bytes")


@query(f"""{_CONTENT}, reps AS (SELECT sha, min(path) AS path FROM ct GROUP BY sha), m AS (SELECT ct.* FROM ct JOIN reps ON ct.path = reps.path WHERE ct.k % 4 = 2),
q AS (SELECT path, p_name AS t, length(p_name) - 1 AS n, p_name[i:i + 1] AS g, count(*) AS c FROM m, LATERAL (SELECT unnest(range(1, length(p_name))) AS i) GROUP BY ALL),
e AS (SELECT x.path AS a, y.path AS b FROM q x JOIN q y ON x.g = y.g AND x.path <> y.path GROUP BY x.path, y.path, x.n, y.n HAVING 2 * sum(least(x.c, y.c)) >= {similarity.similarity_ratio(5)} * (x.n + y.n)
  UNION SELECT x.path, y.path FROM m x JOIN m y ON x.p_type = y.p_type AND x.path <> y.path),
w AS (SELECT a AS x, a AS y FROM e UNION SELECT w.x, e.b FROM w JOIN e ON w.y = e.a), c AS (SELECT x AS path, min(y) AS component FROM w GROUP BY x)
SELECT 'SIMILAR_SVG' AS code, min(m.path) AS path, array_to_string(list_sort(list(m.path))[2:], ',') AS related,
  '{{"count":' || count(*) || ',"normalizedIdentical":' || (count(DISTINCT p_type) = 1) || ',"reclaimableBytes":' || CAST(sum(size) - max(size) AS BIGINT) || '}}' AS data, CAST(sum(size) - max(size) AS BIGINT) AS reclaimable_bytes
FROM c JOIN m ON c.path = m.path GROUP BY component""")
def finding_similar_svg(spark, sf_dir):
    """SIMILAR_SVG: equal normal forms, or near path geometry."""
    return _flat(checks.similar_svg(context(spark, sf_dir))).select("code", "path", "related", "data", "reclaimable_bytes")


@query(f""" SELECT 'warning' AS severity, 'LARGE_ASSET' AS code, path || ' takes ' || {_bytes_sql('size')} || ' (limit 500 KB). A WebP, or a smaller source with `2.0x/` variants, would help.' AS message, path, '' AS occ, '' AS related,
  '{{"sizeBytes":' || size || ',"limitKb":500}}' AS data, CAST(0 AS BIGINT) AS reclaimable_bytes FROM a WHERE size > 512000""")
def finding_large_asset(spark, sf_dir):
    """LARGE_ASSET."""
    return _of(checks.file_hygiene(context(spark, sf_dir)), "LARGE_ASSET")


@query(f"""{_CONTENT} SELECT 'info' AS severity, 'PNG_WITHOUT_ALPHA' AS code, path, CASE WHEN label % 3 = 0 THEN '{{"sizeBytes":' || size || '}}' ELSE '{{"sizeBytes":' || size || ',"alphaUnused":true}}' END AS data FROM ct WHERE k % 4 = 0 AND label % 3 < 2""")
def finding_png_alpha(spark, sf_dir):
    """PNG_WITHOUT_ALPHA, by channel and by use."""
    return _of(checks.file_hygiene(context(spark, sf_dir)), "PNG_WITHOUT_ALPHA").select("severity", "code", "path", "data")


@query(""", o AS (SELECT path, regexp_replace(path, '^.*/', '') AS name FROM a)
SELECT 'PROBLEMATIC_FILENAME' AS code, path, CASE WHEN contains(name, ' ') THEN path || ' contains spaces and uppercase letters; devices compare names byte by byte.' ELSE path || ' contains uppercase letters; devices compare names byte by byte.' END AS message,
  CASE WHEN contains(name, ' ') THEN '{"problems":["spaces","uppercase letters"]}' ELSE '{"problems":["uppercase letters"]}' END AS data FROM o WHERE regexp_matches(name, '[A-Z ]')""")
def finding_filenames(spark, sf_dir):
    """PROBLEMATIC_FILENAME (F8)."""
    return _of(checks.file_hygiene(context(spark, sf_dir)), "PROBLEMATIC_FILENAME").select("code", "path", "message", "data")


@query(""" SELECT 'error' AS severity, 'CASE_COLLISION' AS code, count(*) || ' paths differ in case alone: fine on some systems, broken where case counts.' AS message, min(path) AS path, array_to_string(list_sort(list(path))[2:], ',') AS related FROM a GROUP BY lower(path) HAVING count(*) > 1""")
def finding_case_collision(spark, sf_dir):
    """CASE_COLLISION (A2)."""
    return _of(checks.file_hygiene(context(spark, sf_dir)), "CASE_COLLISION").select("severity", "code", "message", "path", "related")


@query(""" SELECT * FROM (VALUES ('UNUSED_FONT_FAMILY', 'fonts/roboto.ttf', 'Font family "Roboto" of app is named in no string, so no style selects it.', 'pubspec.yaml:40', '{"package":"app","family":"Roboto"}'),
  ('EMPTY_ASSET_DIRECTORY', 'assets/empty', 'app declares `assets/empty/`, a directory without files.', 'pubspec.yaml:30', '{"package":"app"}')) AS t(code, path, message, occ, data)""")
def finding_fonts_and_empty_directories(spark, sf_dir):
    """UNUSED_FONT_FAMILY and EMPTY_ASSET_DIRECTORY."""
    ctx = context(spark, sf_dir)
    return _flat(checks.unused_fonts(ctx).unionByName(checks.empty_directories(ctx))).select("code", "path", "message", "occ", "data")


_TALLY = """, n AS (SELECT (SELECT count(*) FROM au WHERE variant_of IS NULL AND status = 0) AS unused, (SELECT count(*) FROM au WHERE variant_of IS NULL AND status = 1) AS possibly, (SELECT count(*) FROM dyn) AS dynamic, (SELECT count(*) FROM r WHERE form = 7) AS lost,
  (SELECT count(*) FROM r WHERE form = 5) AS typos, (SELECT count(*) FROM a WHERE variant_of IS NULL AND declared_by IS NULL) AS strays, (SELECT count(*) FROM a) AS assets,
  (SELECT coalesce(sum(x.size), 0) + coalesce(sum((SELECT sum(v.size) FROM a v WHERE v.variant_of = x.path)), 0) FROM au x WHERE variant_of IS NULL AND status = 0) AS bytes)"""


@query(f"""{_TALLY} SELECT assets AS asset_count, unused, possibly AS possibly_used, CAST(bytes AS BIGINT) AS reclaimable, dynamic AS dynamic_references, lost AS unresolvable, typos + 2 AS errors, unused + lost + strays AS warnings, possibly + dynamic AS infos FROM n""")
def project_summary(spark, sf_dir):
    """Counters over the findings of two checks."""
    ctx = context(spark, sf_dir)
    parts = checks.unused(ctx) + checks.missing(ctx)
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    s = audit.summarize(ctx, all_)
    row = (s["assetCount"], s["unused"], s["possiblyUsed"], s["reclaimableBytes"], s["dynamicReferences"], s["unresolvableReferences"], s["errors"], s["warnings"], s["info"])
    return spark.createDataFrame([row], "asset_count long, unused long, possibly_used long, reclaimable long, dynamic_references long, unresolvable long, errors long, warnings long, infos long")


@query(""", f AS (SELECT 'error' AS severity, 'UNDECLARED_REFERENCE' AS code, dir || '/missing' || c || '.png' AS path FROM r WHERE form = 5 UNION ALL SELECT 'error', 'MISSING_DECLARED_ASSET', unnest(['assets/readme.txt', 'fonts/roboto.ttf'])
  UNION ALL SELECT 'warning', 'UNDECLARED_ON_DISK', path FROM a WHERE variant_of IS NULL AND declared_by IS NULL)
SELECT row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, code, path) AS i, severity, code, path FROM f""")
def findings_order(spark, sf_dir):
    """Findings sorted by severity, code and path (O1, O2)."""
    parts = checks.missing(context(spark, sf_dir))
    in_order = checks.ordered(parts[0].unionByName(parts[1]).unionByName(parts[2])).select("severity", "code", "path")
    return groups.numbered(in_order, "i").select("i", "severity", "code", "path")


@query(""" SELECT path, size AS size_bytes FROM au WHERE variant_of IS NULL AND status = 0 UNION ALL SELECT v.path, v.size FROM a v JOIN au x ON v.variant_of = x.path WHERE x.status = 0""")
def delete_candidates(spark, sf_dir):
    """What a deletion would take: unused assets and their variants, never possibly used ones."""
    ctx = context(spark, sf_dir)
    f = checks.unused_assets(ctx)
    named = f.select(F.explode(F.array_union(F.array("path"), "related_paths")).alias("path"))
    return named.join(ctx.project.assets.select("path", "size_bytes"), "path")
