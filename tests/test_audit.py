"""Whole audits of small project trees."""

import struct

from helpers import only, paths, png, pubspec

A = "assets/images/"


def app(tree, files=None, code="", assets=(A,), **kw):
    return tree.files({"pubspec.yaml": pubspec(assets=assets, **kw), "lib/main.dart": code} | (files or {}))


def test_references_of_every_kind(tree):
    code = """
import 'package:flutter/widgets.dart';
class AppAssets {
  static const logo = 'assets/images/logo.png';
  static const never = 'assets/images/never.png';
}
const base = 'assets/images/';
final a = Image.asset('assets/images/used.png');
final b = Image.asset(AppAssets.logo);
final c = show('assets/images/'
    'adjacent.png');
final d = Image.asset(base + 'plus.png');
Widget e() => Assets.images.byConvention.image();
"""
    names = ["used", "logo", "never", "adjacent", "plus", "by_convention", "orphan", "native"]
    files = {f"{A}{n}.png": png(tweak=i + 3) for i, n in enumerate(names)}
    files["web/index.html"] = "<img src='splash/native.png'>"
    r = app(tree, files, code).audit("unused")
    assert paths(r, "UNUSED_ASSET") == [A + "never.png", A + "orphan.png"]
    f = next(f for f in r.rows if f["path"] == A + "orphan.png")
    assert f["severity"] == "warning" and f["data"]["reclaimableBytes"] == f["data"]["sizeBytes"] == f["reclaimable_bytes"]
    assert f["data"]["declared"] is True and f["data"]["package"] == "app" and f["data"]["variantCount"] == 0
    assert r.summary["unused"] == 2 and r.summary["assetCount"] == 8
    assert r.should_fail("warning") and not r.should_fail("error") and not r.should_fail(None)


def test_generated_accessors(tree):
    gen = """/// FlutterGen
class $AssetsImagesGen {
  const $AssetsImagesGen();
  AssetGenImage get logo => const AssetGenImage('assets/images/logo.png');
  AssetGenImage get unusedGen => const AssetGenImage('assets/images/unused_gen.png');
}
class Assets {
  Assets._();
  static const $AssetsImagesGen images = $AssetsImagesGen();
}
"""
    files = {A + "logo.png": png(tweak=3), A + "unused_gen.png": png(tweak=4), "lib/gen/assets.gen.dart": gen}
    r = app(tree, files, "Widget w() => Assets.images.logo.image();").audit("unused")
    assert paths(r, "UNUSED_ASSET") == [A + "unused_gen.png"]


FLAGS = {f"assets/flags/{c}.png": png(tweak=i + 3) for i, c in enumerate(("us", "de", "fr"))}


def test_dynamic_prefix(tree):
    code = "Widget f(String code) => Image.asset('assets/flags/$code.png');"
    r = app(tree, FLAGS | {A + "orphan.png": png()}, code, assets=("assets/flags/", A)).audit("unused")
    assert paths(r, "POSSIBLY_USED_ASSET") == sorted(FLAGS) and paths(r, "UNUSED_ASSET") == [A + "orphan.png"]
    d = only(r, "DYNAMIC_REFERENCE")
    assert d["path"] == "assets/flags" and d["related_paths"] == sorted(FLAGS) and d["data"]["coveredCount"] == 3
    assert d["occurrences"][0]["file"] == "lib/main.dart" and d["occurrences"][0]["line"] == 1
    r = tree.audit("unused", treat_dynamic_as_used=False)
    assert paths(r, "UNUSED_ASSET") == sorted([*FLAGS, A + "orphan.png"]) and only(r, "DYNAMIC_REFERENCE")


def test_parameters_and_wildcard(tree):
    loader = "Future<String> loadAsset(String path) async => rootBundle.loadString(path);\n"
    app(tree, {"assets/data/config.json": "{}"}, loader, assets=("assets/data/",))
    r = tree.audit("unused")
    u = only(r, "UNRESOLVABLE_DYNAMIC_REFERENCE")
    assert u["severity"] == "warning" and u["path"] is None and paths(r, "UNUSED_ASSET") == ["assets/data/config.json"]
    r = tree.audit("unused", treat_unresolvable_as_wildcard=True)
    assert paths(r, "POSSIBLY_USED_ASSET") == ["assets/data/config.json"]
    tree.files({"lib/other.dart": "void f() { loadAsset('assets/data/config.json'); }"})
    r = tree.audit("unused")
    assert not paths(r, "UNRESOLVABLE_DYNAMIC_REFERENCE") and not paths(r, "UNUSED_ASSET")
    tree.files({"lib/other.dart": "void f() { loadAsset(path: 'x/y.json'); }"})
    assert paths(tree.audit("unused"), "UNRESOLVABLE_DYNAMIC_REFERENCE") == [""]


def test_variants(tree):
    files = {A + "logo.png": png(), A + "2.0x/logo.png": png(128, 128), A + "3.0x/logo.png": png(96, 96)}
    r = app(tree, files, "").audit()
    u = only(r, "UNUSED_ASSET")
    assert u["path"] == A + "logo.png" and u["related_paths"] == [A + "2.0x/logo.png", A + "3.0x/logo.png"] and u["data"]["variantCount"] == 2
    assert not paths(r, "SIMILAR_ASSETS") and not paths(r, "SCALED_VARIANT") and not paths(r, "UNDECLARED_ON_DISK")
    tree.files({"lib/main.dart": "void f() { g('assets/images/2.0x/logo.png'); }"})
    assert not paths(tree.audit("unused"), "UNUSED_ASSET")


def test_packages(tree):
    tree.files({
        "pubspec.yaml": pubspec("app", ["assets/"]), "assets/own.png": png(tweak=9),
        "assets/both.png": png(tweak=5),
        "lib/main.dart": "final a = Image.asset('packages/design/assets/icons/star.png'); final b = Image.asset('assets/both.png', package: 'design'); final c = f('assets/own.png');",
        "packages/design/pubspec.yaml": pubspec("design", ["assets/", "assets/icons/"]),
        "packages/design/assets/icons/star.png": png(), "packages/design/assets/icons/unused.png": png(tweak=7), "packages/design/assets/both.png": png(tweak=6),
    })
    r = tree.audit("unused")
    assert paths(r, "UNUSED_ASSET") == ["assets/both.png", "packages/design/assets/icons/unused.png"]
    assert r.summary["packageCount"] == 2


def test_missing_and_undeclared(tree):
    fonts = "    - family: Roboto\n      fonts:\n        - asset: fonts/roboto.ttf\n"
    code = "final a = Image.asset('assets/images/typo.png'); final b = f('assets/**/*.json'); final c = f('assets/other/there.png');"
    files = {A + "ok.png": png(), A + "nested/deep.png": png(tweak=2), "assets/extra/stray.png": png(tweak=3), "assets/empty/.keep": "", "other/x": ""}
    tree.files({"pubspec.yaml": pubspec(assets=[A, A + "absent.png", "assets/empty/"], fonts=fonts), "lib/main.dart": code} | files)
    r = tree.audit("missing", "hygiene")
    assert paths(r, "MISSING_DECLARED_ASSET") == [A + "absent.png", "fonts/roboto.ttf"]
    m = next(f for f in r.rows if f["path"] == A + "absent.png")
    assert m["severity"] == "error" and m["occurrences"][0]["line"] == 11 and m["data"]["kind"] == "file"
    u = [f for f in r.rows if f["code"] == "UNDECLARED_REFERENCE"]
    assert [f["path"] for f in u] == ["assets/images/typo.png", "assets/other/there.png"] and not u[0]["data"]["existsOnDisk"]
    assert paths(r, "UNDECLARED_ON_DISK") == ["assets/extra/stray.png", A + "nested/deep.png"]
    assert paths(r, "EMPTY_ASSET_DIRECTORY") == ["assets/empty"]
    f = only(r, "UNUSED_FONT_FAMILY")
    assert f["path"] == "fonts/roboto.ttf"
    assert r.should_fail("error")
    assert paths(tree.audit("missing", ignore=("assets/extra/**",)), "UNDECLARED_ON_DISK") == [A + "nested/deep.png"]


def test_pure_code_package_reports_no_undeclared_reference(tree):
    tree.files({"pubspec.yaml": pubspec("tool", flutter=False), "lib/a.dart": "final x = f('assets/none.png');", "assets/a.txt": "x"})
    assert not paths(tree.audit("missing"), "UNDECLARED_REFERENCE")


def test_duplicates_and_empties(tree):
    same = png(tweak=3)
    files = {"assets/brand.png": same, A + "logo.png": same, A + "logo_copy.png": same, A + "zero.png": b"", A + "nil.png": b""}
    r = app(tree, files, "", assets=(A, "assets/")).audit("duplicates")
    d = only(r, "DUPLICATE_ASSETS")
    assert d["path"] == "assets/brand.png" and d["related_paths"] == [A + "logo.png", A + "logo_copy.png"]
    assert d["data"]["count"] == 3 and d["reclaimable_bytes"] == 2 * len(same)
    assert paths(r, "EMPTY_FILE") == [A + "nil.png", A + "zero.png"]


SVG = '<?xml version="1.0"?><!-- c --><svg id="a1"><path d="M10.001 20 L30 40.004" id="p"/></svg>'


def test_similar(tree):
    files = {
        A + "big.png": png(), A + "small.png": png(32, 32), A + "opposite.png": png(pattern="reverse"), A + "re.png": png(pattern="reverse", tweak=7),
        A + "a.svg": SVG, A + "b.svg": '<svg id="zz">\n  <path d="M10.004 20 L30 40.001" id="q"/> </svg>', A + "c.svg": '<svg><path d="M900 1 C5 5 77 8"/></svg>',
    }
    r = app(tree, files, "").audit("similar")
    s = only(r, "SCALED_VARIANT")
    assert s["path"] == A + "big.png" and s["related_paths"] == [A + "small.png"] and s["data"]["dimensions"] == {A + "big.png": "64x64", A + "small.png": "32x32"}
    assert only(r, "SIMILAR_ASSETS")["related_paths"] == [A + "re.png"]
    v = only(r, "SIMILAR_SVG")
    assert v["data"]["normalizedIdentical"] is True and v["related_paths"] == [A + "b.svg"]
    r = tree.audit("similar", max_hash_size=10)
    assert not paths(r, "SIMILAR_ASSETS") and not paths(r, "SCALED_VARIANT") and paths(r, "SIMILAR_SVG")


def test_near_svgs_by_geometry(tree):
    d = " ".join(f"L{i} {i * 3}" for i in range(100))
    files = {A + "a.svg": f'<svg><path d="M1 1 {d}"/></svg>', A + "b.svg": f'<svg><path d="M1 2 {d}"/></svg>'}
    v = only(app(tree, files, "").audit("similar"), "SIMILAR_SVG")
    assert v["data"]["normalizedIdentical"] is False


def test_hygiene(tree):
    files = {A + "big.png": b"x" * 3000, A + "rgb.png": png(alpha=False), A + "opaque.png": png(tweak=4), A + "clear.png": png(opaque=False), A + "My Icon é.png": png(tweak=8)}
    r = app(tree, files, "").audit("hygiene", max_file_size_kb=1)
    assert paths(r, "LARGE_ASSET") == [A + "big.png"]
    hints = {f["path"]: f["data"].get("alphaUnused") for f in r.rows if f["code"] == "PNG_WITHOUT_ALPHA"}
    assert hints == {A + "rgb.png": None, A + "opaque.png": True, A + "My Icon é.png": True}
    assert only(r, "PROBLEMATIC_FILENAME")["data"]["problems"] == ["spaces", "uppercase letters", "non-ASCII characters"]


def test_case_collision_on_rows(spark):
    from gleaner.plans.checks import case_collisions

    df = spark.createDataFrame([("assets/logo.png",), ("assets/Logo.png",), ("assets/other.png",)], "path string")
    r = case_collisions(df).collect()
    assert len(r) == 1 and r[0]["path"] == "assets/Logo.png" and r[0]["related_paths"] == ["assets/logo.png"] and r[0]["severity"] == "error"


def test_order_and_custom_check(tree, spark):
    from gleaner.config import AuditConfig
    from gleaner.plans import audit, checks
    from pyspark.sql import functions as F

    app(tree, {A + "orphan.png": png(), A + "Zed.png": png(tweak=3)}, "final x = Image.asset('assets/images/typo.png');")
    mine = lambda ctx: [checks.finding(ctx.assets, "info", "MINE", F.lit("seen"), "path")]
    r = audit.run(spark, AuditConfig(str(tree.root)), checks.REGISTRY | {"mine": mine})
    key = [({"error": 0, "warning": 1, "info": 2}[f["severity"]], f["code"], f["path"] or "") for f in r.rows]
    assert key == sorted(key) and len(paths(r, "MINE")) == 2


def bmp(size: int) -> bytes:
    """A 24-bit grey ramp."""
    row = b"".join(bytes([(x * 255) // (size - 1)] * 3) for x in range(size))
    body = (row + bytes(-len(row) % 4)) * size
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, size, size, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def test_scaled_variants_of_names_with_an_underscore(tree):
    r = app(tree, {A + "_big.bmp": bmp(64), A + "small.bmp": bmp(32)}, "").audit("similar")
    s = only(r, "SCALED_VARIANT")
    assert {s["path"], *s["related_paths"]} == {A + "_big.bmp", A + "small.bmp"}


def test_dictionaries_of_needed_names_alone(tree, monkeypatch):
    """A large project's dictionary holds what expressions lead to, constants of constants included."""
    import pytest

    from gleaner.plans import resolve

    code = """
const folder = 'assets/images/';
class K { static const stem = folder + 'chain'; static const full = stem + '.png'; static const unusedName = 'x'; }
final a = Image.asset(K.full);
Widget e() => Assets.images.byConvention.image();
"""
    gen = "/// FlutterGen\nclass $AssetsPicsGen {\n  AssetGenImage get logo => const AssetGenImage('assets/images/logo.png');\n}\nclass Made {\n  static const $AssetsPicsGen pics = $AssetsPicsGen();\n}\n"
    files = {f"{A}{n}.png": png(tweak=i + 3) for i, n in enumerate(["chain", "by_convention", "logo", "orphan"])} | {"lib/gen/made.gen.dart": gen, "lib/b.dart": "final l = Made.pics.logo;"}
    app(tree, files, code)
    want = tree.audit("unused").rows
    assert [f["path"] for f in want if f["code"] == "UNUSED_ASSET"] == [A + "orphan.png"]
    monkeypatch.setattr(resolve, "SMALL", 0)
    assert tree.audit("unused").rows == want
    monkeypatch.setattr(resolve, "MOST", 1)
    with pytest.raises(RuntimeError, match="names"):
        tree.audit("unused")


def test_public_names_and_a_hasher_of_ones_own(tree, spark):
    import gleaner

    assert all(getattr(gleaner, n) is not None for n in gleaner.__all__) and gleaner.REGISTRY
    app(tree, {A + "a.png": png(), A + "b.png": png(pattern="reverse"), A + "c.txt": "x"}, "")

    def one(img):  # every picture looks alike
        return img is not None and {"width": 1, "height": 1, "d_hash": 7, "has_alpha": False, "uses_transparency": False} or None

    config = gleaner.AuditConfig(str(tree.root), checks=frozenset(["similar"]))
    r = gleaner.Runner(hasher=one).run(spark, config)
    assert only(r, "SIMILAR_ASSETS")["related_paths"] == [A + "b.png"]
    assert not gleaner.Runner({}).run(spark, config).rows


def test_interlaced_png():
    import numpy as np

    from gleaner.plans.treescan import _png
    from gleaner.sources.images import decode_png

    r = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 5), (8, 9), (17, 2)):
        v = r.integers(0, 256, (h, w)).astype(np.uint8)
        for kind in range(3):
            plain, laced = decode_png(_png(v, kind, 90, False)), decode_png(_png(v, kind, 90, True))
            assert (plain == laced).all() and (laced[:, :, 0] == v).all()


def test_no_machine_local_scratch_on_a_cluster(monkeypatch):
    from types import SimpleNamespace as S

    import pytest

    from gleaner import scratch

    fs = S(getUri=lambda: S(getScheme=lambda: "file"))
    jvm = S(org=S(apache=S(hadoop=S(fs=S(FileSystem=S(get=lambda _: fs))))))
    context = S(getConf=lambda: S(get=lambda k: None), applicationId="a-cluster", master="yarn", _jvm=jvm)
    fake = S(sparkContext=context, conf=S(get=lambda k, d: None), _jsc=S(hadoopConfiguration=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(fake)
