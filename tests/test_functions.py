"""Scalar functions and operators on rows, against golden values and brute force."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.functions import paths, similarity, svg
from gleaner.operators import groups, match, similar
from gleaner.operators.cluster import connected_components
from gleaner.sources import dart, images


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("path,want", [("assets\\images\\logo.png", "assets/images/logo.png"), ("./assets//logo.png", "assets/logo.png"), (" a/../b ", "a/../b"), ("././a", "./a")])
def test_normalize(spark, path, want):
    assert one(spark, paths.normalize_asset_path("v"), path) == want


def test_paths(spark):
    r = one(spark, paths.package_reference("v"), "packages/design/assets/star.png")
    assert (r["package"], r["rest"]) == ("design", "assets/star.png") and one(spark, paths.package_reference("v"), "assets/star.png") is None
    assert [one(spark, paths.variant_scale("v"), d) for d in ("2.0x", "3x", "images")] == [2.0, 3.0, None]
    assert [one(spark, paths.human_bytes("v"), n, "long") for n in (512, 2048, 3 << 20, 1280, 200 << 10)] == ["512 B", "2.0 KB", "3.0 MB", "1.3 KB", "200 KB"]
    assert [one(spark, paths.camel_case("v"), s) for s in ("arrow_back", "My-icon 2", "a.b")] == ["arrowBack", "myIcon2", "aB"]
    assert one(spark, paths.ancestors("v"), "a/b/c.png") == ["a", "a/b"] and one(spark, paths.ancestors("v"), "x") == []
    assert [one(spark, paths.extension("v"), p) for p in ("a/B.PNG", "a/.hid", "a")] == [".png", "", ""]
    assert one(spark, paths.truncate("v"), "x \n y") == "x y" and len(one(spark, paths.truncate("v"), "z" * 200)) == 120
    assert one(spark, paths.markdown_escape("v"), "a|b\nc") == r"a\|b c"
    assert one(spark, paths.relative_posix("v", "/p/q"), "/p/q/r\\s") == "r/s"
    assert one(spark, paths.filename_problems("v"), "My é.png") == ["spaces", "uppercase letters", "non-ASCII characters"]
    occ = F.struct(F.lit("f").alias("file"), F.lit(3).alias("line"), F.lit(None).cast("int").alias("column"))
    assert one(spark, paths.display(occ)) == "f:3"


@pytest.mark.parametrize("glob,yes,no", [("assets/legacy/**", ["assets/legacy/a/b.png"], ["assets/x.png"]), ("**/*.json", ["a/b.json", "c.json"], ["a.jsonx"]), ("*.png", ["a.png"], ["d/a.png"]), ("a{b,c}?", ["abx", "acy"], ["adx", "ab"]), ("[!a]x", ["bx"], ["ax"])])
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(p,) for p in yes + no], "p string").where(paths.is_ignored("p", [glob]))
    assert sorted(r.p for r in df.collect()) == sorted(yes)


def test_asset_shapes(spark):
    yes, no = ["assets/a.png", "x/y.jpeg"], ["", "http://a/b.png", "package:a/b.png", "/a/b.png", "a/$x.png", "a.png", "a/*.png", "a/b", "a/b.dart", "a/b.toolong"]
    df = spark.createDataFrame([(p,) for p in yes + no], "p string").where(paths.looks_like_asset_path("p"))
    assert sorted(r.p for r in df.collect()) == sorted(yes)


def test_hamming_and_ratio(spark):
    for a, b, d in ((0, 0, 0), (0, 1, 1), (15, 0, 4), (-1, 0, 64)):
        assert spark.range(1).select(similarity.hamming(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("d")).first().d == d
    assert similarity.similarity_ratio(5) == 0.921875 and similarity.similarity_ratio(64) == 0.5


def test_svg_forms():
    a = '<?xml version="1.0"?><!DOCTYPE svg><!-- c -->\n<svg id="a">\n <path id="p" d="M10.001 20.002"/></svg>'
    assert svg.normalize(a) == svg.normalize('<svg id="b"><path d="M10.004 20.001"/></svg>') == '<svg><path d="M10 20"/></svg>'
    assert svg.normalize("<html/>") is None and svg.path_data('<svg><path d="M1 2 L3 4"/><path d="M5 6"/></svg>') == "M1 2 L3 4 M5 6"
    assert svg.normalize("<svg>-0.001 1.005 2.50</svg>") == "<svg>-0 1 2.5</svg>"


def test_images():
    from helpers import png

    f = images.fingerprint(images.decode_png(png()))
    assert (f["width"], f["height"], f["d_hash"], f["has_alpha"], f["uses_transparency"]) == (64, 64, 0, True, False)
    assert images.fingerprint(images.decode_png(png(32, 32, "reverse")))["d_hash"] == -1
    assert images.decode_png(b"junk") is None and images.decode_png(png()[:60]) is None


def test_hamming_pairs_equal_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.getrandbits(64) - (1 << 63)) for i in range(60)]
    rows += [(100 + i, rows[i][1] ^ (1 << r.randrange(60)) ^ (1 << r.randrange(60))) for i in range(20)] + [(200, rows[0][1]), (201, None)]
    df = spark.createDataFrame(rows, "k long, h long")
    for t in (0, 2, 5):
        got = {(x.a, x.b) for x in similar.hamming_pairs(df, "k", "h", t).collect()}
        want = {(a, b) for (a, x), (b, y) in itertools.combinations([r for r in rows if r[1] is not None and r[0] != 200], 2) if bin((x ^ y) & (1 << 64) - 1).count("1") <= t}
        assert got == want | {(0, 200)}


def test_dice_pairs_equal_brute_force(spark):
    from collections import Counter

    r = random.Random(2)
    rows = []
    for i in range(25):
        t = "".join(r.choice("abcd") for _ in range(r.randrange(1, 40)))
        rows += [(2 * i, t), (2 * i + 1, t[:-1] + r.choice("abcd"))]
    rows += [(100, ""), (101, "a"), (102, "a"), (103, None)]
    first = {}
    for k, t in rows:
        if t:
            first.setdefault(t, k)
    grams = {k: Counter(t[i : i + 2] for i in range(len(t) - 1)) for t, k in first.items()}
    for ratio in (0.5, 0.921875):
        want = {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(grams.items()), 2) if x and y and 2 * (x & y).total() >= ratio * (x.total() + y.total())}
        want |= {(first[t], k) for k, t in rows if t and first[t] != k}
        assert {(x.a, x.b) for x in similar.dice_pairs(spark.createDataFrame(rows, "k long, t string"), "k", "t", ratio).collect()} == want


@pytest.mark.parametrize("chunk", [3, 500_000])
def test_components_equal_brute_force(monkeypatch, spark, chunk):
    from gleaner.operators import cluster

    monkeypatch.setattr(cluster, "CHUNK", chunk)
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(12)] + [(r.randrange(50, 90), r.randrange(50, 90)) for _ in range(20)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long"), max_rounds=20).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_groups(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", ""), ("e", ""), ("f", None)], "k string, t string")
    g = groups.duplicate_groups(df, "k", "t").collect()
    assert len(g) == 1 and (g[0].path, g[0].related, g[0]["count"], g[0].wasted) == ("a", ["b"], 2, 1)
    names = spark.createDataFrame([("A",), ("a",), ("a",), ("b",)], "n string")
    assert [(x.path, x.related) for x in groups.case_collisions(names, "n").collect()] == [("A", ["a"])]
    marks = spark.createDataFrame([("p", 1, 2, "o2"), ("p", 2, 1, "o1"), ("q", 1, 5, "o5")], "path string, status int, ord int, occ string")
    usage = groups.merge_usage(marks, ["path"], occurrence="occ")
    assert {x.path: (x.status, x.occurrences) for x in usage.collect()} == {"p": (2, ["o1", "o2"]), "q": (1, ["o5"])}
    items = spark.createDataFrame([("p", None), ("v", "p"), ("z", None)], "path string, variant_of string")
    full = groups.propagate_variants(groups.lookup_usage(items, usage, ["path"]))
    assert {x.path: x.status for x in full.collect()} == {"p": 2, "v": 2, "z": 0}


def test_longest_directory(spark):
    seg = spark.createDataFrame([(1, "x/assets/icons/a"), (1, "assets"), (2, "none"), (3, "ab")], "ref long, s string")
    dirs = spark.createDataFrame([("assets", 1), ("assets/icons", 2), ("a", 3), ("b", 4)], "dir string, i long")
    assert {r.ref: r.dir for r in match.longest_directory(seg, "ref", "s", dirs, "dir", "i").collect()} == {1: "assets/icons", 3: "a"}


def test_longest_directory_in_long_segments(spark):
    deep = "d" * 300
    text = ["x" * k + "assets/icons/" + "y" * 1000 for k in (0, 250, 255, 4321)] + ["z" * 500, "q" * 200 + deep + "/r"]
    seg = spark.createDataFrame(list(enumerate(text)), "ref long, s string")
    dirs = spark.createDataFrame([("assets", 1), ("assets/icons", 2), (deep, 3)], "dir string, i long")
    got = {r.ref: r.dir for r in match.longest_directory(seg, "ref", "s", dirs, "dir", "i").collect()}
    assert got == {**dict.fromkeys(range(4), "assets/icons"), 5: deep}
    assert match.longest_directory(seg, "ref", "s", dirs.limit(0), "dir", "i").count() == 0


def test_whole_dice_pairs_of_long_documents(spark, tmp_path):
    from __spark_entry__ import queries
    from gleaner.plans.catalog import _RATIO

    r = random.Random(6)
    base = [" ".join("".join(r.choice("abcdefgäß😀") for _ in range(r.randrange(2, 8))) for _ in range(n)) for n in (150, 150, 900, 3)]
    texts = [x for b in base for x in (b, b, b[:-2] + "zz", b[: len(b) * 2 // 3])] + ["", None, "a", "a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = [Counter(t[i : i + 2] for i in range(len(t) - 1)) if t else Counter() for t in texts]
    of = texts.index
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] and texts[a] == texts[b] and a == of(texts[b])}
    want |= {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] != texts[b] and a == of(texts[a]) and b == of(texts[b]) and grams[a] and grams[b] and 2 * (grams[a] & grams[b]).total() >= _RATIO * (grams[a].total() + grams[b].total())}
    assert any(len(texts[a]) > 400 and texts[a] != texts[b] for a, b in want)
    assert {(x.a, x.b) for x in queries()["dice_pairs"](spark, str(tmp_path)).collect()} == want
    assert {x.node: x.component for x in queries()["dice_clusters"](spark, str(tmp_path)).collect()}[2] == 0


def rows(src):
    return dart.read(src, "a.dart")


def test_source_reader_rules():
    r = rows("class A { static const x = 'p/q.png'; final y = f('in/call.png'); }")
    assert {(x["name"], x["expr"]) for x in r if x["kind"] == "constant"} == {("x", '["lit", "p/q.png"]'), ("A.x", '["lit", "p/q.png"]')}
    assert [x["expr"] for x in r if x["kind"] == "candidate"] == ['["lit", "in/call.png"]']
    assert {x["name"] for x in r if x["kind"] == "literal"} == {"p/q.png", "in/call.png"}
    r = rows("void f(String a, {required String path}) { Image.asset(path); }")
    p = next(x for x in r if x["kind"] == "pending")
    assert (p["name"], p["parameter"], p["index"]) == ("f", "path", 1)
    r = rows("final s = Image.asset('a/$b.png', package: 'design');")
    c = next(x for x in r if x["kind"] == "candidate" and x.get("load"))
    assert c["package"] == "design" and c["expr"] == '["seq", [["lit", "a/"], ["ref", "b"], ["lit", ".png"]]]'
    assert sum(x["kind"] == "candidate" and "a/" in x["expr"] for x in r) == 1
    assert [x["name"] for x in rows("var z = A.b.c;\nvoid g() { h(A.b.c); }") if x["kind"] == "use"].count("A.b.c") == 2
    for broken in ("class {", "'open", "a ${", "f(((", "/* x", "'''", "@", "r'", "'$'", ""):
        rows(broken)
    assert [x["name"] for x in rows(r"""var a = 'it\'s \u{41}'; var b = r'\n'; var c = '''
x'''; // 'no' """) if x["kind"] == "literal"] == ["it's A", r"\n", "x"]
