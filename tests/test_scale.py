"""What keeps work in proportion to the tables, and whole: brute force on small ones, plans where time would tell too late."""

import itertools
import random

from pyspark.sql import functions as F

from gleaner.operators import groups, match, similar


def _brute(rows, t):
    return sorted((min(a, b), max(a, b), bin((x ^ y) & (1 << 64) - 1).count("1")) for (a, x), (b, y) in itertools.combinations([r for r in rows if r[1] is not None], 2) if a != b and bin((x ^ y) & (1 << 64) - 1).count("1") <= t)


def _words(seed=1):
    r = random.Random(seed)
    rows = [(i, r.getrandbits(64) - (1 << 63)) for i in range(60)]
    rows += [(100 + i, rows[i][1] ^ (1 << r.randrange(60)) ^ (1 << r.randrange(60))) for i in range(20)]
    return rows + [(200 + i, rows[i % 3][1]) for i in range(9)] + [(300, None)]


def test_all_hamming_pairs_hold_equal_words(spark, monkeypatch):
    rows = _words()
    df = spark.createDataFrame(rows, "k long, h long")
    for t, block, chunk in ((2, 16384, 1000), (20, 7, 2), (26, 16384, 1000)):
        monkeypatch.setattr(similar, "BLOCK", block)
        monkeypatch.setattr(similar, "CHUNK", chunk)
        assert sorted((r.a, r.b, r.distance) for r in similar.all_hamming_pairs(df, "k", "h", t).collect()) == _brute(rows, t)


def test_phash_pairs_of_equal_embeddings(spark, tmp_path):
    from gleaner.plans import catalog

    r = random.Random(4)
    vectors = [[r.random() for _ in range(64)] for _ in range(5)]
    rows = [(i, [float(x) for x in vectors[i % 5]], i % 3) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(x.a, x.b) for x in catalog.QUERIES["phash_pairs"](spark, str(tmp_path)).collect()}
    assert {(a, b) for a, b in itertools.combinations(range(20), 2) if a % 5 == b % 5} <= got
    assert {x.node: x.component for x in catalog.QUERIES["phash_clusters"](spark, str(tmp_path)).collect()}.keys() == set(range(20))


def test_hamming_clusters_equal_those_of_all_pairs(spark):
    from gleaner.operators.cluster import connected_components

    df = spark.createDataFrame(_words(2) + [(5, 7), (6, 7)], "k long, h long")  # 5 and 6 stand for two words each
    for t in (2, 22):
        want = {(r.node, r.component) for r in connected_components(similar.all_hamming_pairs(df, "k", "h", t), "a", "b").collect()}
        assert {(r.node, r.component) for r in similar.hamming_clusters(df, "k", "h", t).collect()} == want


def test_cascade_of_repeated_customers(spark, tmp_path):
    from gleaner.plans import catalog

    spark.createDataFrame([(0, "A", 0), (1, "B", 0), (2, "C", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(10, 0, 7000.0), (11, 0, 9000.0), (11, 2, 9000.0), (12, 1, 1.0)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    # 1 lies in two nations with suppliers that share one, 2 in one with and one without, 3 in the latter alone
    spark.createDataFrame([(1, 0), (1, 2), (2, 0), (2, 1), (3, 1), (4, None), (None, 0)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.c_custkey, r.tier, r.matches, r.first_match) for r in catalog.QUERIES["match_cascade"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 2, 10), (2, 1, 2, 10), (3, 2, 2, 10)}


def test_longest_directory_makes_no_substrings(spark, monkeypatch):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("ab/é😀") for _ in range(n))
    seg = spark.createDataFrame([(i % 150, word(r.randrange(0, 30))) for i in range(200)] + [(500, None)], "ref long, s string")
    dirs = spark.createDataFrame([(word(r.randrange(0, 6)), r.randrange(9)) for _ in range(40)] + [(None, 1)], "dir string, i long")
    walked = match.longest_directory(seg, "ref", "s", dirs, "dir", "i")
    assert "explode" not in walked._jdf.queryExecution().toString()
    got = {x.ref: (len(x.dir)) for x in walked.collect()}
    monkeypatch.setattr(match, "TRIE", 0)
    assert got and got == {x.ref: len(x.dir) for x in match.longest_directory(seg, "ref", "s", dirs, "dir", "i").collect()}


def test_dynamic_references_share_what_they_reach(tree):
    from helpers import png, pubspec

    files = {"pubspec.yaml": pubspec(assets=["assets/flags/"])} | {f"assets/flags/f{i}.png": png(tweak=i + 1) for i in range(3)}
    files |= {f"lib/d{i}.dart": f"Widget d{i}(String c) => Image.asset('assets/flags/$c.png');\n" for i in range(9)}
    a = tree.files(files).audit("unused")
    assert [r.n for r in a.context.assets.select(F.size("occurrences").alias("n")).collect()] == [5, 5, 5]
    assert [[o["file"] for o in f["occurrences"]] for f in a.rows if f["code"] == "POSSIBLY_USED_ASSET"] == [[f"lib/d{i}.dart" for i in range(5)]] * 3
    assert [f["data"]["coveredCount"] for f in a.rows if f["code"] == "DYNAMIC_REFERENCE"] == [3] * 9


def test_findings_about_files_resolve_nothing(spark, monkeypatch):
    import os

    import pytest

    from gleaner.plans import specimen

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no driver tables")
    monkeypatch.setattr(specimen, "_made", {})
    monkeypatch.setattr(specimen, "resolve", lambda p: pytest.fail("resolved"))
    assert specimen.QUERIES["finding_empty_file"](spark, "/root/testdata/sf0.001").count() >= 0
    assert specimen.QUERIES["project_assets"](spark, "/root/testdata/sf0.001").count() > 0


def test_places_in_a_sorted_table(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v long").repartition(7)
    got = groups.numbered(df.orderBy("v"), "i").collect()
    assert sorted((r.v, r.i) for r in got) == [(v, v + 1) for v in range(1000)]
    assert groups.numbered(df.limit(0).orderBy("v"), "i").count() == 0


def test_dice_pairs_meet_in_blocks(spark, monkeypatch):
    from collections import Counter

    r = random.Random(8)
    base = ["".join(r.choice("abcdß😀") for _ in range(n)) for n in (1, 2, 3, 17, 18, 19, 20, 21, 40, 41, 300)]
    texts = [x for b in base for x in (b, b, b + "a", b[:-1] + "zz"[: len(b)])] + ["", None]
    first = {t: min(str(i) for i, u in enumerate(texts) if u == t) for t in texts if t}
    grams = {k: Counter(t[i : i + 2] for i in range(len(t) - 1)) for t, k in first.items()}
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, t string")
    for size, ratio in ((3, 0.6), (8192, 0.921875)):
        monkeypatch.setattr(similar, "TEXTS", size)
        want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(grams, 2) if grams[a] and grams[b] and 2 * (grams[a] & grams[b]).total() >= ratio * (grams[a].total() + grams[b].total())}
        want |= {(first[t], str(i)) for i, t in enumerate(texts) if t and first[t] != str(i)}
        found = similar.dice_pairs(df, "k", "t", ratio)
        assert sorted((x.a, x.b) for x in found.collect()) == sorted(want) and len(want) > 20
