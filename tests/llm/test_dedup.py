"""Near and substring duplicates, fingerprints, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import minhash, spotsigs, substring

WS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k):
    w = WS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(corpus, k):
    s = {i: shingles(t, k) for i, t in corpus}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize("k", [2, 5])
def test_groups_equal_brute_force(docs, corpus, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, size=k).collect()}
    assert got == brute_components(corpus, k)


def test_chains_are_followed(spark):
    base = [f"w{i}" for i in range(300)]
    rows = []
    for step in range(8):  # neighbours are similar, ends are not
        w = list(base)
        for j in range(12 * step):
            w[j * 3] = f"x{j}"
        rows.append((step, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, size=2).collect()} == want


def test_repeated_ids_null_ids_and_empty_tables(spark, no_docs):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A B C D"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]
    assert sorted(r.doc_id or -1 for r in minhash.one_of_each(df).collect()) == [-1, 1, 3]
    assert minhash.near_duplicates(no_docs).count() == 0
    rows = [(1, "a b c d", "z"), (1, "e f g h", "y"), (1, "e f g h", "x"), (2, "e f g h", "w"), (None, "q", "v"), (None, "q", "u")]
    kept = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, i string").repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.text, r.i) for r in kept if r.doc_id != 2) == [(-1, "q", "u"), (-1, "q", "v"), (1, "a b c d", "z"), (1, "e f g h", "x")]


def test_signature_estimates_with_lower_variance():
    r, errors = np.random.default_rng(0), []
    for _ in range(150):
        x = r.integers(0, 2**63, 400).astype(np.uint64)
        a, b = np.unique(x[:360]), np.unique(x[40:])
        errors.append((minhash.signature(a)[: minhash.USED] == minhash.signature(b)[: minhash.USED]).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < (0.8 * 0.2 / minhash.USED) ** 0.5
    for n in (1, 3, 40, 2000):  # early stopping changes nothing
        x = r.integers(0, 2**63, n).astype(np.uint64)
        k = np.arange(minhash.M)
        a = (minhash.mix(x + np.uint64(1)) % np.uint64(minhash.M - 1)).astype(np.int64) + 1
        c = (minhash.mix(x + np.uint64(2)) % np.uint64(minhash.M)).astype(np.int64)
        want = np.full(minhash.M, np.iinfo(np.uint64).max, np.uint64)
        draw = minhash.mix(x[:, None] + k.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)
        np.minimum.at(want, ((a[:, None] * k + c[:, None]) % minhash.M).ravel(), (draw | (k.astype(np.uint64) << np.uint64(32))).ravel())
        assert (minhash.signature(x) == want).all()


def brute_removed(rows, window):
    ws = [WS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, ws):
        gone = {j for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for j in range(s, s + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window,group", [(35, 20_000), (8, 20_000), (12, 1), (35, 0)])
def test_removal_equals_brute_force(monkeypatch, docs, corpus, window, group):
    monkeypatch.setattr(substring, "GROUP", group)
    monkeypatch.setattr(substring, "STEP", 4)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs.select("doc_id", "text", "uid"), window, digest=True).collect())
    assert got == brute_removed(corpus, window)


def test_trees_alone_give_the_repeats():
    """Depths and covered words of one tree over several strings, without anchors, hashes of spans or prefixes."""
    r = random.Random(7)
    for window in (3, 8):
        rows = [[r.randrange(3) for _ in range(r.randrange(window, 30))] for _ in range(12)]
        rows.append(list(rows[0]))
        words = np.array([w for x in rows for w in x], np.uint64)
        sizes = np.array([len(x) for x in rows])
        row, lo, hi = substring.repeated_words(words, sizes, sizes - window + 1, window)
        got = {(i, j) for i, a, b in zip(row.tolist(), lo.tolist(), hi.tolist()) for j in range(a, b)}
        seen = Counter(tuple(x[i : i + window]) for x in rows for i in range(len(x) - window + 1))
        assert got == {(k, j) for k, x in enumerate(rows) for s in range(len(x) - window + 1) if seen[tuple(x[s : s + window])] > 1 for j in range(s, s + window)}
        starts = np.concatenate([np.arange(n - window + 1) + at for n, at in zip(sizes, np.cumsum(sizes) - sizes)])
        depth = substring.node_depths(words, sizes, starts, 1)
        ends = np.repeat(np.cumsum(sizes), sizes)
        tails = {int(s): tuple(words[s : ends[s]].tolist()) for s in starts}
        for s in tails:  # the longest prefix shared with any other suffix
            best = max(next((k for k, (a, b) in enumerate(zip(tails[s], tails[o])) if a != b), min(len(tails[s]), len(tails[o]))) for o in tails if o != s)
            assert depth[s] == best


def test_removal_outlives_a_change_of_splits(spark, docs, corpus, tmp_path):
    """Executors may come or go between the scans, and files are then cut otherwise."""
    docs.select("doc_id", "text").repartition(5).write.parquet(f"{tmp_path}/d")
    out = substring.remove_repeats(spark.read.parquet(f"{tmp_path}/d"), digest=True)
    keys = {"spark.sql.files.minPartitionNum": "37", "spark.sql.files.openCostInBytes": "1"}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect())
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert got == brute_removed(corpus, 35)


def test_removal_in_repetitive_text_and_repeated_rows(spark, no_docs):
    r = random.Random(1)
    rows = [(1, "x " * 90), (2, "a b " * 40), (3, "a b " * 17 + "c"), (4, " ".join(f"q{i}" for i in range(40))), (4, " ".join(f"q{i}" for i in range(40))), (5, " ".join(r.choice("ab") for _ in range(300))), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (8, 10):
        key = lambda x: tuple(-1 if v is None else v for v in x)
        got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring.remove_repeats(df, window, digest=True).collect()), key=key)
        assert got == sorted(brute_removed([(i if i is not None else -1, t) for i, t in rows], window), key=key) or [key(g) for g in got] == sorted(brute_removed([(-1 if i is None else i, t) for i, t in rows], window))
    assert substring.remove_repeats(no_docs).count() == 0


def test_removal_keeps_columns_and_untouched_texts(docs, corpus):
    rows = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert rows[1].text is None and rows[3].text == "   \n\t" and rows[6].source == "src0" and rows[6].uid == "clash"
    assert 0 < rows[16].n_removed < rows[16].n_words and rows[22].text == ""


def test_fingerprints(docs, no_docs, corpus):
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    order = sorted(corpus, reverse=True)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = set(got[i].fingerprint.split(",")), set(got[i].edited_fingerprint.split(","))
        assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b))
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint and got[22].fingerprint == got[23].fingerprint
    assert got[24].near_next == 1.0 and got[7].near_next < 0.1 and got[7].near_edited > 0.3
    assert spotsigs.fingerprints(no_docs).count() == 0
    one = spotsigs.fingerprints(docs.where("doc_id = 7")).first()
    assert one.near_next == 1.0


def brute_signatures(text):
    """The chains of a text as plain loops over its words find them, independently of the expressions."""
    words = [w for w in re.sub(r"[\W_]+", " ", (text or "").lower()).split()]
    common = [w in spotsigs.COMMON for w in words]
    content = lambda i: next((j for j in range(i, len(words)) if not common[j]), None)
    out = set()
    for i, w in enumerate(words):
        if common[i]:
            a = content(i + 1)
            b = None if a is None else content(a + 1)
            if b is not None:
                out.add((w, words[a], words[b]))
        elif i + 1 < len(words) and not any(common[i + 1 : i + 1 + spotsigs.STRETCH]):
            out.add((w, words[i + 1]))
    return out


def test_signatures_equal_brute_force(spark):
    r = random.Random(12)
    pool = [*spotsigs.COMMON[:12], "stone", "river", "Lamp", "née", "x1", "Straße", "42"]
    rows = [(i, r.choice([" ", ", ", "\n"]).join(r.choice(pool) for _ in range(r.randrange(40)))) for i in range(400)]
    got = {x.doc_id: x.sigs for x in spotsigs.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: brute_signatures(t) for i, t in rows}
    # hashes stand for chains: equal chains of any two texts have equal hashes, and different sets differ in number or in kind
    assert all(len(got[i]) == max(1, len(want[i])) for i in want)
    for i in range(0, 400, 7):
        for j in range(i + 1, 400, 11):
            if want[i] and want[j]:
                assert len(set(got[i]) & set(got[j])) == len(want[i] & want[j])


def test_fingerprints_cross_runs(monkeypatch, docs, corpus):
    want = sorted(map(tuple, spotsigs.fingerprints(docs).collect()))
    for run in (1, 3, 7):
        monkeypatch.setattr(spotsigs, "RUN", run)
        assert sorted(map(tuple, spotsigs.fingerprints(docs).collect())) == want


def test_similar_pairs_equal_brute_force(docs):
    sets = {}
    for r in spotsigs.classes(docs).collect():
        sets.setdefault(tuple(r.sigs), r.doc_id)
        sets[tuple(r.sigs)] = min(sets[tuple(r.sigs)], r.doc_id)
    items = [(i, set(s)) for s, i in sets.items()]
    for percent in (50, 80):
        want = {(min(a, b), max(a, b)) for a, x in items for b, y in items if a != b and 100 * len(x & y) >= percent * len(x | y)}
        assert {(r.a, r.b) for r in spotsigs.similar_pairs(docs, percent).collect()} == want


def test_an_edit_changes_the_signatures_around_it_alone(spark):
    w = " ".join(f"the a{i} b{i} c{i} d{i}" for i in range(40)).split()  # a chain in each five words
    edited = w[:100] + ["one", "two"] + w[100:]
    rows = {r.doc_id: set(r.sigs) for r in spotsigs.classes(spark.createDataFrame([(1, " ".join(w)), (2, " ".join(edited)), (3, "salt pepper thyme basil")], "doc_id long, text string")).collect()}
    assert len(rows[1] & rows[2]) / len(rows[1] | rows[2]) > 0.9
    assert len(rows[3]) == 3
