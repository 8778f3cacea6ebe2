"""Encoding, counting and packing against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from gleaner.llm import bpe, count, encode, pack
from gleaner.llm.common import vocabulary

BYTES, PIECES, WORDS = vocabulary("byte_bpe_multi_50k.tiktoken"), vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json")
ATOMS = ["a", "the", "The", " ", "  ", "\n", "\t", "\r\n", "é", "é", "\xa0", "1", "½", "²", "'s", "s'", "<|endoftext|>", "<s>", "日本", "。", "▁", "😀", "\x1c", "　", "_", "!!", "ß", "abc123", "İ", "a" * 30, "\x0b", "$", "token", "."]


def texts(n=800, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ATOMS) for _ in range(r.randrange(30))) for _ in range(n)]


def test_encoding_equals_the_library():
    c = encode.Codec(BYTES)
    lib = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    for t in texts():
        ids = c.encode(t)
        assert ids == ",".join(map(str, lib.encode_ordinary(t)))
        assert c.decode(ids).decode() == t


def test_a_piece_is_encoded_by_the_table_loop_and_remembered_once(monkeypatch):
    c = encode.Codec(BYTES)
    r = random.Random(9)
    for _ in range(300):
        b = "".join(r.choice("aehinrst \xc3\xa9") for _ in range(r.randrange(1, 40)))
        assert c.merger.whole(b) == bpe.Prefixes(c.merger, b).ids()
    assert c.merger.whole("") == []
    merges = []
    monkeypatch.setattr(c.merger, "merge", lambda t, merge=c.merger.merge: merges.append(t) or merge(t))
    words = ["".join(r.choice("aehinrst") for _ in range(9)) for _ in range(3000)]
    texts = [" ".join(r.sample(words, 200)) for _ in range(100)] + [a + "\n" + b + "  " for a, b in zip(words, words[1:])]
    lib = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    want = [",".join(map(str, lib.encode_ordinary(t))) for t in texts]
    assert [c.encode(t) for t in texts] == want
    made, held = len(merges), {k for cache in (c.chunk, c.piece) for k in cache}
    assert [c.encode(t) for t in texts] == want and len(merges) == made
    assert all(c.find(k) == [k] for k in held)  # pieces alone: the words at line ends used to be kept in pairs as well
    monkeypatch.setattr(encode, "LONG_TEXT", 1)
    assert [c.encode(t) for t in texts[:5]] == want[:5]


def test_prefixes_append_and_edit_exactly():
    m = encode.Codec(BYTES).merger
    r = random.Random(2)
    text = "".join(r.choice("aehinrst ") for _ in range(60))
    p = bpe.Prefixes(m)
    for c in text:
        p.append(c)
    assert p.tokens() == bpe.Prefixes(m, text).tokens()
    p.edit(20, 25, "xyz")
    assert p.tokens() == bpe.Prefixes(m, text[:20] + "xyz" + text[25:]).tokens()
    for _ in range(60):
        a = r.randrange(len(p.text) + 1)
        b, new = min(len(p.text), a + r.randrange(6)), "".join(r.choice("aehinrst ") for _ in range(r.randrange(6)))
        text = p.text[:a] + new + p.text[b:]
        p.edit(a, b, new)
        fresh = bpe.Prefixes(m, text)
        assert p.text == text and p.last == fresh.last
    long = bpe.Prefixes(m, "the stone in the river sat here as rain is in the east " * 400)
    assert long.edit(30, 32, "zz") < 4 * m.longest + 10  # and not the twenty thousand entries behind


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_counts_equal_the_library(monkeypatch, chunk):
    monkeypatch.setattr(count, "CHUNK", chunk)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t = count.Transducer(count.read_pieces(PIECES))
    for x in texts(500, 3):
        assert t.count(x) == len(sp.encode(x))
    monkeypatch.setattr(count, "STATES", 40)  # most transitions find no room
    t = count.Transducer(count.read_pieces(PIECES))
    assert all(t.count(x) == len(sp.encode(x)) for x in texts(100, 4)) and len(t.step) <= 40


def test_maps_compose_in_any_order():
    t = count.Transducer(count.read_pieces(PIECES))
    r = random.Random(9)
    for x in filter(None, texts(60, 8)):
        s = count.SPACE + x.replace(" ", count.SPACE)
        cuts = sorted({0, len(s), *[r.randrange(len(s) + 1) for _ in range(4)]})
        parts = [t.chunk_map(s[a:b]) for a, b in zip(cuts, cuts[1:])]
        while len(parts) > 1:  # neighbours in random order
            i = r.randrange(len(parts) - 1)
            parts[i : i + 2] = [t.compose(parts[i], parts[i + 1])]
        assert t.scan(parts) == t.count(x)


def test_every_word_goes_through_transitions():
    t = count.Transducer(count.read_pieces(PIECES))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    word = "Donaudampfschifffahrt" * 5
    assert t.count(word) == len(sp.encode(word)) and len(t.step) > 20 and not t.word
    before = dict(t.step)
    assert t.count(word) == len(sp.encode(word)) and t.step == before  # compiled once


def test_texts_without_spaces_take_linear_time_and_bounded_memory():
    import time

    t = count.Transducer(count.read_pieces(PIECES))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(3)
    unit = "".join(r.choice("日本語のテスト文章である。abcdefé") for _ in range(5000))
    assert t.count(unit * 3) == len(sp.encode(unit * 3))
    began = time.time()
    t.count(unit * 200)
    small = time.time() - began
    began = time.time()
    t.count(unit * 2000)  # ten million code points
    assert time.time() - began < 15 * small + 5
    assert not any(len(w) > count.WORD for w in t.word)
    c = encode.Codec(BYTES)
    c.encode(unit)
    assert not any(len(k) > 256 for k in c.chunk) and not any(len(k) >= 64 for k in c.piece)


def test_long_texts_are_counted_in_pieces(monkeypatch, spark):
    monkeypatch.setattr(count, "LONG", 7)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = list(enumerate(texts(120, 6))) + [(900, None), (901, ""), (902, "日本語" * 20), (903, "a " * 40)]
    rows += rows[:5]  # repeated rows
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, t long").repartition(3)
    got = sorted((r.doc_id, r.t, r.n_bytes, r.n_tokens, r.over_limit) for r in count.count_tokens(df, PIECES, ["doc_id", "t"], limit=9).collect())
    want = [(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows]
    assert got == sorted((i, i, b, n, n > 9) for i, b, n in want)


def test_word_ids_equal_the_library():
    e, lib = pack.WordIds(WORDS), Tokenizer.from_file(WORDS)
    for t in texts(800, 5):
        assert e.ids(t) == np.asarray(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_tables(docs, no_docs, corpus):
    c = encode.Codec(BYTES)
    got = {r.doc_id: r for r in encode.encode(docs, BYTES, ["doc_id"]).collect()}
    for i, t in corpus:
        ids = c.encode(t)
        assert got[i].n_tokens == (ids.count(",") + 1 if ids else 0)
        assert got[i].ids_sha256 == hashlib.sha256(ids.encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    n = {r.doc_id: r for r in count.count_tokens(docs, PIECES, ["doc_id"], limit=100).collect()}
    assert all(n[i].n_tokens == len(sp.encode(t or "")) and n[i].n_bytes == len((t or "").encode()) and n[i].over_limit == (n[i].n_tokens > 100) for i, t in corpus)
    assert encode.encode(no_docs, BYTES, ["doc_id"]).count() == 0 and count.count_tokens(no_docs, PIECES, ["doc_id"]).count() == 0


def test_fill_is_best():
    import itertools

    r = random.Random(6)
    for _ in range(60):
        counts = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(4)}
        cap = r.randrange(1, 60)
        best = max(s for ks in itertools.product(*[range(c + 1) for c in counts.values()]) if (s := sum(k * n for k, n in zip(ks, counts))) <= cap)
        used = pack.fill(sorted(counts, reverse=True), counts, cap)
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


@pytest.mark.parametrize("window", [16, 4096])
def test_packing_places_every_id_once(docs, no_docs, corpus, window):
    e, lib = pack.WordIds(WORDS), {}
    for i, t in corpus:
        lib[i] = np.frombuffer(e.ids(t) + np.asarray([2], "<u4").tobytes(), "<u4")
    rows = pack.pack(docs, WORDS, window=window, with_ids=True).collect()
    seen, places = {}, {}
    for r in rows:
        part = lib[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and bytes(r.ids) == part.tobytes() and r.doc_tokens == len(lib[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in lib.items():
        at = 0
        for s, n in sorted(seen[i]):
            assert s == at
            at += n
        assert at == len(ids)
    padding = 0
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= window
        padding += window - at
    assert padding <= 2 * window
    assert pack.pack(no_docs, WORDS).count() == 0
