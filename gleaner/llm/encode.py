"""Byte-level BPE encoding and decoding of whole texts, by the prefix tables of ``bpe``.

A text falls into pieces at the tokenizer's pattern, and short pieces are memoized (their number is bounded).
"""

from __future__ import annotations

import base64
import hashlib

import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.bpe import Bounded, Merger
from gleaner.llm.common import hold, per_row, table, vocabulary

#: Pieces, and pairs of tokens, remembered in one generation; a worker holds one codec at a time.
PIECES = PAIRS = 400_000
#: Pieces of this many code points are never remembered; texts of this many are not cut into pieces all at once.
LONG_PIECE, LONG_TEXT = 64, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.ranks = read_ranks(path)
        self.bytes_of = {str(i): b for b, i in self.ranks.items()}
        self.merger = Merger({b.decode("latin-1"): i for b, i in self.ranks.items()}, PAIRS)
        self.id_of = [str(self.merger.ranks[t]) for t in self.merger.names]
        self.pattern = regex.compile(pattern.replace(r"\s", "[\\t-\\r \\x85\\xa0  -     　]").replace(r"\S", "[^\\t-\\r \\x85\\xa0  -     　]").replace("[^[\\t-\\r \\x85\\xa0  -     　]", "[^\\t-\\r \\x85\\xa0  -     　"))
        self.find = self.pattern.findall
        self.piece = Bounded(self._piece, PIECES, LONG_PIECE)
        self.chunk = self.piece  # texts used to be cut at spaces before; what is remembered is one cache now

    def _piece(self, piece: str) -> str:
        b = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        if b in self.merger.ranks:  # a listed piece is one token
            return str(self.merger.ranks[b])
        return ",".join([self.id_of[t] for t in self.merger.whole(b)])

    def encode(self, text: str | None) -> str:
        """The decimal ids of a text, joined by commas; null and empty give the empty string."""
        if not text:
            return ""
        pieces = self.find(text) if len(text) < LONG_TEXT else (m.group() for m in self.pattern.finditer(text))
        return ",".join(map(self.piece.__getitem__, pieces))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded bytes of each row; ``with_ids`` adds the ids.

    Null and empty texts have no tokens and the digests of empty input. Rows are independent: repeated rows give
    repeated results, other columns are not looked at, and an empty table gives an empty result.
    """
    key = ("codec", path)

    def make():
        codec = hold(key, lambda: Codec(path))

        def work(texts):
            n, ids_hash, out_hash, all_ids = [], [], [], []
            for t in texts:
                ids = codec.encode(t)
                n.append(ids.count(",") + 1 if ids else 0)
                ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                out_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append([int(x) for x in ids.split(",")] if ids else [])
            return (n, ids_hash, out_hash, all_ids) if with_ids else (n, ids_hash, out_hash)

        return work

    return per_row(docs, keep, text, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids, make, held=key)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), ["doc_id"])
