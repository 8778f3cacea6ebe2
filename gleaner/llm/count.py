"""Token counts by a compiled finite-state transducer.

A state is the longest end of the text that begins some listed piece, together with the last token at each place in it
where a piece may still begin and the tokens counted since. That is all that any further symbol can depend on: each
symbol leads to one next state and changes the count by a fixed amount, which annotates the transition. No listed piece
crosses a word boundary, so a boundary leads to one state wherever it comes from. States and transitions are compiled
from the vocabulary when first met. Once the table holds STATES transitions further ones are worked out and not kept,
until the text leads back to a state of the table.

A chunk of text is a map from state to state and count: up to its first boundary it follows the state that comes in;
after that, result and count are fixed. Maps compose associatively, so chunks are mapped in any order, by any task, and
a text is the scan of its chunks' maps: pairs of neighbours, then pairs of pairs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bpe import Bounded, Merger
from gleaner.llm.common import hold, let_go, per_row, table, vocabulary

SPACE = "▁"
#: Code points in one chunk, in what one task maps of a longer text, and transitions that the compiled table may hold.
CHUNK, LONG, STATES = 1 << 16, 1 << 20, 300_000
#: Words up to this length are remembered with their count, so many in a generation; longer ones follow the transitions.
WORD, WORDS = 48, 200_000

MARKS, COUNT = ".,;:!?%$#*&()\"'", (1 << 24) - 1

#: (end of the text, its places' (last token, tokens since) or null)
State = tuple[str, tuple]
START: State = ("", ((-1, 0),))


def read_pieces(path: str) -> dict[str, int]:
    """Ranks of the ordinary pieces (lower joins first), from a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
    order = sorted((i for i in range(n) if i not in special), key=lambda i: (-sp.get_score(i), i))
    return {sp.id_to_piece(i): r for r, i in enumerate(order)}


class Transducer:
    """Deterministic, compiled as it is used."""

    def __init__(self, ranks: dict[str, int]):
        if any(SPACE in p.lstrip(SPACE) for p in ranks) or SPACE not in ranks:
            raise ValueError("this vocabulary's pieces cross word boundaries; its texts can't be cut into words")
        m = Merger(ranks)
        self.pairs = m.pairs
        self.number = {t: i for i, t in enumerate(m.names)}
        self.begins = {t[:n] for t in m.names for n in range(len(t) + 1)}
        m.find = None  # the automaton isn't needed here
        #: symbols of no piece lead back to the start
        self.bare_lines = not any("\n" in p for p in ranks)
        #: (state << 21 | code point) to (next state << 8 | emitted tokens + 128); states by number and numbers by state
        self.step: dict[int, int] = {}
        self.states, self.numbers = [START], {START: 0}
        #: words to (number of the state behind them + 1, or 0) << 24 | tokens: their transitions composed into one
        self.word = Bounded(self._word, WORDS)

    def number_of(self, state: State) -> int | State:
        """The number of a state; the state itself where the table is full."""
        n = self.numbers.get(state)
        if n is None:
            if len(self.step) >= STATES:
                return state
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def state_of(self, at: int | State) -> State:
        return self.states[at] if isinstance(at, int) else at

    def compile(self, at: int | State, c: str) -> tuple[int | State, int]:
        """Where a state and a symbol lead, and the tokens emitted."""
        end, places = self.state_of(at)
        if c == SPACE and end and not end.endswith(SPACE):
            end, places = START
        whole, last, emitted = end + c, -1, len(c.encode("utf-8", "surrogatepass"))
        for i, place in enumerate(places):  # pieces that end here, the longest first
            t = self.number.get(whole[i:]) if place else None
            if t is not None and (place[0] < 0 or self.pairs[place[0] << 20 | t]):
                last, emitted = t, 1 - place[1]
                break
        begins, cut = self.begins, 0
        while whole[cut:] not in begins:
            cut += 1
        kept = [(p[0], p[1] + emitted) if p and whole[i:] in begins else None for i, p in enumerate(places[cut:], cut)]
        to = self.number_of((whole[cut:], (*kept, (last, 0))))
        if isinstance(at, int) and isinstance(to, int) and len(self.step) < STATES:
            self.step[at << 21 | ord(c)] = to << 8 | emitted + 128
        return to, emitted

    def walk(self, at: int | State, text: str) -> tuple[int | State, int]:
        """Where a text leads from a state, and the tokens emitted on the way."""
        get, total = self.step.get, 0
        for c in text:
            to = get(at << 21 | ord(c)) if isinstance(at, int) else None
            if to is None:
                at, n = self.compile(at, c)
                total += n
            else:
                at = to >> 8
                total += (to & 255) - 128
        return at, total

    def _word(self, word: str) -> int:
        """A word from the start. Marks behind it and lines within it go on from the words before them."""
        at, total, rest = 0, 0, word
        if self.bare_lines and "\n" in word:
            *lines, rest = word.split("\n")
            total = sum([(self.word[x] & COUNT) + 1 for x in lines if x]) + lines.count("")
            if len(rest) > 1:
                v = self.word[rest]
                return v + total
        stem = rest.rstrip(MARKS)
        if 1 < len(stem) < len(rest) and (v := self.word[stem]) > COUNT:
            at, total, rest = (v >> 24) - 1, total + (v & COUNT), rest[len(stem) :]
        at, n = self.walk(at, rest)
        return (at + 1 if isinstance(at, int) else 0) << 24 | total + n

    def chunk_map(self, chunk: str) -> tuple[tuple[str, ...], State | None, int]:
        """(head, state, count): the head follows the state that comes in, the rest leads to ``state`` with ``count`` tokens.

        A chunk without a boundary is all head, and has no state of its own.
        """
        cut = re.search(f"(?<=[^{SPACE}]){SPACE}", chunk)
        if not cut:
            return (chunk,), None, 0
        head, rest = chunk[: cut.start()], chunk[cut.start() :]
        words = re.findall(f"{SPACE}+[^{SPACE}]*", rest) if SPACE + SPACE in rest else [SPACE + w for w in rest[1:].split(SPACE)]
        word = self.word
        count = sum([word[w] & COUNT if len(w) <= WORD else self.walk(0, w)[1] for w in words[:-1]])
        state, n = self.walk(0, words[-1])
        return (head,), self.state_of(state), count + n

    def run(self, state: State, head: tuple[str, ...]) -> tuple[State, int]:
        at, total = self.number_of(state), 0
        for part in head:
            at, n = self.walk(at, part)
            total += n
        return self.state_of(at), total

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbours, the first one first."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        state, n = self.run(a[1], b[0])
        return (a[0], state, a[2] + n) if b[1] is None else (a[0], b[1], a[2] + n + b[2])

    def scan(self, maps: list[tuple]) -> int:
        """Tokens of a whole text from its chunks' maps in order."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, _, count = maps[0]
        return self.run(START, head)[1] + count

    def maps(self, text: str, first: bool = True) -> list[tuple]:
        """The maps of a text's chunks; ``first``: nothing comes before it."""
        s = SPACE * first + text.replace(" ", SPACE)
        return [self.chunk_map(s[at : at + CHUNK]) for at in range(0, len(s), CHUNK)]

    def count(self, text: str | None) -> int:
        return self.scan(self.maps(text)) if text else 0


def count_tokens(docs: DataFrame, path: str, keep: list[str], text: str = "text", limit: int = 4096) -> DataFrame:
    """Bytes, tokens and whether the tokens pass ``limit``. Null and empty texts have none of either.

    Texts beyond LONG code points are cut, and their pieces mapped by as many tasks; the maps of one text then meet.
    Rows are independent: repeated rows and ties need no care, columns other than those named aren't looked at, and
    an empty table gives an empty result.
    """
    key = ("transducer", path)

    def make():
        t = hold(key, lambda: Transducer(read_pieces(path)))
        return lambda texts: ([t.count(x) for x in texts],)

    kept = [f"k{i}" for i in range(len(keep))]
    sized = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"), F.col(f"`{text}`").alias("t"))
    brief = F.coalesce(F.length("t") <= LONG, F.lit(True))
    short = per_row(sized.where(brief), [*kept, "n_bytes"], "t", "n_tokens long", make, held=key)
    out = short.unionByName(_long_counts(sized.where(~brief), key, path, kept))
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _long_counts(docs: DataFrame, key: tuple, path: str, kept: list[str]) -> DataFrame:
    """The same of long texts, each piece mapped by itself."""

    def make():
        t = hold(key, lambda: Transducer(read_pieces(path)))

        def work(pieces):
            heads, states, counts = [], [], []
            for p in pieces:
                out = t.maps(p[1:], p[0] == "0")
                while len(out) > 1:
                    out = [t.compose(*out[i : i + 2]) if i + 1 < len(out) else out[i] for i in range(0, len(out), 2)]
                head, state, count = out[0]
                heads.append("".join(head))
                states.append(None if state is None else json.dumps(state))
                counts.append(count)
            return heads, states, counts

        return work

    ids = docs.withColumn("id", F.monotonically_increasing_id())
    cut = F.transform(F.sequence(F.lit(0), ((F.length("t") - 1) / LONG).cast("int")), lambda i: F.concat(F.when(i == 0, "0").otherwise("1"), F.substring(F.col("t"), i * LONG + 1, F.lit(LONG))))
    own = F.struct(*kept, "n_bytes")
    pieces = ids.select("id", own.alias("own"), F.posexplode(cut).alias("i", "piece")).withColumn("own", F.when(F.col("i") == 0, F.col("own"))).repartition("id", "i")
    mapped = per_row(pieces, ["id", "i", "own"], "piece", "head string, state string, count long", make, held=key)
    met = mapped.groupBy("id").agg(F.any_value("own", F.lit(True)).alias("own"), F.collect_list(F.struct("i", "head", "state", "count")).alias("maps"))
    kind = dict(met.dtypes)["own"]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(key)
        t = hold(key, lambda: Transducer(read_pieces(path)))
        for b in batches:
            n = []
            for maps in b.column("maps"):
                rows = sorted(maps.as_py(), key=lambda m: m["i"])
                n.append(t.scan([((m["head"],), _state(m["state"]), m["count"]) for m in rows]))
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(n, pa.int64())], names=["own", "n_tokens"])

    return met.select("own", "maps").mapInArrow(together, f"own {kind}, n_tokens long").select("own.*", "n_tokens")


def _state(text: str | None) -> State | None:
    if text is None:
        return None
    end, places = json.loads(text)
    return end, tuple(p if p is None else tuple(p) for p in places)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), ["doc_id"])
