"""Byte-pair encoding by prefix dynamic programming.

An encoding is valid exactly when every adjacent pair of its tokens is: encoding the pair's joined text gives the
pair back. Each prefix of a text has one valid encoding, and so one last token. The table of last tokens is all the
state there is: the token before the last is the last token of the prefix that the last one leaves. Appending costs a
few lookups per symbol and never revises an entry; an edit keeps every entry up to it.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick

#: Entries of one generation of a cache, so that a task's memory has a bound.
CACHE = 100_000


class Merger:
    """Any-adjacent-pair BPE: join the neighbours whose union ranks lowest, leftmost first, until none is listed.

    Symbols are characters; byte vocabularies come in as Latin-1 strings. Listed tokens that merging never reaches
    are left out of the automaton that finds the tokens ending at each position.
    """

    def __init__(self, ranks: dict[str, int], pairs: int = CACHE):
        self.ranks = ranks
        self.names = [t for t in ranks if len(t) == 1 or self.merge(t) == [t]]
        self.sizes = [len(t) for t in self.names]
        self.longest = max(self.sizes, default=1)
        self.find = ahocorasick.Automaton()
        for i, t in enumerate(self.names):
            self.find.add_word(t, i)
        self.find.make_automaton()
        self.pairs = Bounded(self._pair, pairs)

    def _pair(self, key: int) -> bool:
        """Whether two tokens may stand side by side: their joined text gives them back."""
        a, b = self.names[key >> 20], self.names[key & 0xFFFFF]
        return self.merge(a + b) == [a, b]

    def whole(self, text: str) -> list[int]:
        """``Prefixes(self, text).ids()``, for a text that won't grow."""
        last, sizes, pairs = [-1] * (len(text) + 1), self.sizes, self.pairs
        for end, t in self.find.iter(text):
            end += 1
            if last[end] < 0:
                p = last[end - sizes[t]]
                if p < 0 or pairs[p << 20 | t]:
                    last[end] = t
        out, end = [], len(text)
        while end:
            t = last[end]
            out.append(t)
            end -= sizes[t] if t >= 0 else 1
        out.reverse()
        return out

    def merge(self, text: str) -> list[str]:
        parts, ranks = list(text), self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Prefixes:
    """The last tokens of every prefix of a growing text; -1 stands for a symbol that the vocabulary lacks."""

    def __init__(self, merger: Merger, text: str = ""):
        self.m, self.text, self.last = merger, "", [-1]
        self.append(text)

    def append(self, more: str) -> None:
        m, last, old = self.m, self.last, len(self.last) - 1
        sizes, pairs = m.sizes, m.pairs
        self.text = text = self.text + more
        last += [-1] * len(more)
        for end, t in m.find.iter(text, max(0, old + 1 - m.longest)) if old else m.find.iter(text):
            end += 1
            if end > old and last[end] < 0:
                p = last[end - sizes[t]]
                # no token before: the text's start, or a symbol that joins nothing
                if p < 0 or pairs[p << 20 | t]:
                    last[end] = t

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end]; returns how many entries were made anew.

        Entries up to ``start`` stand. Behind the new text entries are made anew only until as many as the longest
        token has symbols agree with the old ones in a row: from there on the old ones stand too, as every entry
        follows from the symbols and entries of that stretch alone.
        """
        old, tail, text = self.last[end:], self.text[end:], self.text
        del self.last[start + 1 :]
        self.text = text[:start]
        self.append(new)
        made, agree, done, longest = len(new), 0, 0, self.m.longest
        while done < len(tail) and agree < longest:
            step = tail[done : done + 2 * longest]
            self.append(step)
            fresh = self.last[-len(step) :]
            for i, t in enumerate(fresh):
                agree = agree + 1 if t == old[done + i + 1] else 0
            done += len(step)
            made += len(step)
        self.text += tail[done:]
        self.last += old[done + 1 :]
        return made

    def ids(self) -> list[int]:
        """Numbers of the tokens in ``Merger.names``, -1 for an unlisted symbol."""
        out, end, last, sizes = [], len(self.text), self.last, self.m.sizes
        while end:
            t = last[end]
            out.append(t)
            end -= sizes[t] if t >= 0 else 1
        return out[::-1]

    def tokens(self) -> list[str]:
        out, end, last, sizes = [], len(self.text), self.last, self.m.sizes
        while end:
            n = sizes[last[end]] if last[end] >= 0 else 1
            out.append(self.text[end - n : end])
            end -= n
        return out[::-1]


class Bounded(dict):
    """A memo of two generations: entries not asked for while a whole generation fills are dropped.

    Keys of ``long`` symbols or more, where that is given, are worked out each time and never kept.
    """

    def __init__(self, make: Callable, size: int = CACHE, long: int | None = None):
        super().__init__()
        self.make, self.size, self.long, self.old = make, size, long, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if self.long and len(key) >= self.long:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
