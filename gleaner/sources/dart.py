"""A tolerant reader of application source: string expressions, constants, symbol uses, calls and generated accessors.

It never fails on a file: what it does not understand it walks through token by token. Everything found comes out as
flat rows with a position, so that one pass over a file feeds every table.
"""

from __future__ import annotations

import bisect
import json
import re
from dataclasses import dataclass, field

_ID = re.compile(r"[A-Za-z_$][\w$]*", re.ASCII)
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?")
_PUNCT = re.compile(r"\.\.\.\??|\?\.\.|\?\?=|>>>=|<<=|>>=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\.\.|\+\+|--|\+=|-=|\*=|/=|~/=|~/|%=|&=|\|=|\^=|<<|.", re.S)
KEYWORDS = set("""assert break case catch class const continue default do else enum extends false final finally for if in is new
null rethrow return super switch this throw true try var void while with await yield async sync late static""".split())
_CONTROL = {"if", "for", "while", "switch", "catch", "assert", "return", "await", "throw", "super", "this", "else", "in", "do", "case", "yield", "is", "as"}
_NO_TYPE = {"return", "await", "else", "case", "in", "is", "as", "throw", "yield", "new", "do", "default", "assert", "when"}
_LOADS = {"loadString", "load", "loadBuffer", "loadStructuredData", "loadStructuredBinaryData"}
_PROVIDERS = {"AssetImage", "ExactAssetImage"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
OCCURRENCES = 20


@dataclass
class Token:
    kind: str  # id, num, str, op
    text: str
    start: int
    end: int
    #: of a string: literal pieces, and (start, end) code ranges for interpolations
    parts: list = field(default_factory=list)


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] == "u":
            return chr(int(e.strip("u{}"), 16)) if int(e.strip("u{}"), 16) < 0x110000 else ""
        if e[0] == "x":
            return chr(int(e[1:], 16))
        return {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v"}.get(e, e)

    return re.sub(r"\\(u\{[0-9a-fA-F]{1,6}\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", one, s, flags=re.S)


def tokenize(src: str, at: int = 0, end: int | None = None) -> list[Token]:
    out, n = [], len(src) if end is None else end
    while at < n:
        c = src[at]
        if c.isspace():
            at += 1
        elif src.startswith("//", at):
            nl = src.find("\n", at, n)
            at = n if nl < 0 else nl
        elif src.startswith("/*", at):
            depth, at = 1, at + 2
            while at < n and depth:
                if src.startswith("/*", at):
                    depth, at = depth + 1, at + 2
                elif src.startswith("*/", at):
                    depth, at = depth - 1, at + 2
                else:
                    at += 1
        elif c in "'\"" or (c == "r" and at + 1 < n and src[at + 1] in "'\""):
            t = _string(src, at, n)
            out.append(t)
            at = t.end
        elif m := _ID.match(src, at, n):
            out.append(Token("id", m[0], at, m.end()))
            at = m.end()
        elif m := _NUMBER.match(src, at, n):
            out.append(Token("num", m[0], at, m.end()))
            at = m.end()
        else:
            m = _PUNCT.match(src, at, n)
            out.append(Token("op", m[0], at, m.end()))
            at = m.end()
    return out


def _string(src: str, start: int, n: int) -> Token:
    at, raw = start, src[start] == "r"
    at += raw
    q = src[at]
    triple = src.startswith(q * 3, at)
    quote = q * 3 if triple else q
    at += len(quote)
    parts, piece = [], at
    while at < n and not src.startswith(quote, at):
        c = src[at]
        if c == "\n" and not triple:  # an unclosed string ends with its line
            break
        if c == "\\" and not raw:
            at += 2
        elif c == "$" and not raw and at + 1 < n and (src[at + 1] == "{" or _ID.match(src, at + 1, n)):
            parts.append(_unescape(src[piece:at]))
            if src[at + 1] == "{":
                close = _close_brace(src, at + 2, n)
                parts.append((at + 2, close))
                at = min(n, close + 1)
            else:
                m = re.compile(r"[A-Za-z_][\w]*", re.ASCII).match(src, at + 1, n)
                stop = m.end() if m else at + 2
                parts.append((at + 1, stop))
                at = stop
            piece = at
        else:
            at += 1
    at = min(at, n)
    last = src[piece:at]
    parts.append(last if raw else _unescape(last))
    if triple and isinstance(parts[0], str):
        parts[0] = re.sub(r"^[ \t]*\r?\n", "", parts[0])
    closed = src.startswith(quote, at)
    return Token("str", src[start:at], start, at + len(quote) if closed else at, parts)


def _close_brace(src: str, at: int, n: int) -> int:
    depth = 1
    while at < n:
        c = src[at]
        if c in "'\"":
            at = _string(src, at, n).end
            continue
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return at
        at += 1
    return n


def truncate(s: str, most: int = 120) -> str:
    s = re.sub(r"\s+", " ", s).strip()
    return s if len(s) <= most else s[: most - 1] + "…"


# Expressions are nested lists: ["lit", s], ["ref", name], ["seq", [part or None, ...]], ["class", name], ["?", source]


@dataclass
class Scope:
    owner: str | None = None
    method: tuple[str, list[str]] | None = None
    function: tuple[str, list[str]] | None = None
    members: bool = False


class Reader:
    """Walks one file; ``rows`` collects dicts with kind, name, expr, offset and so on, in reading order."""

    def __init__(self, src: str):
        self.src, self.rows, self.captured, self.muted = src, [], set(), 0
        self.lines = [0] + [m.end() for m in re.finditer("\n", src)]
        self.uses: dict[str, int] = {}

    # -- positions and rows

    def place(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.lines, offset)
        return line, offset - self.lines[line - 1] + 1

    def add(self, kind: str, offset: int, **more) -> None:
        line, column = self.place(offset)
        self.rows.append({"kind": kind, "line": line, "column": column, **more})

    def candidate(self, expr, start: int, end: int, how: str) -> None:
        if not self.muted and start not in self.captured:
            self.add("candidate", start, expr=expr, how=how, snippet=truncate(self.src[start:end]))

    def use(self, name: str, start: int, end: int) -> None:
        n = self.uses.get(name, 0)
        if n < OCCURRENCES:
            self.uses[name] = n + 1
            self.add("use", start, name=name, snippet=truncate(self.src[start:end]))

    # -- token helpers

    def read(self) -> list[dict]:
        self.walk(tokenize(self.src), Scope(members=True))
        return self.rows

    @staticmethod
    def close(t: list[Token], i: int) -> int:
        """The place of the bracket that closes t[i], or past the end."""
        stack = []
        for j in range(i, len(t)):
            if t[j].kind == "op":
                if t[j].text in _OPEN:
                    stack.append(_OPEN[t[j].text])
                elif t[j].text in _CLOSE:
                    if not stack:
                        return j
                    if t[j].text in stack:
                        while stack.pop() != t[j].text:
                            pass
                    if not stack:
                        return j
        return len(t)

    @staticmethod
    def generics(t: list[Token], i: int) -> int:
        """Past the type arguments that open at t[i], or i where it is a comparison."""
        if i >= len(t) or t[i].text != "<" or t[i].kind != "op":
            return i
        depth = 0
        for j in range(i, min(len(t), i + 80)):
            x = t[j].text
            if t[j].kind == "id" or x in (",", ".", "?", "(", ")", "[", "]", "{", "}"):
                continue
            if x == "<":
                depth += 1
            elif x in (">", ">>", ">>>"):
                depth -= len(x)
                if depth <= 0:
                    return j + 1
            else:
                return i
        return i

    def stop(self, t: list[Token], i: int) -> int:
        """Where an initializer that begins at i ends: a comma, semicolon or closing bracket of its own level."""
        while i < len(t):
            if t[i].kind == "op":
                if t[i].text in (",", ";") or t[i].text in _CLOSE:
                    return i
                if t[i].text in _OPEN:
                    i = self.close(t, i)
                elif t[i].text == "<" and (g := self.generics(t, i)) > i and g < len(t) and t[g].text in ("(", "[", "{", "."):
                    i = g
                    continue
            i += 1
        return i

    def split(self, t: list[Token]) -> list[list[Token]]:
        """The parts of a bracket's inside, at its commas."""
        out, i, start = [], 0, 0
        while i < len(t):
            j = self.stop(t, i)
            if j >= len(t) or t[j].text == ",":
                if j > start:
                    out.append(t[start:j])
                start = j + 1
            i = j + 1
        if start < len(t):
            out.append(t[start:])
        return out

    # -- lowering

    def string(self, s: Token):
        if len(s.parts) == 1:
            return ["lit", s.parts[0]]
        parts = []
        for p in s.parts:
            if isinstance(p, str):
                parts.append(["lit", p])
            else:
                inner = self.lower(tokenize(self.src, *p))
                parts.append(None if inner[0] == "?" else inner)
        return ["seq", parts]

    def source(self, t: list[Token]) -> str:
        return truncate(self.src[t[0].start : t[-1].end]) if t else ""

    def lower(self, t: list[Token]):
        if not t:
            return ["?", ""]
        if all(x.kind == "str" for x in t):
            return self.string(t[0]) if len(t) == 1 else ["seq", [self.string(x) for x in t]]
        if t[0].kind == "id" and t[0].text not in KEYWORDS and len(t) % 2 and all((x.kind == "id" and x.text not in KEYWORDS) if k % 2 == 0 else x.text in (".", "?.") for k, x in enumerate(t)):
            return ["ref", ".".join(x.text for x in t[::2])]
        # operators of this level; a sum is the last + with nothing that binds more loosely beside it
        plus, i = None, 0
        while i < len(t):
            x = t[i]
            if x.kind == "op":
                if x.text in _OPEN:
                    i = self.close(t, i) + 1
                    continue
                if x.text == "+" and i:
                    plus = i
                elif x.text in ("?", "??", ":", "=", "=>", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "&", "|", "^", "<<", ">>", "..", "?..", "+=", "??=") and not (x.text == "<" and self.generics(t, i) > i):
                    return ["?", self.source(t)]
            elif x.kind == "id" and x.text in ("is", "as", "throw"):
                return ["?", self.source(t)]
            i += 1
        if plus:
            # a minus after the last plus would make this a difference
            depth = 0
            for x in t[plus + 1 :]:
                if x.kind == "op":
                    depth += (x.text in _OPEN) - (x.text in _CLOSE)
                    if x.text == "-" and not depth and x is not t[plus + 1]:
                        return ["?", self.source(t)]
            return ["seq", [self.lower(t[:plus]), self.lower(t[plus + 1 :])]]
        return ["?", self.source(t)]

    # -- walking

    def walk(self, t: list[Token], scope: Scope) -> None:
        i, declaring = 0, False
        while i < len(t):
            x = t[i]
            if x.kind == "str":
                i = self.strings(t, i, scope)
            elif x.kind == "op":
                if x.text == "@":  # an annotation's arguments count, its name does not
                    i += 1
                    while i < len(t) and (t[i].kind == "id" or t[i].text == "."):
                        i += 1
                        if i < len(t) and t[i].text != "." and t[i - 1].kind == "id":
                            break
                    if i < len(t) and t[i].text == "(" and t[i].start == t[i - 1].end:
                        j = self.close(t, i)
                        self.arguments(t[i + 1 : j], scope)
                        i = j + 1
                    continue
                if x.text in _OPEN:
                    j = self.close(t, i)
                    inner = Scope(scope.owner, scope.method, scope.function)
                    self.walk(t[i + 1 : j], inner)
                    i = j + 1
                    continue
                if x.text == ";":
                    declaring = False
                i += 1
            elif x.kind == "id":
                i, declaring = self.word(t, i, scope, declaring)
            else:
                i += 1

    def strings(self, t: list[Token], i: int, scope: Scope) -> int:
        j = i
        while j < len(t) and t[j].kind == "str":
            j += 1
        run = t[i:j]
        if len(run) > 1:
            self.candidate(["seq", [self.string(s) for s in run]], run[0].start, run[-1].end, "adjacentStrings")
        for s in run:
            if len(s.parts) == 1:
                self.rows.append({"kind": "literal", "name": s.parts[0]})
            if len(run) == 1 or len(s.parts) > 1:
                self.candidate(self.string(s), s.start, s.end, "literal")
            for p in s.parts:
                if not isinstance(p, str):
                    self.walk(tokenize(self.src, *p), Scope(scope.owner, scope.method, scope.function))
        return j

    def word(self, t: list[Token], i: int, scope: Scope, declaring: bool) -> tuple[int, bool]:
        x, name = t[i], t[i].text
        nxt = t[i + 1] if i + 1 < len(t) else None
        if name in ("class", "mixin", "extension", "enum") and nxt is not None and nxt.kind == "id":
            k = i + 1
            while k < len(t) and t[k].text in ("class", "type"):
                k += 1
            owner = None if name == "extension" and t[k].text == "on" else t[k].text
            while k < len(t) and t[k].text not in ("{", ";"):
                k += 1
            if k < len(t) and t[k].text == "{":
                j = self.close(t, k)
                self.walk(t[k + 1 : j], Scope(owner=owner, members=True))
                return j + 1, False
            return k + 1, False
        if name in ("import", "export", "part", "library") and scope.members and scope.owner is None:
            k = i + 1
            while k < len(t) and t[k].text != ";":
                k = self.strings(t, k, scope) if t[k].kind == "str" else k + 1
            return k + 1, False
        if name in ("new", "const") and nxt is not None and nxt.kind == "id":
            k = i + 1
            names = [t[k].text]
            while k + 2 < len(t) and t[k + 1].text == "." and t[k + 2].kind == "id":
                k += 2
                names.append(t[k].text)
            g = self.generics(t, k + 1)
            while g + 1 < len(t) and t[g].text == "." and t[g + 1].kind == "id":
                g += 2
            if g < len(t) and t[g].text == "(" and not (scope.members and scope.owner == names[0]):
                j = self.close(t, g)
                kind = names[0] if len(names) == 1 or g > self.generics(t, k + 1) else names[1]
                self.call(kind, t[g + 1 : j], x, t[min(j, len(t) - 1)], scope, provider=True)
                self.arguments(t[g + 1 : j], scope)
                return self.tail(t, j + 1, scope), declaring
            return i + 1, declaring
        if name in KEYWORDS:
            return i + 1, declaring or name in ("var", "final", "const", "late")
        if name in ("get", "set") and scope.members and nxt is not None and nxt.kind == "id":
            return self.function(t, i + 1, scope), False
        g = self.generics(t, i + 1)
        if g < len(t) and t[g].text == "(":
            j = self.close(t, g)
            after = t[j + 1].text if j + 1 < len(t) else ";"
            body = after in ("{", "=>", "async", "sync")
            if name not in _CONTROL and (scope.members or (body and not (i and t[i - 1].text in (".", "?.", "..")))):
                return self.function(t, i, scope), False
        if nxt is not None and nxt.text == "=" and nxt.kind == "op":
            prev = t[i - 1] if i else None
            typed = prev is not None and ((prev.kind == "id" and prev.text not in _NO_TYPE) or prev.text in (">", ">>", "?"))
            if typed or (declaring and prev is not None and prev.text == ","):
                return self.variable(t, i, scope), True
        if scope.members and nxt is not None and nxt.text in (".",) and i + 3 < len(t) and t[i + 3].text == "(" and scope.owner == name:
            return self.function(t, i + 2, scope, constructor=True), False  # a named constructor
        if scope.members and nxt is not None and (nxt.kind == "id" or nxt.text in ("<", "?", ".", ";", ",")):
            return (g if g > i + 1 else i + 1), declaring  # a type, or a field without value
        if nxt is not None and nxt.kind == "id" and nxt.text not in KEYWORDS | {"is", "as", "in"} and not (i and t[i - 1].text in (".", "?.")):
            return i + 1, declaring  # a type before a name
        return self.chain(t, i, scope), declaring

    def function(self, t: list[Token], i: int, scope: Scope, constructor: bool = False) -> int:
        """A declaration whose name is t[i]: parameters, initializers and body."""
        name, k, params = t[i].text, self.generics(t, i + 1), []
        constructor = constructor or (scope.members and scope.owner is not None and name == scope.owner)
        if k < len(t) and t[k].text == "(":
            j = self.close(t, k)
            params = self.parameters(t[k + 1 : j], scope)
            k = j + 1
        inside = Scope(scope.owner, scope.method, scope.function)
        if not constructor:
            if scope.members and scope.owner is not None:
                inside.method = (name, params)
            else:
                inside.function = (name, params)
        while k < len(t) and t[k].text in ("async", "sync", "*", "native", "external"):
            k += 1
        if k < len(t) and t[k].text == ":":  # constructor initializers
            end = k + 1
            while end < len(t) and t[end].text not in ("{", ";"):
                end = self.close(t, end) + 1 if t[end].text in ("(", "[") else end + 1
            self.walk(t[k + 1 : end], inside)
            k = end
        if k < len(t) and t[k].text == "{":
            j = self.close(t, k)
            self.walk(t[k + 1 : j], inside)
            return j + 1
        if k < len(t) and t[k].text in ("=>", "="):
            end = k + 1
            while end < len(t) and t[end].text not in (";", ",") and t[end].text not in _CLOSE:
                end = self.close(t, end) + 1 if t[end].text in _OPEN else end + 1
            self.walk(t[k + 1 : end], inside)
            return end
        return k

    def parameters(self, t: list[Token], scope: Scope) -> list[str]:
        names = []
        for p in self.split(t):
            if p and p[0].text in ("{", "["):
                names += self.parameters(p[1 : self.close(p, 0)], scope)
                continue
            cut = next((k for k, x in enumerate(p) if x.text in ("=", ":") and x.kind == "op"), len(p))
            head = p[:cut]
            paren = next((k for k, x in enumerate(head) if x.text == "(" and k and head[k - 1].kind == "id" and head[k - 1].text != "Function"), len(head))
            ids = [x.text for x in head[:paren] if x.kind == "id"]
            names.append(ids[-1] if ids else "")
            self.walk(p[cut + 1 :], Scope(scope.owner, scope.method, scope.function))
        return names

    def variable(self, t: list[Token], i: int, scope: Scope) -> int:
        end = self.stop(t, i + 2)
        value = t[i + 2 : end]
        expr = self.lower(value)
        inside = Scope(scope.owner, scope.method, scope.function)
        if expr[0] == "?":
            self.walk(value, inside)
            return end
        names = [t[i].text] + ([f"{scope.owner}.{t[i].text}"] if scope.owner else [])
        for n in names:
            self.add("constant", t[i].start, name=n, expr=expr)
        self.muted += 1
        self.walk(value, inside)
        self.muted -= 1
        return end

    def chain(self, t: list[Token], i: int, scope: Scope) -> int:
        """Identifiers, selectors and calls that belong to one target; outermost node first, as a tree would be visited."""
        start, k, names = i, i + 1, [t[i].text]
        while k + 1 < len(t) and t[k].text in (".", "?.") and t[k + 1].kind == "id":
            names.append(t[k + 1].text)
            k += 2
        g = self.generics(t, k)
        if g < len(t) and t[g].text == "(":
            j = self.close(t, g)
            target = names[:-1]
            text = self.src[t[start].start : t[k - 2].start] if target else None
            self.call(names[-1], t[g + 1 : j], t[start], t[min(j, len(t) - 1)], scope, target=text)
            if target:
                self.dotted(t, start, target)
            self.arguments(t[g + 1 : j], scope)
            return self.tail(t, j + 1, scope)
        self.dotted(t, start, names)
        return self.tail(t, k, scope)

    def dotted(self, t: list[Token], i: int, names: list[str]) -> None:
        for n in range(len(names), 1, -1):
            self.use(".".join(names[:n]), t[i].start, t[i + 2 * n - 2].end)
        if len(names) == 1:
            self.use(names[0], t[i].start, t[i].end)

    def tail(self, t: list[Token], k: int, scope: Scope) -> int:
        """Selectors after a call, an index or a cascade."""
        while k < len(t):
            if t[k].text in (".", "?.", "..", "?..") and k + 1 < len(t) and t[k + 1].kind == "id":
                name = t[k + 1]
                g = self.generics(t, k + 2)
                if g < len(t) and t[g].text == "(":
                    j = self.close(t, g)
                    text = None if ".." in t[k].text else self.src[max(0, t[k].start - 200) : t[k].start]
                    self.call(name.text, t[g + 1 : j], name, t[min(j, len(t) - 1)], scope, target=text)
                    self.arguments(t[g + 1 : j], scope)
                    k = j + 1
                else:
                    k += 2
            elif t[k].text == "!" and k + 1 < len(t) and t[k + 1].text in (".", "[", "("):
                k += 1
            elif t[k].text == "[" and t[k - 1].end == t[k].start:
                j = self.close(t, k)
                self.walk(t[k + 1 : j], Scope(scope.owner, scope.method, scope.function))
                k = j + 1
            else:
                return k
        return k

    def call(self, name: str, inside: list[Token], first: Token, last: Token, scope: Scope, target: str | None = None, provider: bool = False) -> None:
        args = self.split(inside)
        named = [len(a) > 1 and a[0].kind == "id" and a[1].text == ":" for a in args]
        lowered = [["?", self.source(a)] if n else self.lower(a) for a, n in zip(args, named)]
        self.add("call", first.start, name=name, expr=lowered)
        load = name in _PROVIDERS if provider else name == "asset" or (name in _LOADS and target is not None and "bundle" in target.lower())
        positional = [(a, e) for a, n, e in zip(args, named, lowered) if not n]
        if not load or not positional:
            return
        arg, expr = positional[0]
        source = truncate(self.src[first.start : last.end])
        self.captured.add(arg[0].start)
        package = next((a[2].parts[0] for a, n in zip(args, named) if n and a[0].text == "package" and len(a) == 3 and a[2].kind == "str" and len(a[2].parts) == 1), None)
        if len(arg) == 1 and arg[0].kind == "id" and arg[0].text not in KEYWORDS:
            name_, params = scope.method or scope.function or ("", [])
            if arg[0].text in params:
                self.add("pending", first.start, name=name_, parameter=arg[0].text, index=params.index(arg[0].text), snippet=source)
                return
        self.add("candidate", first.start, expr=expr, how="literal", snippet=source, load=True, package=package)

    def arguments(self, inside: list[Token], scope: Scope) -> None:
        for a in self.split(inside):
            if len(a) > 1 and a[0].kind == "id" and a[1].text == ":":
                a = a[2:]
                if len(a) == 1 and a[0].kind == "id":
                    continue
            self.walk(a, Scope(scope.owner, scope.method, scope.function))


def is_generated(name: str, src: str) -> bool:
    return name.endswith(".gen.dart") or "FlutterGen" in src or "package:flutter_gen" in src


def generated_members(src: str) -> list[tuple[str, str, list]]:
    """(class, member, expression) of each accessor of a generated file."""
    t, out, i = tokenize(src), [], 0
    r = Reader(src)
    while i < len(t):
        if t[i].text == "class" and i + 1 < len(t) and t[i + 1].kind == "id":
            owner, k = t[i + 1].text, i + 1
            while k < len(t) and t[k].text != "{":
                k += 1
            j = r.close(t, k)
            out += [(owner, *m) for m in _members(r, t[k + 1 : j])]
            i = j
        i += 1
    return out


def _members(r: Reader, t: list[Token]) -> list[tuple[str, list]]:
    out, i = [], 0
    while i < len(t):
        x = t[i]
        if x.text == "@":
            i += 2
            if i < len(t) and t[i].text == "(":
                i = r.close(t, i) + 1
        elif x.text == "get" and i + 1 < len(t) and t[i + 1].kind == "id":
            name, k = t[i + 1].text, i + 2
            if k < len(t) and t[k].text == "=>":
                end = r.stop(t, k + 1)
                value = _generated_value(r, t[k + 1 : end])
                i = end
            elif k < len(t) and t[k].text == "{":
                end = r.close(t, k)
                body, value = t[k + 1 : end], None
                back = next((n for n, y in enumerate(body) if y.text == "return"), None)
                if back is not None:
                    value = _generated_value(r, body[back + 1 : r.stop(body, back + 1)])
                i = end + 1
            else:
                value, i = None, k
            if value:
                out.append((name, value))
        elif x.kind == "id" and i + 1 < len(t) and t[i + 1].text == "=" and t[i + 1].kind == "op":
            end = r.stop(t, i + 2)
            value = _generated_value(r, t[i + 2 : end])
            typed = i and t[i - 1].kind == "id" and t[i - 1].text not in KEYWORDS
            if value or typed:
                out.append((x.text, value or ["class", t[i - 1].text]))
            i = end
        elif x.text in _OPEN:
            i = r.close(t, i) + 1
        else:
            i += 1
    return out


def _generated_value(r: Reader, t: list[Token]):
    if len(t) == 1 and t[0].kind == "str" and len(t[0].parts) == 1:
        return ["lit", t[0].parts[0]]
    explicit = bool(t) and t[0].text in ("const", "new")
    t = t[explicit:]
    if not t or t[0].kind != "id":
        return None
    k, names = 0, [t[0].text]
    while k + 2 < len(t) and t[k + 1].text == "." and t[k + 2].kind == "id":
        k += 2
        names.append(t[k].text)
    g = r.generics(t, k + 1)
    if g >= len(t) or t[g].text != "(" or r.close(t, g) != len(t) - 1:
        return None
    for a in r.split(t[g + 1 : -1]):
        if len(a) == 1 and a[0].kind == "str" and len(a[0].parts) == 1:
            return ["lit", a[0].parts[0]]
    name = names[0] if explicit else names[-1]
    return ["class", name] if explicit or name[0] == "$" or name[0].isupper() else None


def read(src: str, name: str) -> list[dict]:
    """All rows of one file, expressions as JSON; generated files give accessors only."""
    if is_generated(name, src):
        return [{"kind": "member", "owner": c, "name": m, "expr": json.dumps(e)} for c, m, e in generated_members(src)]
    rows = Reader(src).read()
    for r in rows:
        if "expr" in r:
            r["expr"] = json.dumps(r["expr"])
    return rows
