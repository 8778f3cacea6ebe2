"""Path, name and size expressions, all as plain Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's \\s alone is ASCII.
WS = r"[\t-\r \x85\xa0  -     　﻿]"
VARIANT = r"^(\d+(?:\.\d+)?)x$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_posix(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), r"\\", "/")


def relative_posix(path: Column | str, root: str) -> Column:
    """``path`` below ``root``; a path elsewhere stays as it is."""
    p, base = to_posix(path), root.rstrip("/") + "/"
    return F.when(p.startswith(base), F.substring(p, F.lit(len(base) + 1), F.length(p))).otherwise(p)


def normalize_asset_path(path: Column | str) -> Column:
    """Forward slashes, no blanks around, one leading ``./`` off, runs of slashes made one; ``..`` stays."""
    p = F.regexp_replace(to_posix(path), f"^{WS}+|{WS}+$", "")
    return F.regexp_replace(F.regexp_replace(p, r"^\./", ""), "/{2,}", "/")


def package_reference(path: Column | str) -> Column:
    """struct<package, rest> of ``packages/<package>/<rest>``, or null."""
    p, pattern = _col(path), r"(?s)^packages/([^/]+)/(.+)$"
    return F.when(p.rlike(pattern), F.struct(F.regexp_extract(p, pattern, 1).alias("package"), F.regexp_extract(p, pattern, 2).alias("rest")))


def variant_scale(directory: Column | str) -> Column:
    """2.0 for ``2.0x``, 3.0 for ``3x``; null for any other directory name."""
    d = _col(directory)
    return F.when(d.rlike(VARIANT), F.regexp_extract(d, VARIANT, 1).cast("double"))


def human_bytes(size: Column | str) -> Column:
    """``512 B``, ``2.0 KB``, ``120 MB``: binary steps, one decimal below 100."""
    b = _col(size).cast("double")
    out = F.format_string("%d B", _col(size).cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = b / float(1024**power)
        text = F.when(v >= 100, F.format_string("%.0f " + unit, v)).otherwise(F.format_string("%.1f " + unit, v))
        out = F.when(b >= float(1024**power), text).otherwise(out)
    return out


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def dirname(path: Column | str) -> Column:
    """Everything before the last slash; the empty string where there is none."""
    p = _col(path)
    return F.when(p.contains("/"), F.regexp_replace(p, r"(?s)/[^/]*$", "")).otherwise("")


def extension(path: Column | str) -> Column:
    """The lower-case extension with its dot, or the empty string; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]*)$", 1))


def camel_case(name: Column | str) -> Column:
    """Words split at ``_``, ``-``, blanks and dots; the first starts small, the others capital."""
    words = F.filter(F.split(_col(name), r"[_\-\s.]+"), lambda w: w != "")
    first = lambda w, f: F.concat(f(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, first(w, F.lower)).otherwise(first(w, F.upper))), "")


def truncate(source: Column | str, most: int = 120) -> Column:
    """Blanks collapsed, cut to ``most`` characters with an ellipsis."""
    s = F.regexp_replace(_col(source), f"{WS}+", " ")
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def markdown_escape(text: Column | str) -> Column:
    return F.replace(F.replace(_col(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def display(occurrence: Column) -> Column:
    """``file[:line[:column]]``."""
    line = F.when(occurrence["line"].isNotNull(), occurrence["line"].cast("string"))
    column = F.when(occurrence["line"].isNotNull(), occurrence["column"].cast("string"))
    return F.concat_ws(":", occurrence["file"], line, column)


def filename_problems(name: Column | str) -> Column:
    """What makes a basename troublesome, in fixed order; empty where nothing does."""
    n = _col(name)
    return F.array_compact(F.array(
        F.when(n.contains(" "), F.lit("spaces")),
        F.when(n.rlike("[A-Z]"), F.lit("uppercase letters")),
        F.when(n.rlike(r"[^\x00-\x7F]"), F.lit("non-ASCII characters")),
    ))


def ancestors(path: Column | str) -> Column:
    """All directories above a path, nearest the root first."""
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.expr("cast(array() as array<string>)"))


def glob_regex(glob: str) -> str:
    """An anchored regular expression: ``*`` and ``?`` stay within a segment, ``**`` crosses, ``{a,b}`` and ``[ab]`` as usual."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return "^" + out + "$"


def is_ignored(path: Column | str, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | _col(path).rlike("(?s)" + glob_regex(g))
    return out


def looks_like_asset_path(value: Column | str) -> Column:
    """Whether an unmatched string has the shape of an asset path; the caller checks its first segment."""
    v = _col(value)
    ext = extension(v)
    return (
        F.length(v).between(1, 300) & ~v.contains("://") & ~v.startswith("package:") & ~v.startswith("/") & ~v.contains("$")
        & v.contains("/") & ~v.rlike(r"[*?]") & F.length(ext).between(2, 6) & ~ext.isin(".dart", ".yaml", ".yml", ".lock", ".md")
    )
