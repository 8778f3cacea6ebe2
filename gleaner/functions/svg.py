"""SVG normal forms, so that files equal but for ids, comments, blanks and far decimals digest alike."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

_DROP = [re.compile(r"<\?xml[^>]*\?>"), re.compile(r"<!doctype[^>]*>", re.I), re.compile(r"<!--.*?-->", re.S)]
_NAMES = "id|xml:id|data-name|inkscape:label|sodipodi:[A-Za-z0-9_]+"
_IDS = re.compile(rf"\s(?:{_NAMES})\s*=\s*(?:\"[^\"\n]*\"|'[^'\n]*')")
_NUMBER = re.compile(r"-?\d+\.\d+", re.ASCII)
_PATH = re.compile(r"(?<=\s)d\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def _round(m: re.Match) -> str:
    text = str(Decimal(float(m[0])).quantize(Decimal("0.01"), ROUND_HALF_UP))
    return text.rstrip("0").rstrip(".")


def normalize(svg: str) -> str | None:
    """The normal form, or null for what holds no svg element."""
    if "<svg" not in svg:
        return None
    for pattern in _DROP:
        svg = pattern.sub("", svg)
    svg = _IDS.sub("", svg)
    svg = re.sub(r"\s+", " ", re.sub(r">\s+<", "><", svg))
    return _NUMBER.sub(_round, svg).strip()


def path_data(svg: str) -> str:
    """All path geometry, joined by spaces."""
    return " ".join(a or b for a, b in _PATH.findall(svg))
