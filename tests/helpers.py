"""Project trees for tests, and what tests ask of audits."""

import struct
import zlib
from pathlib import Path


def png(width=64, height=64, pattern="gradient", alpha=True, tweak=0, opaque=True) -> bytes:
    """A small deterministic PNG: grey ramps or flat grey, RGBA or RGB."""
    rows = bytearray()
    for y in range(height):
        rows.append(0)
        for x in range(width):
            ramp = x * 255 // max(1, width - 1)
            v = {"gradient": ramp, "reverse": 255 - ramp, "flat": 128}[pattern]
            if tweak and x == y == 0:
                v = min(254, max(1, tweak % 255))
            rows += bytes([v] * 3 + ([255 if opaque else 90] if alpha else []))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 6 if alpha else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes(rows))) + chunk(b"IEND", b"")


def pubspec(name="app", assets=(), fonts="", flutter=True) -> str:
    if not flutter:
        return f"name: {name}\n"
    out = f"name: {name}\n\ndependencies:\n  flutter:\n    sdk: flutter\n\nflutter:\n  uses-material-design: true\n"
    if assets:
        out += "  assets:\n" + "".join(f"    - {a}\n" for a in assets)
    return out + (fonts and "  fonts:\n" + fonts)


class Tree:
    """A project directory under construction, and audits of it."""

    def __init__(self, root: Path, spark):
        self.root, self.spark = root, spark

    def put(self, **files) -> "Tree":
        return self.files(files)

    def files(self, files: dict) -> "Tree":
        for path, content in files.items():
            at = self.root / path
            if path.endswith("/"):
                at.mkdir(parents=True, exist_ok=True)
                continue
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(content if isinstance(content, bytes) else content.encode())
        return self

    def audit(self, *checks, **settings):
        from gleaner.config import AuditConfig
        from gleaner.plans import audit

        return audit.run(self.spark, AuditConfig(str(self.root), checks=frozenset(checks or ["all"]), **settings))


def paths(audit, code):
    return sorted(f["path"] or "" for f in audit.rows if f["code"] == code)


def only(audit, code):
    found = [f for f in audit.rows if f["code"] == code]
    assert len(found) == 1, found
    return found[0]
