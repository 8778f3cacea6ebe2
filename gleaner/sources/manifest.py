"""Package manifests: discovery, entries with their lines, fonts."""

from __future__ import annotations

import os
import posixpath
import re
from dataclasses import dataclass, field

import yaml

SKIPPED = frozenset("build node_modules Pods DerivedData .dart_tool .fvm .git .idea .melos_tool .symlinks .vscode".split())
MANIFEST, DEPTH = "pubspec.yaml", 6
VARIANT_DIR = re.compile(r"^\d+(\.\d+)?x$")


@dataclass
class Package:
    name: str
    root: str
    manifest: str
    is_flutter: bool
    declarations: list[dict] = field(default_factory=list)
    fonts: list[dict] = field(default_factory=list)


def normalize(path: str) -> str:
    """The driver-side twin of ``functions.paths.normalize_asset_path``."""
    p = path.replace("\\", "/").strip()
    return re.sub("/{2,}", "/", p[2:] if p.startswith("./") else p)


def relative(path: str, root: str) -> str:
    r = os.path.relpath(path, root).replace(os.sep, "/")
    return "" if r == "." else r


def discover(root: str) -> list[Package]:
    """All packages below ``root``, the root's own first, then by path."""
    found = []
    for folder, dirs, files in os.walk(root):
        depth = 0 if folder == root else relative(folder, root).count("/") + 1
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in SKIPPED and not os.path.islink(os.path.join(folder, d))) if depth < DEPTH else []
        if MANIFEST in files:
            found.append(folder)
    packages = [p for f in found if (p := parse(f, root))]
    return sorted(packages, key=lambda p: (p.root != root, p.root))


def _child(node, key: str):
    if isinstance(node, yaml.MappingNode):
        for k, v in node.value:
            if getattr(k, "value", None) == key:
                return v
    return None


def parse(folder: str, root: str) -> Package | None:
    """One manifest; none where it can't be read, is no map or has no name."""
    path = os.path.join(folder, MANIFEST)
    try:
        with open(path, encoding="utf-8") as f:
            tree = yaml.compose(f, Loader=yaml.SafeLoader)
    except (OSError, UnicodeDecodeError, yaml.YAMLError):
        return None
    name = _child(tree, "name")
    if not isinstance(name, yaml.ScalarNode) or not name.value.strip():
        return None
    flutter, needs = _child(tree, "flutter"), _child(tree, "dependencies")
    out = Package(name.value, folder, path, isinstance(flutter, yaml.MappingNode) or _child(needs, "flutter") is not None)
    base, file = relative(folder, root), relative(path, root)
    origin = lambda n, text: {"file": file, "line": n.start_mark.line + 1, "column": None, "snippet": text}
    assets = _child(flutter, "assets")
    for n in assets.value if isinstance(assets, yaml.SequenceNode) else []:
        entry, flavors = n, []
        if isinstance(n, yaml.MappingNode):
            entry, f = _child(n, "path"), _child(n, "flavors")
            flavors = [x.value for x in f.value if isinstance(x, yaml.ScalarNode)] if isinstance(f, yaml.SequenceNode) else []
        raw = entry.value if isinstance(entry, yaml.ScalarNode) else ""
        if not raw.strip():
            continue
        clean = normalize(raw)
        is_dir = clean.endswith("/") or os.path.isdir(os.path.join(folder, clean))
        at = posixpath.normpath(posixpath.join(base, clean)) if base else posixpath.normpath(clean)
        out.declarations.append({"raw_entry": raw, "path": at, "kind": "directory" if is_dir else "file", "origin": origin(n, raw), "flavors": flavors})
    fonts = _child(flutter, "fonts")
    for n in fonts.value if isinstance(fonts, yaml.SequenceNode) else []:
        family, files = _child(n, "family"), _child(n, "fonts")
        if not isinstance(family, yaml.ScalarNode) or not family.value.strip():
            continue
        paths = []
        for f in files.value if isinstance(files, yaml.SequenceNode) else []:
            a = _child(f, "asset")
            if isinstance(a, yaml.ScalarNode) and a.value.strip():
                paths.append(posixpath.normpath(posixpath.join(base, normalize(a.value))))
        out.fonts.append({"family": family.value, "paths": paths, "origin": origin(n, family.value)})
    return out
