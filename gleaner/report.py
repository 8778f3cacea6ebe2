"""Reports: JSON for machines, Markdown for reviews, text for terminals."""

from __future__ import annotations

import json
import os

from gleaner.plans.audit import Audit

SCHEMA_VERSION = 1
TITLES = {
    "UNUSED_ASSET": "Unused assets", "POSSIBLY_USED_ASSET": "Possibly used (dynamic reference)", "DYNAMIC_REFERENCE": "Dynamic references",
    "UNRESOLVABLE_DYNAMIC_REFERENCE": "Unresolvable dynamic references", "MISSING_DECLARED_ASSET": "Declared but missing from disk",
    "UNDECLARED_REFERENCE": "Referenced but not declared", "UNDECLARED_ON_DISK": "On disk but not declared", "DUPLICATE_ASSETS": "Exact duplicates",
    "EMPTY_FILE": "Empty files", "SIMILAR_ASSETS": "Near-duplicate images", "SCALED_VARIANT": "Scaled variants", "SIMILAR_SVG": "Near-duplicate SVGs",
    "LARGE_ASSET": "Large files", "PNG_WITHOUT_ALPHA": "PNG format hints", "PROBLEMATIC_FILENAME": "Problematic filenames",
    "CASE_COLLISION": "Case collisions", "UNUSED_FONT_FAMILY": "Unused font families", "EMPTY_ASSET_DIRECTORY": "Empty asset directories",
}


def human_bytes(n: int) -> str:
    """The driver-side twin of ``functions.paths.human_bytes``; halves round up here too."""
    if n < 1024:
        return f"{n} B"
    v = float(n)
    for unit in ("KB", "MB", "GB", "TB"):
        v /= 1024
        if v < 1024 or unit == "TB":
            break
    if v >= 100:
        return f"{int(v + 0.5)} {unit}"
    return f"{int(v * 10 + 0.5) / 10:.1f} {unit}"


def display(o: dict) -> str:
    return ":".join(str(o[k]) for k in ("file", "line", "column")[: 1 if o["line"] is None else 2 if o["column"] is None else 3])


def plural(n: int, one: str) -> str:
    return f"{n} {one}{'' if n == 1 else 's'}"


def sections(audit: Audit) -> dict[str, list[dict]]:
    """Findings by code, in the order in which they come."""
    out: dict[str, list[dict]] = {}
    for f in audit.rows:
        out.setdefault(f["code"], []).append(f)
    return out


def as_json(audit: Audit, indent: int | None = 2) -> str:
    def item(f: dict) -> dict:
        out = {"severity": f["severity"], "code": f["code"], "message": f["message"], "path": f["path"]}
        out["occurrences"] = [{k: v for k, v in o.items() if v is not None} for o in f["occurrences"]]
        out["relatedPaths"] = f["related_paths"]
        return out | ({"data": f["data"]} if f["data"] else {})

    body = {"schemaVersion": SCHEMA_VERSION, "root": audit.context.config.root, "packages": [p.name for p in audit.context.project.package_list], "summary": audit.summary, "findings": [item(f) for f in audit.rows]}
    return json.dumps(body, indent=indent, ensure_ascii=False) + "\n"


def as_markdown(audit: Audit) -> str:
    s, escape = audit.summary, lambda t: t.replace("|", r"\|").replace("\n", " ")
    metrics = [("Unused", s["unused"]), ("Reclaimable", human_bytes(s["reclaimableBytes"])), ("Duplicate groups", s["duplicateGroups"]), ("Similar groups", s["similarGroups"]), ("Possibly used (kept)", s["possiblyUsed"]), ("Errors", s["errors"]), ("Warnings", s["warnings"])]
    out = ["# Asset audit", "", f"{s['assetCount']} assets across {plural(s['packageCount'], 'package')}.", "", "| Metric | Value |", "| --- | --- |"]
    out += [f"| {k} | {v} |" for k, v in metrics] + [""]
    if not audit.rows:
        out.append("No problems found. ✅")
    for code, findings in sections(audit).items():
        out += [f"## {TITLES.get(code, code)} ({len(findings)})", "", "| Severity | Path | Detail |", "| --- | --- | --- |"]
        for f in findings:
            at = f" <br> `{display(f['occurrences'][0])}`" if f["occurrences"] else ""
            more = " <br> " + " ".join(f"`{r}`" for r in f["related_paths"][:5]) + (" …" if len(f["related_paths"]) > 5 else "") if f["related_paths"] else ""
            out.append(f"| {f['severity']} | `{f['path'] or '—'}` | {escape(f['message'])}{at}{more} |")
        out.append("")
    return "\n".join(out) + "\n"


_CODES = {"bold": "1", "dim": "2", "red": "31", "green": "32", "yellow": "33", "blue": "34", "cyan": "36"}
_LEVEL = {"error": ("error  ", ("bold", "red")), "warning": ("warning", ("yellow",)), "info": ("info   ", ("dim",))}


def as_text(audit: Audit, color: bool = False) -> str:
    def paint(t: str, *styles: str) -> str:
        return "".join(f"\x1b[{_CODES[s]}m" for s in styles) + t + "\x1b[0m" if color else t

    s, pad = audit.summary, " " * 11
    out = [paint("Asset audit", "bold"), paint(f"{os.path.basename(audit.context.config.root)}  ·  {plural(s['packageCount'], 'package')}  ·  {plural(s['assetCount'], 'asset')}", "dim"), ""]
    if not audit.rows:
        return "\n".join([*out, paint("No problems found.", "green")]) + "\n"
    for code, findings in sections(audit).items():
        spare = sum(f["reclaimable_bytes"] for f in findings)
        count = f"{len(findings)} · {human_bytes(spare)} reclaimable" if spare else str(len(findings))
        out.append(f"{paint(TITLES.get(code, code), 'bold')} {paint(f'({count})', 'dim')}")
        for f in findings:
            label, styles = _LEVEL[f["severity"]]
            out += [f"  {paint(label, *styles)}  {paint(f['path'] or '', 'cyan')}", pad + f["message"]]
            out += [pad + paint("at " + display(o), "dim") for o in f["occurrences"][:3]]
            out += [pad + paint("+ " + r, "dim") for r in f["related_paths"][:5]]
            if len(f["related_paths"]) > 5:
                out.append(pad + paint(f"+ {len(f['related_paths']) - 5} more", "dim"))
        out.append("")
    groups = lambda n, w: f"{n} {w} group{'' if n == 1 else 's'}"
    counts = [paint(plural(s["errors"], "error"), "red" if s["errors"] else "dim"), paint(plural(s["warnings"], "warning"), "yellow" if s["warnings"] else "dim"), paint(f"{s['info']} info", "dim")]
    if s["possiblyUsed"]:
        counts.append(paint(f"{s['possiblyUsed']} possibly used (never deleted)", "blue"))
    out += [paint("Summary", "bold"), f"  {s['unused']} unused ({human_bytes(s['reclaimableBytes'])} reclaimable), {groups(s['duplicateGroups'], 'duplicate')}, {groups(s['similarGroups'], 'similar')}", "  " + ", ".join(counts)]
    return "\n".join(out) + "\n"


RENDER = {"json": as_json, "markdown": as_markdown}
