"""Deletes unused assets: never by default, only in a clean git tree, only after a yes. Runs on the driver alone."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from gleaner.operators import groups
from gleaner.plans.audit import Audit
from gleaner.report import human_bytes


@dataclass
class Outcome:
    deleted: list[str] = field(default_factory=list)
    freed_bytes: int = 0
    manifest_entries: list[str] = field(default_factory=list)
    directories: list[str] = field(default_factory=list)
    abort_reason: str | None = None
    dry_run: bool = False


def candidates(audit: Audit) -> list:
    """Assets that a finding calls unused, with their variants, and that nothing marks."""
    named = audit.findings.where("code = 'UNUSED_ASSET'").select(F.explode(F.concat(F.array("path"), "related_paths")).alias("path")).distinct()
    return audit.context.assets.where(F.col("status") == groups.UNUSED).join(named, "path", "left_semi").select("path", "absolute_path", "size_bytes").orderBy("path").collect()


def _git(root: str, *args: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", *args], cwd=root, capture_output=True, text=True)


def blocker(root: str) -> str | None:
    """Why deleted files could not be recovered, if they could not."""
    try:
        if _git(root, "rev-parse", "--is-inside-work-tree").returncode:
            return f"{root} is not inside a git working tree; deleted files could not be recovered."
        status = _git(root, "status", "--porcelain")
    except OSError:
        return "git is not available; deletions could not be undone."
    if status.returncode:
        return "git status can't be read; nothing is deleted."
    if status.stdout.strip():
        return "The working tree has uncommitted changes. Commit or stash them, so that the deletion stands alone."
    return None


def run(audit: Audit, say: Callable[[str], None], ask: Callable[[], str | None]) -> Outcome:
    config, rows = audit.context.config, candidates(audit)
    if not rows:
        return Outcome(abort_reason="No unused assets to delete.")
    total = sum(r["size_bytes"] for r in rows)
    say(f"\n{len(rows)} unused asset(s), {human_bytes(total)}:")
    for r in rows:
        say(f"  {r['path']}  ({human_bytes(r['size_bytes'])})")
    if config.dry_run:
        say("\nDry run: nothing was deleted. Add --no-dry-run to apply.")
        return Outcome([r["path"] for r in rows], total, dry_run=True)

    def stop(reason: str) -> Outcome:
        say("\n" + reason)
        return Outcome(abort_reason=reason)

    if reason := blocker(config.root):
        return stop(reason)
    lost = audit.context.usage.unresolvable.count()
    if lost and config.block_on_unresolvable:
        return stop(f"{lost} load(s) can't be traced, and block_on_unresolvable is set.")
    if not config.assume_yes:
        if lost:
            say(f"\n{lost} load(s) can't be traced; they may reach assets that this audit does not see.")
        say('\nDelete these files for good? Type "yes" to go on: ')
        if (ask() or "").strip().lower() != "yes":
            return stop("Cancelled at the prompt.")
    out = Outcome()
    for r in rows:
        try:
            os.remove(r["absolute_path"])
            out.deleted.append(r["path"])
            out.freed_bytes += r["size_bytes"]
        except OSError as e:
            say(f"  could not delete {r['path']}: {e.strerror}")
    _prune(audit, out, say)
    return out


def _prune(audit: Audit, out: Outcome, say: Callable[[str], None]) -> None:
    """Remove declared directories that hold no files any more, and the manifest lines that name them."""
    root = audit.context.config.root
    gone: dict[str, list[int]] = {}
    for p in audit.context.project.package_list:
        for d in p.declarations:
            full = os.path.join(root, d["path"])
            if d["kind"] != "directory" or not os.path.isdir(full):
                continue
            if any(not f.startswith(".") for _, _, files in os.walk(full) for f in files):
                continue
            if _drop_line(root, d, gone, say):
                out.manifest_entries.append(f"{d['origin']['file']}: {d['raw_entry']}")
            try:
                shutil.rmtree(full)
                out.directories.append(d["path"])
            except OSError:
                pass  # an empty directory does no harm


def _drop_line(root: str, d: dict, gone: dict[str, list[int]], say: Callable[[str], None]) -> bool:
    """Edit one line and leave every other as it is; lines removed before shift the place."""
    file, line = os.path.join(root, d["origin"]["file"]), d["origin"]["line"]
    try:
        with open(file, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except OSError:
        return False
    at = line - 1 - sum(g < line for g in gone.get(file, []))
    if not 0 <= at < len(lines):
        return False
    text = lines[at].strip()
    if not text.startswith("-") or d["raw_entry"] not in text:
        say(f"  left {d['origin']['file']}:{line} alone: it no longer reads `- {d['raw_entry']}`.")
        return False
    del lines[at]
    gone.setdefault(file, []).append(line)
    with open(file, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return True
