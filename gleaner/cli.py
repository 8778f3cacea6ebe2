"""Command line: exit code 0 for success, 1 for findings at the gate, 2 for usage errors."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Callable
from dataclasses import replace
from typing import TextIO

from pyspark.sql import SparkSession

from gleaner import __version__, delete, report
from gleaner.config import CHECKS, AuditConfig, ConfigError, load_config
from gleaner.plans import audit

OK, FINDINGS, USAGE = 0, 1, 2


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ConfigError(f"{message}\n\n{self.format_help()}")


def _within(low: int, high: int | None = None) -> Callable[[str], int]:
    def parse(text: str) -> int:
        n = int(text)
        if n < low or (high is not None and n > high):
            raise argparse.ArgumentTypeError(f"must be {low} or more" if high is None else f"must be from {low} to {high}")
        return n

    return parse


def _checks(text: str) -> list[str]:
    names = text.split(",")
    for n in names:
        if n not in (*CHECKS, "all"):
            raise argparse.ArgumentTypeError(f"no check {n!r}; there are {', '.join([*CHECKS, 'all'])}")
    return names


def _flat(lists: list[list[str]] | None) -> list[str]:
    return [x for part in lists or [] for x in part]


def parser() -> argparse.ArgumentParser:
    p = _Parser("gleaner", description="Audit the assets of a project.", add_help=False)
    a = p.add_argument
    a("--path", "-p", default=None, help="project or workspace root")
    a("--check", action="append", type=_checks, help="checks to run, separated by commas; may repeat")
    a("--format", "-f", choices=["pretty", "json", "markdown"], default="pretty")
    a("--output", "-o", help="write the report there, relative to the root")
    a("--fail-on", choices=["none", "warning", "error"])
    a("--ignore", action="append", type=lambda s: s.split(","), help="globs of paths to leave out; they add to the file's")
    a("--similarity-threshold", type=_within(0, 64))
    a("--max-file-size-kb", type=_within(0))
    a("--max-hash-size-mb", type=_within(0))
    a("--delete-unused", action="store_true")
    a("--dry-run", action=argparse.BooleanOptionalAction, default=True)
    a("--yes", "-y", action="store_true")
    a("--color", action=argparse.BooleanOptionalAction, default=True)
    a("--verbose", "-v", action="store_true")
    a("--version", action="store_true")
    a("--help", "-h", action="store_true")
    return p


def settings(o: argparse.Namespace) -> AuditConfig:
    root = os.path.abspath(o.path or os.getcwd())
    if not os.path.isdir(root):
        raise ConfigError(f"No such directory: {root}")
    c = load_config(root)
    c = replace(c, ignore=(*c.ignore, *_flat(o.ignore)), checks=frozenset(_flat(o.check) or ["all"]), format=o.format, output=o.output, verbose=o.verbose, delete_unused=o.delete_unused, dry_run=o.dry_run, assume_yes=o.yes, color=o.color and sys.stdout.isatty())
    if o.fail_on:
        c = replace(c, fail_on=None if o.fail_on == "none" else o.fail_on)
    for name, value in (("similarity_threshold", o.similarity_threshold), ("max_file_size_kb", o.max_file_size_kb), ("max_hash_size", None if o.max_hash_size_mb is None else o.max_hash_size_mb << 20)):
        if value is not None:
            c = replace(c, **{name: value})
    return c


def main(args: list[str] | None = None, spark: SparkSession | None = None, out: TextIO | None = None, err: TextIO | None = None, ask: Callable[[], str | None] | None = None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    p = parser()
    try:
        o = p.parse_args(args)
        if o.help or o.version:
            out.write(p.format_help() if o.help else f"gleaner {__version__}\n")
            return OK
        config = settings(o)
        if config.verbose:
            logging.getLogger("gleaner").addHandler(logging.StreamHandler(err))
            logging.getLogger("gleaner").setLevel(logging.INFO)
        if config.delete_unused and not config.runs("unused"):
            raise ConfigError("--delete-unused needs the unused check; add --check unused.")
        spark = spark or SparkSession.builder.appName("gleaner").getOrCreate()
        result = audit.run(spark, config)
        text = report.RENDER[config.format](result) if config.format in report.RENDER else report.as_text(result, config.color)
        if config.output is None:
            out.write(text)
        else:
            path = os.path.join(config.root, config.output)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            err.write(f"Report written to {path}\n")
        if config.delete_unused:
            sink = out if config.format == "pretty" and config.output is None else err
            done = delete.run(result, lambda s: sink.write(s + "\n"), ask or sys.stdin.readline)
            if done.abort_reason is None and not done.dry_run:
                sink.write(f"\nDeleted {len(done.deleted)} file(s).\n")
                sink.writelines(f"Removed manifest entry {e}\n" for e in done.manifest_entries)
        return FINDINGS if result.should_fail(config.fail_on) else OK
    except ConfigError as e:
        err.write(f"{e}\n")
        return USAGE


if __name__ == "__main__":
    sys.exit(main())
