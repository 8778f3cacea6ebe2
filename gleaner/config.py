"""Settings of an audit: defaults, then the project's YAML file, then what the command line says."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

import yaml

CONFIG_FILE = "gleaner.yaml"
CHECKS = ("unused", "missing", "duplicates", "similar", "hygiene")
SEVERITIES = {"info": 0, "warning": 1, "error": 2}
_SPELLINGS = {"info": "info", "warn": "warning", "warning": "warning", "err": "error", "error": "error"}


class ConfigError(Exception):
    """A setting that can't be used; the message is for the user."""


@dataclass(frozen=True)
class AuditConfig:
    root: str
    ignore: tuple[str, ...] = ()
    similarity_threshold: int = 5
    max_file_size_kb: int = 500
    max_hash_size: int = 10 << 20
    fail_on: str | None = "error"
    treat_dynamic_as_used: bool = True
    treat_unresolvable_as_wildcard: bool = False
    checks: frozenset[str] = field(default_factory=lambda: frozenset(["all"]))
    format: str = "pretty"
    output: str | None = None
    verbose: bool = False
    delete_unused: bool = False
    dry_run: bool = True
    assume_yes: bool = False
    color: bool = False
    #: stricter than the default: a deletion stops where loads can't be traced
    block_on_unresolvable: bool = False

    def runs(self, check: str) -> bool:
        return "all" in self.checks or check in self.checks


def parse_severity(text: str) -> str | None:
    return _SPELLINGS.get(text.strip().lower())


def load_config(root: str) -> AuditConfig:
    """Defaults overlaid with the project's file; a file that can't be understood is an error, a missing one isn't."""
    base, path = AuditConfig(root), os.path.join(root, CONFIG_FILE)
    if not os.path.isfile(path):
        return base
    try:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
    except yaml.YAMLError as e:
        raise ConfigError(f"{CONFIG_FILE}: not valid YAML ({e})") from e
    if data is None:
        return base
    if not isinstance(data, dict):
        raise ConfigError(f"{CONFIG_FILE}: the top level must be a map")

    def number(key: str) -> int | None:
        v = data.get(key)
        if v is None or (isinstance(v, int) and not isinstance(v, bool)):
            return v
        try:
            return int(str(v))
        except ValueError:
            raise ConfigError(f'{CONFIG_FILE}: {key} must be an integer, not "{v}"') from None

    def flag(key: str) -> bool | None:
        v = data.get(key)
        if v is not None and not isinstance(v, bool):
            raise ConfigError(f'{CONFIG_FILE}: {key} must be true or false, not "{v}"')
        return v

    ignore = data.get("ignore")
    if ignore is not None and not isinstance(ignore, list):
        raise ConfigError(f"{CONFIG_FILE}: ignore must be a list")
    changes = {
        "ignore": None if ignore is None else tuple(map(str, ignore)),
        "similarity_threshold": number("similarity_threshold"),
        "max_file_size_kb": number("max_file_size_kb"),
        "max_hash_size": None if (mb := number("max_hash_size_mb")) is None else mb << 20,
        "treat_dynamic_as_used": flag("treat_dynamic_as_used"),
        "treat_unresolvable_as_wildcard": flag("treat_unresolvable_as_wildcard"),
    }
    out = replace(base, **{k: v for k, v in changes.items() if v is not None})
    if data.get("fail_on") is not None:
        text = str(data["fail_on"])
        level = None if text.strip().lower() == "none" else parse_severity(text)
        if level is None and text.strip().lower() != "none":
            raise ConfigError(f'{CONFIG_FILE}: fail_on must be one of none, warning, error, not "{text}"')
        out = replace(out, fail_on=level)
    return out
