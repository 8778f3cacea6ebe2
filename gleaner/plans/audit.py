"""A whole audit: load the project, resolve references, run the checks, sort the findings, count them."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import CHECKS, SEVERITIES, AuditConfig
from gleaner.operators import groups
from gleaner.plans import checks
from gleaner.plans.resolve import resolve
from gleaner.scratch import materialize
from gleaner.sources.project import load

log = logging.getLogger("gleaner")


@dataclass
class Audit:
    context: checks.Context
    findings: DataFrame
    rows: list[dict]
    summary: dict

    def should_fail(self, level: str | None) -> bool:
        return level is not None and any(SEVERITIES[r["severity"]] >= SEVERITIES[level] for r in self.rows)


def summarize(context: checks.Context, findings: DataFrame) -> dict:
    """The report's counters, in one pass over the findings."""
    code = lambda *c: F.col("code").isin(*c)
    level = lambda s: F.col("severity") == s
    cases = {"unused": code("UNUSED_ASSET"), "possiblyUsed": code("POSSIBLY_USED_ASSET"), "duplicateGroups": code("DUPLICATE_ASSETS"), "similarGroups": code("SIMILAR_ASSETS", "SCALED_VARIANT", "SIMILAR_SVG"), "dynamicReferences": code("DYNAMIC_REFERENCE"), "unresolvableReferences": code("UNRESOLVABLE_DYNAMIC_REFERENCE"), "errors": level("error"), "warnings": level("warning"), "info": level("info")}
    r = groups.counters(findings, cases, {"reclaimableBytes": F.when(code("UNUSED_ASSET"), F.col("reclaimable_bytes")).otherwise(0)}).first().asDict()
    out = {"assetCount": context.project.assets.count(), "packageCount": len(context.project.package_list)}
    for k in ("unused", "possiblyUsed"):
        out[k] = r[k]
    out["reclaimableBytes"] = r["reclaimableBytes"] or 0
    for k in ("duplicateGroups", "similarGroups", "dynamicReferences", "unresolvableReferences", "errors", "warnings", "info"):
        out[k] = r[k]
    return out


def run(spark: SparkSession, config: AuditConfig, registry: dict[str, checks.Check] | None = None, hasher: checks.Hasher = checks.images.fingerprint) -> Audit:
    """Checks that aren't selected are never planned. A check under a name of its own runs with ``all`` only.

    ``hasher`` makes the fingerprint of a picture's pixels; files are read, digested and fingerprinted once for all checks.
    """
    began = time.time()
    project = load(spark, config)
    log.info("%d package(s): %s", len(project.package_list), ", ".join(p.name for p in project.package_list))
    context = checks.Context(project, resolve(project), config, hasher=hasher)
    parts = []
    for name, check in (registry or checks.REGISTRY).items():
        if config.runs(name) if name in CHECKS else "all" in config.checks:
            parts += check(context)
            log.info("planned check %s", name)
    empty = spark.createDataFrame([], checks.FINDING)
    findings = checks.ordered(materialize(reduce(DataFrame.unionByName, parts, empty), "findings"))
    rows = [_row(r) for r in findings.collect()]  # a report is for people: the findings are what they read
    out = Audit(context, findings, rows, summarize(context, findings))
    log.info("audit took %.1f s", time.time() - began)
    return out


@dataclass(frozen=True)
class Runner:
    """Audits with checks and a picture hasher of one's own, for use inside other programs."""

    registry: dict[str, checks.Check] = field(default_factory=lambda: dict(checks.REGISTRY))
    hasher: checks.Hasher = checks.images.fingerprint

    def run(self, spark: SparkSession, config: AuditConfig) -> Audit:
        return run(spark, config, self.registry, self.hasher)


def _row(r) -> dict:
    d = r.asDict(recursive=True)
    d["data"] = json.loads(d["data"]) if d["data"] else {}
    return d
