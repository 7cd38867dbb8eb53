"""Validation and repair by a rule pack: all predicates in one projection, all counts in one aggregate."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cleaner import run_pipeline, to_spark
from ..config import CleanConfig, make_config
from ..plans.repair import RID, c, data_columns, with_rid
from ..report import CleanReport
from .checks import CHECKS, GROUPS, NEEDS_ALL, REPAIRS
from .packs import HEALTHCARE, LAYERS, MEDIA, SIGNALS, SINGLE, TRANSPORT, Pack, Rule

WEIGHTS = {"error": 1.0, "warning": 0.25, "info": 0.05}
SAMPLES = 5
GROUP = "millrace.domains"
_OWN: dict[str, Pack] = {}


def register(name: str, pack: Pack) -> None:
    """An own pack; the built-in names win."""
    _OWN[name] = pack


def domains() -> list[str]:
    return sorted({*SINGLE, "transport", "healthcare", "media", *_OWN, *(e.name for e in entry_points(group=GROUP))})


def plain(name: str) -> str:
    return re.sub(r"[\s_\-]+", "", name).casefold()


def map_columns(pack: Pack, columns: list[str], column_map: dict[str, str] | None = None) -> dict[str, str]:
    """Canonical field to actual column: given, exact, by case, by another spelling."""
    given = column_map or {}
    for name, actual in given.items():
        if actual not in columns:
            raise ValueError(f"column_map: {name!r} names the absent column {actual!r}")
    out = {}
    for name in pack.fields:
        by_case = next((x for x in columns if x.casefold() == name.casefold()), None)
        other = {plain(s) for s in pack.spellings.get(name, (name,))}
        by_name = next((x for x in columns if plain(x) in other), None)
        found = given.get(name) or (name if name in columns else by_case or by_name)
        if found:
            out[name] = found
    return out


def choose_pack(domain: str, columns: list[str], *, gtfs_file: str | None = None, fhir_resource: str | None = None, media_type: str | None = None) -> Pack:
    if domain in SINGLE:
        return SINGLE[domain]
    kinds, given = {"transport": (TRANSPORT, gtfs_file), "healthcare": (HEALTHCARE, fhir_resource), "media": (MEDIA, media_type)}.get(domain, (None, None))
    if kinds is None:
        if domain in _OWN:
            return _OWN[domain]
        for e in entry_points(group=GROUP):
            if e.name == domain:
                return e.load()
        raise ValueError(f"unknown domain {domain!r}; known: {domains()}")
    if given is not None:
        if given not in kinds:
            raise ValueError(f"unknown {domain} kind {given!r}; known: {sorted(kinds)}")
        return kinds[given]
    if domain == "transport":
        raise ValueError("transport needs gtfs_file= for a single table, or a dict of tables")
    shown = [k for k, p in kinds.items() if any(f in map_columns(p, columns) for f in SIGNALS[k])]
    if domain == "healthcare" and "Patient" in shown and len(shown) > 1:
        shown.remove("Patient")
    if len(shown) != 1:
        raise ValueError(f"can't tell the {domain} kind from the columns: {shown or 'no signal'}; pass it explicitly")
    return kinds[shown[0]]


@dataclass
class Finding:
    rule: Rule
    violations: int
    rows: int
    table_level: str | None = None
    samples: list = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.violations and not self.table_level

    def to_dict(self) -> dict[str, Any]:
        return {"rule_id": self.rule.id, "layer": self.rule.layer, "severity": self.rule.severity, "fields": list(self.rule.fields), "violations": self.violations, "passed": self.passed, "issue": self.table_level, "samples": self.samples}


@dataclass
class Outcome:
    frame: DataFrame
    findings: list[Finding]
    trust: float
    repairs: list[dict]
    mapping: dict[str, str]
    violations: DataFrame  # rule_id, row id
    pack: Pack

    def to_frame(self) -> DataFrame:
        rows = [(f.rule.id, f.rule.layer, f.rule.severity, ",".join(f.rule.fields), f.violations, f.passed) for f in self.findings]
        return self.frame.sparkSession.createDataFrame(rows, "rule_id string, layer string, severity string, fields string, violations long, passed boolean")


def validate(df, pack: Pack, *, column_map: dict[str, str] | None = None, siblings: dict[str, DataFrame] | None = None, today: datetime.date | None = None, audit_include_phi: bool = False) -> Outcome:
    """Every rule of the pack, then its repairs. ``today`` fixes what rules about now compare with."""
    df = with_rid(to_spark(df), CleanConfig())
    mapping = map_columns(pack, data_columns(df), column_map)
    ctx = {"today": F.lit(today) if today else F.current_date(), "all": {k: c(v) for k, v in mapping.items()}, "rid": F.col(RID)}
    predicates: dict[str, Column] = {}
    findings: list[Finding] = []
    for rule in sorted(pack.rules, key=lambda r: LAYERS.index(r.layer)):
        here = {k: ctx["all"][k] for k in rule.fields if k in mapping}
        if rule.check in ("not_null", "required"):
            gone = [k for k in rule.fields if k not in mapping]
            findings.append(Finding(rule, 0, 0, f"missing required field(s) {gone}" if gone else None))
        elif rule.check == "sibling":
            if rule.fields[0] not in mapping or rule.params["file"] not in (siblings or {}):
                continue
            findings.append(Finding(rule, 0, 0))
        elif not here or rule.fields[0] not in mapping or (rule.check in NEEDS_ALL and len(here) < len(rule.fields)):
            continue
        else:
            findings.append(Finding(rule, 0, 0))
        if rule.check == "sibling":
            other = siblings[rule.params["file"]]
            keys = other.select(c(rule.params["target"]).alias("_key")).filter("_key is not null").distinct().withColumn("_found", F.lit(True))
            df = df.join(keys, c(mapping[rule.fields[0]]) == F.col("_key"), "left").drop("_key").withColumnRenamed("_found", f"_in_{rule.id}")
            predicates[rule.id] = here[rule.fields[0]].isNotNull() & F.col(f"_in_{rule.id}").isNull()
        elif here:
            if rule.check in GROUPS:  # the keys meet the rows again by a join, which deals hot keys; null keys are in no group
                key, flag = here[rule.fields[0]], f"_in_{rule.id}"
                keys = df.filter(key.isNotNull()).groupBy(key.alias("_key")).agg(GROUPS[rule.check](rule, here).alias(flag)).filter(c(flag)).select("_key", c(flag))
                df = df.join(keys, key == F.col("_key"), "left").drop("_key")
                ctx["flagged"] = c(flag)
            predicates[rule.id] = CHECKS[rule.check](rule, here, ctx)
    checked = df.withColumns({f"_v_{i}": F.coalesce(p, F.lit(False)) for i, p in enumerate(predicates.values())}) if predicates else df
    counts = checked.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(f"_v_{i}").alias(f"v{i}") for i in range(len(predicates)))).first()
    order = {rule_id: i for i, rule_id in enumerate(predicates)}
    for f in findings:
        f.rows = counts["n"]
        if f.rule.id in order:
            f.violations = counts[f"v{order[f.rule.id]}"]
    trust = trust_of(findings, counts["n"])
    repaired, log = apply_repairs(checked, findings, mapping, pack, order, audit_include_phi)
    hits = F.filter(F.array(*(F.when(F.col(f"_v_{i}"), F.lit(r)) for r, i in order.items())), lambda x: x.isNotNull()) if order else F.array().cast("array<string>")
    rows = checked.select(F.col(RID).alias("row"), F.explode(hits).alias("rule_id"))
    keep = [n for n in data_columns(df) if not n.startswith("_in_")]
    return Outcome(repaired.select(*(c(n) for n in keep)), findings, trust, log, mapping, rows, pack)


def trust_of(findings: list[Finding], rows: int) -> float:
    lost = sum(WEIGHTS[f.rule.severity] * (1.0 if f.table_level else min(f.violations / rows, 1.0) if rows else 0.0) for f in findings)
    return max(0.0, min(1.0, 1.0 - lost))


def apply_repairs(df: DataFrame, findings: list[Finding], mapping: dict[str, str], pack: Pack, order: dict[str, int], show_private: bool) -> tuple[DataFrame, list[dict]]:
    """Coerced values in one projection; ids may be coerced but are never filled or dropped."""
    log: list[dict] = []
    change: dict[str, Column] = {}
    measures = {}
    for f in findings:
        rule = f.rule
        if not f.violations or rule.repair in ("none", "flag_only"):
            if f.violations and rule.repair == "flag_only":
                log.append({"rule_id": rule.id, "action": "flag_only", "rows": f.violations})
            continue
        name = mapping[rule.fields[0]]
        if rule.repair == "reject":
            if rule.fields[0] in pack.ids:
                continue
            df = df.filter(~F.col(f"_v_{order[rule.id]}"))
            log.append({"rule_id": rule.id, "action": "reject", "rows": f.violations})
            continue
        if rule.repair == "fill_default":
            if rule.fields[0] in pack.ids:
                continue
            value = F.lit(rule.params["default"])
        else:
            value = REPAIRS[rule.repair](rule, c(name))
        new = F.when(F.col(f"_v_{order[rule.id]}"), value)
        kind = df.schema[name].dataType
        change[name] = F.coalesce(new.cast(kind) if not isinstance(kind, T.StringType) else new, c(name))
        measures[rule.id] = (name, new)
    if measures:
        got = df.agg(*(F.count(v).alias(f"n{i}") for i, (_, v) in enumerate(measures.values()))).first()
        for i, (rule_id, (name, _)) in enumerate(measures.items()):
            log.append({"rule_id": rule_id, "action": "coerce", "column": name, "rows": got[f"n{i}"]})
        df = df.withColumns(change)
    private = {mapping[p] for p in pack.private if p in mapping}
    if not show_private:
        for entry in log:
            if entry.get("column") in private:
                entry["values"] = "[PHI]"
    return df, log


def fold(report: CleanReport, outcome: Outcome) -> None:
    report.domain, report.domain_trust_score = outcome.pack.name, outcome.trust
    report.found([f.to_dict() for f in outcome.findings], outcome.repairs)
    for f in outcome.findings:
        if not f.passed:
            report.add(f"domain:{outcome.pack.name}", f"{f.rule.id}: {f.table_level or f'{f.violations} violation(s)'}", column=outcome.mapping.get(f.rule.fields[0]), risk={"error": "high", "warning": "medium", "info": "low"}[f.rule.severity])


def clean_domain(df, domain: str, config: CleanConfig | None, options: dict, *, column_map=None, gtfs_file=None, fhir_resource=None, media_type=None, audit_include_phi: bool = False, domain_kwargs: dict | None = None):
    """Conservative repair without type changes (unless a config is given), then the pack; a dict of tables is a feed."""
    config = make_config(config or CleanConfig(strategy="conservative", fix_dtypes=False), **options)
    extra = domain_kwargs or {}
    if isinstance(df, dict):
        return clean_feed(df, domain, config, column_map, audit_include_phi, extra)
    out, report = run_pipeline(to_spark(df), config)
    pack = choose_pack(domain, out.columns, gtfs_file=gtfs_file, fhir_resource=fhir_resource, media_type=media_type)
    outcome = validate(out, pack, column_map=column_map, audit_include_phi=audit_include_phi, **extra)
    fold(report, outcome)
    return outcome.frame, report


def clean_feed(tables: dict, domain: str, config: CleanConfig, column_map, audit_include_phi: bool, extra: dict):
    """Every file of a feed; references between files see the cleaned siblings."""
    if domain != "transport":
        raise TypeError(f"domain {domain!r} takes one table")
    cleaned, reports = {}, {}
    for name, t in tables.items():
        cleaned[name], reports[name] = run_pipeline(to_spark(t), config)
    out, scores, report = {}, [], CleanReport(domain=domain)
    for name, frame in cleaned.items():
        if name not in TRANSPORT:
            report.warn(f"file {name!r} has no rules; passed through")
            out[name] = frame
            continue
        outcome = validate(frame, TRANSPORT[name], column_map=column_map, siblings=cleaned, audit_include_phi=audit_include_phi, **extra)
        out[name] = outcome.frame
        scores.append(outcome.trust)
        fold(report, outcome)
        report.before(reports[name])
    report.domain_trust_score = sum(scores) / len(scores) if scores else None
    report.rows_before, report.rows_after = (sum(getattr(r, k) for r in reports.values()) for k in ("rows_before", "rows_after"))
    return out, report
