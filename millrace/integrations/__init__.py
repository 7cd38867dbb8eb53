"""Trust gates for orchestrators: they pass table names or frames and get a verdict."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from ..api import clean
from ..cleaner import to_spark
from ..enterprise.trust import compute_trust_score


class TrustGateFailure(RuntimeError):
    """The gate failed and was asked to raise."""


@dataclass
class TrustGateResult:
    status: str  # pass, warn, fail, skip
    trust_before: float
    trust_after: float
    threshold: float
    rows: int
    message: str

    @property
    def passed(self) -> bool:
        return self.status in ("pass", "warn", "skip")

    def to_dict(self) -> dict:
        return asdict(self) | {"passed": self.passed}


def evaluate_trust_gate(df, threshold: float = 80.0, *, on_fail: str = "fail", clean_first: bool = True, raise_on_fail: bool = False, **options):
    """(cleaned table, result). ``on_fail``: fail, warn or skip."""
    if on_fail not in ("fail", "warn", "skip"):
        raise ValueError("on_fail must be fail, warn or skip")
    df = to_spark(df)
    before = compute_trust_score(df)
    out = clean(df, **options) if clean_first else df
    after = compute_trust_score(out) if clean_first else before
    status = "pass" if after.overall >= threshold else on_fail
    result = TrustGateResult(status, before.overall, after.overall, threshold, after.n_rows, f"trust {after.overall:.1f}, threshold {threshold:g}")
    if status == "fail" and raise_on_fail:
        raise TrustGateFailure(result.message)
    return out, result


def gate_table(spark: SparkSession, table: str, threshold: float = 80.0, output_table: str | None = None, **options) -> TrustGateResult:
    """The gate on a catalog table; what orchestrator operators call with names."""
    out, result = evaluate_trust_gate(spark.table(table), threshold, **options)
    if output_table and result.passed:
        out.write.mode("overwrite").saveAsTable(output_table)
    return result


def gate_manifest(spark: SparkSession, manifest_path: str, threshold: float = 80.0, select: tuple[str, ...] = (), audit_dir: str | None = None, **options) -> dict[str, TrustGateResult]:
    """The gate on every model of a dbt manifest (or the selected ones); audits as JSON."""
    with open(manifest_path, encoding="utf-8") as f:
        nodes = json.load(f)["nodes"]
    out = {}
    for node in nodes.values():
        if node.get("resource_type") != "model" or (select and node["name"] not in select):
            continue
        relation = ".".join(x for x in (node.get("schema"), node.get("alias") or node["name"]) if x)
        out[node["name"]] = gate_table(spark, relation, threshold, **options)
        if audit_dir:
            with open(f"{audit_dir}/{node['name']}_audit.json", "w", encoding="utf-8") as f:
                json.dump(out[node["name"]].to_dict(), f, indent=2)
    return out


def airflow_operator():
    """The operator class for Airflow, where that is installed."""
    from airflow.models import BaseOperator

    class TrustGateOperator(BaseOperator):
        template_fields = ("table",)

        def __init__(self, *, table: str, threshold: float = 80.0, output_table: str | None = None, **kwargs) -> None:
            super().__init__(**kwargs)
            self.table, self.threshold, self.output_table = table, threshold, output_table

        def execute(self, context):
            result = gate_table(SparkSession.builder.getOrCreate(), self.table, self.threshold, self.output_table)
            if not result.passed:
                raise TrustGateFailure(result.message)
            return result.to_dict()

    return TrustGateOperator


def dagster_check(table: str, threshold: float = 80.0):
    """An asset check for Dagster, where that is installed."""
    from dagster import AssetCheckResult, asset_check

    @asset_check(asset=table, name=f"trust_{table}")
    def check() -> AssetCheckResult:
        result = gate_table(SparkSession.builder.getOrCreate(), table, threshold)
        return AssetCheckResult(passed=result.passed, metadata=result.to_dict())

    return check
