"""clean_enterprise: trust, clean, cluster, validate, mask, trust again, gate, lineage."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from ..cleaner import run_pipeline, to_spark
from ..config import CleanConfig, make_config
from ..report import CleanReport
from .cluster import ClusterConfig, merge_clusters
from .lineage import LineageConfig, LineageTracker
from .mask import MaskingRule, MaskReport, mask_dataframe
from .semantic import ColumnValidation, SemanticValidatorConfig, run_semantic_validation
from .trust import QualityReport, TrustScoreWeights, compute_trust_score


class TrustGateError(RuntimeError):
    """The table's trust is below what was asked for."""


@dataclass(frozen=True)
class EnterpriseConfig:
    actor: str | None = None
    enable_masking: bool = True
    enable_clustering: bool = False
    enable_validation: bool = True
    enable_lineage: bool = True
    masking: tuple[MaskingRule, ...] = ()
    clustering: ClusterConfig | None = None
    semantic: tuple[SemanticValidatorConfig, ...] = ()
    trust_weights: TrustScoreWeights = TrustScoreWeights()
    lineage: LineageConfig = LineageConfig()
    fail_under_trust: float | None = None


@dataclass
class EnterpriseResult:
    frame: DataFrame
    report: CleanReport
    quality: QualityReport
    mask_report: MaskReport = field(default_factory=MaskReport)
    cluster_changes: dict[str, int] = field(default_factory=dict)
    validation: dict[str, ColumnValidation] = field(default_factory=dict)
    lineage: LineageTracker | None = None
    passed: bool = True


def clean_enterprise(df, enterprise: EnterpriseConfig | None = None, *, config: CleanConfig | None = None, raise_on_gate: bool = False, **options) -> EnterpriseResult:
    e, config = enterprise or EnterpriseConfig(), make_config(config, **options)
    source = to_spark(df)
    tracker = LineageTracker(LineageConfig(**(asdict(e.lineage) | ({"actor": e.actor} if e.actor else {})))) if e.enable_lineage else None
    if tracker:
        tracker.start(source)
    before = compute_trust_score(source, weights=e.trust_weights, config=config)
    frame, report = run_pipeline(source, config)
    changes: dict[str, int] = {}
    if e.enable_clustering and e.clustering:
        frame, changes = merge_clusters(frame, e.clustering)
        for n, k in changes.items():
            if k:
                report.add("cluster", f"merged {k} value(s) into canonical spellings", column=n, count=k, risk="medium", confidence=0.8)
    validation = run_semantic_validation(frame, e.semantic) if e.enable_validation and e.semantic else {}
    for n, v in validation.items():
        if v.invalid:
            report.warn(f"column '{n}': {v.invalid} value(s) fail {v.validator}")
    masks = MaskReport()
    if e.enable_masking and e.masking:
        frame, masks = mask_dataframe(frame, e.masking)
        for n, how in masks.strategies.items():
            report.add("mask", f"masked by {how}", column=n, count=masks.masked.get(n, 0))
    after = compute_trust_score(frame, weights=e.trust_weights, config=config)
    passed = e.fail_under_trust is None or after.overall >= e.fail_under_trust
    if tracker:
        tracker.complete(source, frame, {"trust": {"before": before.overall, "after": after.overall, "passed": passed}})
    if not passed:
        report.warn(f"trust {after.overall:.1f} is below {e.fail_under_trust}")
        if raise_on_gate:
            raise TrustGateError(report.warnings[-1])
    quality = QualityReport(before, after, [asdict(a) for a in report.actions], list(report.warnings))
    return EnterpriseResult(frame, report, quality, masks, changes, validation, tracker, passed)
