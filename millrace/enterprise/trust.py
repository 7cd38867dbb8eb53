"""Data trust score: completeness, validity, uniqueness and consistency of a table, from a few aggregates."""

from __future__ import annotations

import html
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cleaner import to_spark
from ..config import CleanConfig
from ..functions.text import is_sentinel, strip
from ..operators.outliers import fences
from ..plans.repair import RID, agg_row, c, data_columns, fold_nan, suggest, text_columns


@dataclass(frozen=True)
class TrustScoreWeights:
    completeness: float = 0.3
    validity: float = 0.3
    uniqueness: float = 0.2
    consistency: float = 0.2

    def __post_init__(self) -> None:
        parts = list(asdict(self).values())
        if min(parts) < 0 or sum(parts) <= 0:
            raise ValueError("weights must not be negative and not all zero")

    def normalized(self) -> dict[str, float]:
        parts = asdict(self)
        return {k: v / sum(parts.values()) for k, v in parts.items()}


@dataclass
class ColumnTrust:
    name: str
    completeness: float
    validity: float
    issues: list[str] = field(default_factory=list)


@dataclass
class TrustScore:
    overall: float
    completeness: float
    validity: float
    uniqueness: float
    consistency: float
    n_rows: int
    n_cols: int
    columns: list[ColumnTrust] = field(default_factory=list)

    @property
    def grade(self) -> str:
        return next((g for edge, g in ((90, "A"), (80, "B"), (70, "C"), (60, "D")) if self.overall >= edge), "F")

    def to_dict(self) -> dict:
        return asdict(self) | {"grade": self.grade}


def compute_trust_score(df, *, weights: TrustScoreWeights | None = None, config: CleanConfig | None = None) -> TrustScore:
    df, config = fold_nan(to_spark(df)), config or CleanConfig()
    if RID in df.columns:
        df = df.drop(RID)
    cols, w = data_columns(df), (weights or TrustScoreWeights()).normalized()
    texts = text_columns(df)
    measures = {"*": F.count(F.lit(1))}
    for n in cols:
        measures[n, "n"] = F.count(c(n))
        if df.schema[n].dataType.typeName() not in ("map", "variant", "array", "struct"):
            measures |= {(n, "lo"): F.min(c(n)), (n, "hi"): F.max(c(n))}
    for n in texts:
        measures |= {(n, "strip"): F.count_if(strip(c(n)) != c(n)), (n, "sentinel"): F.count_if(is_sentinel(strip(c(n)), config.sentinels))}
    m = agg_row(df, measures) if cols else {"*": df.count()}
    rows = m["*"]
    if not rows or not cols:
        return TrustScore(100.0, 100.0, 100.0, 100.0, 100.0, rows, len(cols))
    bare = df.withColumns({n: F.when(~is_sentinel(strip(c(n)), config.sentinels), strip(c(n))) for n in texts}) if texts else df
    conversions = suggest(bare, config, texts)
    edge = fences(df, config, integer_safe=False)
    out = agg_row(df, {n: F.count_if(f.mask(c(n))) for n, f in edge.items()}) if edge else {}
    columns, invalid_all, odd = [], 0, 0
    for n in cols:
        issues, bad, present = [], 0, m[n, "n"]
        for what, count in (("whitespace", m.get((n, "strip"))), ("sentinel", m.get((n, "sentinel"))), ("unparseable", conversions[n].coerced if n in conversions else 0), ("outlier", out.get(n))):
            if count:
                bad += count
                issues.append(f"{count} {what}")
        bad = min(bad, present)
        invalid_all += bad
        if rows > 1 and (present == 0 or ((n, "lo") in m and m[n, "lo"] == m[n, "hi"])):
            odd += 1
            issues.append("constant")
        columns.append(ColumnTrust(n, 100 * present / rows, 100 * (1 - bad / present) if present else 100.0, issues))
    present_all = sum(m[n, "n"] for n in cols)
    try:
        groups = df.groupBy(*(c(n) for n in cols)).agg(F.count(F.lit(1)).alias("_rows_of_group")).count()
    except Exception:  # map columns can't be grouped
        groups = rows
    parts = {
        "completeness": 100 * present_all / (rows * len(cols)),
        "validity": 100 * (1 - invalid_all / present_all) if present_all else 100.0,
        "uniqueness": 100 * groups / rows,
        "consistency": 100 * (1 - odd / len(cols)),
    }
    return TrustScore(sum(w[k] * v for k, v in parts.items()), *parts.values(), rows, len(cols), columns)


@dataclass
class QualityReport:
    """Trust before and after, with what was done in between."""

    before: TrustScore
    after: TrustScore
    actions: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def improvement(self) -> float:
        return self.after.overall - self.before.overall

    def to_dict(self) -> dict:
        return {"before": self.before.to_dict(), "after": self.after.to_dict(), "improvement": self.improvement, "actions": self.actions, "warnings": self.warnings}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, default=str)

    def to_html(self) -> str:
        rows = "".join(f"<tr><td>{html.escape(str(a.get('step')))}</td><td>{html.escape(str(a.get('description')))}</td></tr>" for a in self.actions)
        return f"<h1>Trust {self.before.overall:.1f} to {self.after.overall:.1f} ({self.after.grade})</h1><table>{rows}</table>"


def build_quality_report(before: DataFrame, after: DataFrame, report=None, **options) -> QualityReport:
    actions = [asdict(a) for a in report.actions] if report is not None else []
    return QualityReport(compute_trust_score(before, **options), compute_trust_score(after, **options), actions, list(report.warnings) if report is not None else [])
