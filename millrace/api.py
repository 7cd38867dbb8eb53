"""Top-level calls: clean, clean_csv, profile, plans, comparisons, roles, explanations."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cleaner import missing_cells, run_pipeline, to_spark
from .config import CleanConfig, EngineConfig, make_config
from .operators.missing import band, decide, partners_of, rank_models
from .operators.missing import _numeric_stats as numeric_stats
from .operators.outliers import choose, fences
from .plans.context import build_contexts
from .plans.repair import RID, agg_row, c, data_columns, fold_nan, is_sentinel, repair, strip, suggest, text_columns, with_rid
from .report import CleanReport

SELECTORS = ("column_map", "gtfs_file", "fhir_resource", "media_type", "audit_include_phi", "domain_kwargs")


def clean(df, *, config: CleanConfig | None = None, return_report: bool = False, domain: str | None = None, engine: str | None = None, output_format: str = "spark", engine_config: EngineConfig | None = None, **options):
    """Clean a table (Spark, pandas, Arrow) or a Parquet, CSV, JSON or Arrow path.

    With ``domain`` the table is repaired conservatively, then validated and
    repaired by that rule pack. Returns the table, or (table, report).
    """
    chosen = {k: options.pop(k) for k in SELECTORS if k in options}
    if chosen and domain is None:
        raise TypeError(f"{', '.join(chosen)} need domain=")
    if engine or engine_config or output_format != "spark":
        engine_config = engine_config or EngineConfig(engine or "spark", output_format)
    if isinstance(df, str):
        from .sources.files import read_table

        df = read_table(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), df)
    if domain is not None:
        from .domains.runner import clean_domain

        out, report = clean_domain(df, domain, config, options, **chosen)
    else:
        out, report = run_pipeline(to_spark(df), make_config(config, **options))
    if output_format == "pandas":
        out = out.toPandas()
    elif output_format == "arrow":
        out = out.toArrow()
    return (out, report) if return_report else out


def clean_csv(path: str, output_path: str | None = None, *, spark: SparkSession | None = None, return_report: bool = False, read_options: dict | None = None, **options):
    """Read a CSV as text, clean it, optionally write it."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    df = spark.read.options(header=True, inferSchema=False, **(read_options or {})).csv(path)
    out, report = clean(df, return_report=True, **options)
    if output_path:
        out.write.mode("overwrite").option("header", True).csv(output_path)
    return (out, report) if return_report else out


# -- profile ----------------------------------------------------------------


@dataclass
class ColumnProfile:
    name: str
    dtype: str
    role: str
    n_missing: int
    missing_pct: float
    nunique: int | None
    issues: list[str] = field(default_factory=list)
    would_convert_to: str | None = None


@dataclass
class Profile:
    n_rows: int
    n_cols: int
    missing_cells: int
    duplicate_rows: int
    columns: list[ColumnProfile]
    plan: Any = None

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p.name, p.dtype, p.role, p.n_missing, p.missing_pct, p.nunique, "; ".join(p.issues), p.would_convert_to) for p in self.columns]
        return spark.createDataFrame(rows, "name string, dtype string, role string, n_missing long, missing_pct double, nunique long, issues string, would_convert_to string")

    def to_dict(self) -> dict:
        return asdict(self)


def duplicate_rows(df: DataFrame) -> int:
    cols = data_columns(df)
    total, groups = df.groupBy(*(c(n) for n in cols)).agg(F.count(F.lit(1)).alias("_rows_of_group")).agg(F.coalesce(F.sum("_rows_of_group"), F.lit(0)), F.count(F.lit(1))).first()
    return total - groups


def profile(df, *, config: CleanConfig | None = None, include_plan: bool = False, **options) -> Profile:
    """What is in a table and what cleaning would look at; nothing is changed."""
    config = make_config(config, **options)
    df = with_rid(fold_nan(to_spark(df)), config).persist()
    contexts = build_contexts(df, config, need_modes=False)
    rows, missing = missing_cells(df)
    texts = text_columns(df)
    m = agg_row(df, {(n, k): v for n in texts for k, v in (("strip", F.count_if(strip(c(n)) != c(n))), ("sentinel", F.count_if(is_sentinel(strip(c(n)), config.sentinels))))}) if texts else {}
    bare = df.withColumns({n: F.when(~is_sentinel(strip(c(n)), config.sentinels), strip(c(n))) for n in texts}) if texts else df
    conversions = suggest(bare, config, texts)
    edge = fences(df, config)
    out = agg_row(df, {n: F.count_if(f.mask(c(n))) for n, f in edge.items()}) if edge else {}
    columns = []
    for n, x in contexts.items():
        issues = []
        if x.n_missing:
            issues.append(f"{x.n_missing} missing ({100 * x.ratio:.1f}%)")
        if m.get((n, "strip")):
            issues.append(f"{m[n, 'strip']} value(s) with stray white space")
        if m.get((n, "sentinel")):
            issues.append(f"{m[n, 'sentinel']} sentinel value(s)")
        if out.get(n):
            issues.append(f"{out[n]} outlier(s)")
        if rows > 1 and x.nunique is not None and x.nunique <= 1:
            issues.append("constant")
        kind = conversions[n].kind if n in conversions else None
        columns.append(ColumnProfile(n, df.schema[n].dataType.simpleString(), x.role, x.n_missing, 100 * x.ratio, x.nunique, issues, kind))
    found = Profile(rows, len(columns), missing, duplicate_rows(df), columns)
    df.unpersist()
    if include_plan:
        found.plan = suggest_plan(df.drop(RID), config=config)
    return found


def infer_roles(df, *, config: CleanConfig | None = None, **options) -> DataFrame:
    """column, role, dtype, nunique, missing_ratio as a frame."""
    config = make_config(config, **options)
    df = with_rid(fold_nan(to_spark(df)), config)
    rows = [(x.name, x.role, df.schema[x.name].dataType.simpleString(), x.nunique, float(x.ratio)) for x in build_contexts(df, config, need_modes=False).values()]
    return df.sparkSession.createDataFrame(rows, "column string, role string, dtype string, nunique long, missing_ratio double")


# -- plans ------------------------------------------------------------------


@dataclass
class ColumnPlan:
    name: str
    role: str
    missing_ratio: float
    band: str
    model: str
    confidence: float
    rationale: str
    outlier_action: str | None
    outlier_share: float
    alternatives: list[str] = field(default_factory=list)


@dataclass
class CleanPlan:
    strategy: str
    n_rows: int
    columns: list[ColumnPlan]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        schema = "strategy string, name string, role string, missing_ratio double, band string, model string, confidence double, rationale string, outlier_action string, outlier_share double"
        rows = [(self.strategy, p.name, p.role, float(p.missing_ratio), p.band, p.model, float(p.confidence), p.rationale, p.outlier_action, float(p.outlier_share)) for p in self.columns]
        return spark.createDataFrame(rows, schema)

    def summary(self) -> str:
        return "\n".join(f"{p.name} ({p.role}, {100 * p.missing_ratio:.1f}% missing): {p.model}" for p in self.columns)


def suggest_plan(df, *, config: CleanConfig | None = None, **options) -> CleanPlan:
    """What the engine would do per column, on a table with its representation repaired."""
    config = make_config(config, **options)
    if config.mode is None:
        config = config.with_(strategy="balanced")
    frame = repair(with_rid(to_spark(df), config), config, CleanReport()).persist()
    contexts = build_contexts(frame, config, need_counts=False)
    stats = numeric_stats(frame, config, [x for x in contexts.values() if x.role == "numeric" and x.n_missing and x.non_null])
    edge = fences(frame, config)
    m = agg_row(frame, {(n, k): v for n, f in edge.items() for k, v in (("out", F.count_if(f.mask(c(n)))), ("n", F.count(c(n))))}) if edge else {}
    columns = []
    for n, x in contexts.items():
        share = m[n, "out"] / m[n, "n"] if n in edge and m[n, "n"] else 0.0
        action = (choose(x, config, share)[0] or "preserve") if share else None
        if not x.n_missing:
            columns.append(ColumnPlan(n, x.role, 0.0, "none", "none", 1.0, "nothing missing", action, share))
            continue
        own = stats.get(n, {"mean": None, "median": None, "outliers": False})
        medium = x.role == "numeric" and band(x.ratio, config) == "medium"
        selection = rank_models(x, config, own["outliers"], partners_of(frame, x, contexts, x.n_rows) if medium else {})
        fill = decide(x, config, own, selection)
        columns.append(ColumnPlan(n, x.role, x.ratio, band(x.ratio, config), selection.primary.model, selection.primary.confidence, fill.rationale, action, share, [a.model for a in selection.alternatives]))
    frame.unpersist()
    return CleanPlan(config.strategy, next(iter(contexts.values())).n_rows if contexts else 0, columns)


def compare_plans(df, strategies: tuple[str, ...] = ("balanced", "aggressive"), **options) -> DataFrame:
    spark = to_spark(df).sparkSession
    return reduce(DataFrame.unionByName, (suggest_plan(df, strategy=s, **options).to_frame(spark) for s in strategies))


def compare_clean(df, strategies: tuple[str, ...] = ("conservative", "balanced", "aggressive"), **options) -> DataFrame:
    """One row per strategy: shape, missing cells, actions and risks after a clean."""
    spark, rows = to_spark(df).sparkSession, []
    for s in strategies:
        _, r = clean(df, strategy=s, return_report=True, **options)
        rows.append((s, r.rows_after, r.cols_after, r.missing_after, r.duplicates_removed, r.outliers_handled, len(r), sum(a.risk == "high" for a in r)))
    return spark.createDataFrame(rows, "strategy string, rows long, cols long, missing long, duplicates_removed long, outliers_handled long, actions long, high_risk long")


@dataclass
class ExplainReport:
    rows_before: int
    rows_after: int
    columns: list[dict]
    report: CleanReport

    def to_dict(self) -> dict:
        return {"rows_before": self.rows_before, "rows_after": self.rows_after, "columns": self.columns, "report": self.report.to_dict()}


def explain_clean(df, **options) -> ExplainReport:
    """Statistics of each column before and after a clean, and the changed cells where rows line up."""
    config = make_config(**options)
    before = with_rid(fold_nan(to_spark(df)), config)
    after, report = run_pipeline(to_spark(df), config)
    stats = lambda f: agg_row(f, {(n, k): v for n in data_columns(f) for k, v in (("nulls", F.count_if(c(n).isNull())), ("nunique", F.approx_count_distinct(c(n).cast("string"))), ("min", F.min(c(n).cast("string"))), ("max", F.max(c(n).cast("string"))))})
    a, b = stats(before), stats(after)
    columns = []
    for n in dict.fromkeys([*data_columns(before), *data_columns(after)]):
        one = {k: a.get((n, k)) for k in ("nulls", "nunique", "min", "max")}
        two = {k: b.get((n, k)) for k in ("nulls", "nunique", "min", "max")}
        state = "dropped" if (n, "nulls") not in b else "added" if (n, "nulls") not in a else "changed" if one != two or report.rows_before != report.rows_after else "same"
        columns.append({"name": n, "state": state, "before": one, "after": two})
    return ExplainReport(report.rows_before, report.rows_after, columns, report)
