"""Missing values: bands, ranked models, fills, and the plain impute option."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CleanConfig
from ..plans.context import MIN_ROWS, ColumnContext, row_range
from ..plans.repair import RID, agg_row, c
from ..report import CleanReport
from .outliers import fences, quantile

MEAN_SKEW, KNN_ROWS, KNN_CORR, KNN_MAX_CORR, KNN_PARTNERS, NEIGHBOURS, BLOCK = 0.5, 10_000, 0.4, 0.98, 5, 5, 256
CORR_MIN_ROWS = 30


@dataclass(frozen=True)
class Choice:
    model: str
    confidence: float
    rationale: str
    eligible: bool = True
    rejection: str = ""


@dataclass(frozen=True)
class Selection:
    primary: Choice
    alternatives: tuple[Choice, ...] = ()


def band(ratio: float, config: CleanConfig) -> str:
    for name in ("low", "medium", "high"):
        if ratio <= getattr(config, f"missing_threshold_{name}"):
            return name
    return "extreme"


def rank_models(ctx: ColumnContext, config: CleanConfig, outliers: bool = False, partners: dict[str, float] | None = None) -> Selection:
    """Models for one column, best first; nothing is executed."""
    where, mode, partners = band(ctx.ratio, config), config.mode, partners or {}
    found: list[Choice] = []
    add = lambda *a, **k: found.append(Choice(*a, **k))
    if ctx.role in ("target", "text"):
        add("preserve", 1.0, f"{ctx.role} column")
    elif ctx.role == "id":
        add("preserve", 0.95, "identifier column")
        if mode == "aggressive" and where == "extreme" and not ctx.preserve:
            add("drop", 0.7, "mostly missing identifier")
    elif ctx.n_rows < MIN_ROWS and where != "low":
        add("preserve", 0.9, f"too few rows ({ctx.n_rows})")
    elif where in ("high", "extreme") and mode == "balanced":
        add("preserve", 0.85, f"{where} missingness: balanced mode keeps columns")
    elif where in ("high", "extreme") and not ctx.preserve:
        if ctx.informative:
            add("preserve", 0.6, "missingness is informative")
        else:
            add("drop", 0.75, f"{where} missingness without signal")
    elif ctx.role == "datetime":
        add(*(("time_fill", 0.9, "times are in order") if ctx.time_ordered else ("preserve", 0.8, "times without usable order")))
    elif ctx.role == "numeric":
        if where == "low" and abs(ctx.skew or 0) < MEAN_SKEW and not outliers:
            add("mean", 0.9, "few gaps, near-normal values")
            add("median", 0.7, "robust alternative", rejection="near-normal values")
        else:
            add("median", 0.88, "robust default")
            add("mean", 0.5, "mean is less robust here", rejection="skew or outliers")
        if where == "medium" and partners:
            best = max(partners, key=partners.__getitem__)
            knn = mode == "aggressive" and len(partners) >= 2 and ctx.n_rows <= KNN_ROWS
            add("partner_median", 0.82, f"correlated with {best!r}")
            add("knn", 0.78 if knn else 0.3, "neighbours in correlated columns", knn, "" if knn else "balanced mode, few partners or many rows")
            add("linear", 0.72 if mode == "aggressive" else 0.25, "regression on the best partner", mode == "aggressive", "" if mode == "aggressive" else "balanced mode")
    else:
        dominant = ctx.mode_ratio is not None and ctx.mode_ratio >= (0.6 if where == "medium" else 0.5)
        add("mode", 0.85 if dominant else 0.45, "dominant value" if dominant else "no dominant value")
        add("sentinel", 0.55 if dominant else 0.8, "explicit marker")
    order = sorted(found, key=lambda x: -x.confidence)
    primary = next((x for x in order if x.eligible), order[0])
    return Selection(primary, tuple(x for x in order if x.model != primary.model)[:4])


@dataclass
class Fill:
    """One decision: ``what`` is a value, "time", "knn", "drop" or None (preserve)."""

    what: object
    model: str
    confidence: float
    risk: str
    rationale: str
    indicator: bool = False


def decide(ctx: ColumnContext, config: CleanConfig, stats: dict, selection: Selection) -> Fill:
    """What is done with one column, by its role and band. ``stats`` has mean, median, outliers, knn."""
    where, mode, model = band(ctx.ratio, config), config.mode, selection.primary.model
    keep = lambda confidence, risk, why: Fill(None, model, confidence, risk, why)
    if ctx.role == "target":
        return keep(1.0, "medium" if where == "low" else "high", "label column: never modified")
    if ctx.role == "id":
        if mode == "aggressive" and where == "extreme" and not ctx.preserve and ctx.n_rows >= MIN_ROWS:
            return Fill("drop", "drop", 0.85, "medium", "an identifier that is mostly missing can't be a key")
        return keep(1.0, "medium", "identifier: filling it would invent identities")
    if ctx.role == "text":
        return keep(1.0, "low", "free text: filling it would invent content")
    if ctx.n_rows < MIN_ROWS and where != "low":
        return keep(0.6, "medium", f"{ctx.n_rows} rows are too few to trust the ratio")
    if where in ("high", "extreme"):
        confidence = 0.7 if where == "high" else 0.9
        if not ctx.non_null and not config.drop_empty_columns:
            return keep(0.9, "high", "drop_empty_columns is off")
        if mode == "balanced" or (where == "extreme" and ctx.preserve):
            return keep(confidence, "high", "balanced mode keeps columns" if mode == "balanced" else "listed in preserve_columns")
        if where == "extreme" or not (ctx.preserve or ctx.informative):
            return Fill("drop", "drop", confidence, "medium", f"{where} share of missing values without signal")
        return _kept_high(ctx, stats)
    if ctx.role == "datetime":
        if not ctx.time_ordered:
            return keep(1.0, "medium", "times without usable order")
        return Fill("time", "time_fill", 0.8, "low", "values in time order: carried forward, then backward")
    flag = ctx.informative if config.missing_indicators == "auto" else bool(config.missing_indicators)
    if ctx.role == "numeric":
        if where == "low":
            if abs(ctx.skew or 0) < MEAN_SKEW and not stats["outliers"]:
                return Fill(stats["mean"], "mean", 0.9, "low", "few gaps, near-normal values", flag)
            return Fill(stats["median"], "median", 0.9, "low", "few gaps, skewed values or outliers", flag)
        if stats.get("knn"):
            return Fill("knn", "knn", 0.75, "medium", "neighbours in correlated columns", flag)
        return Fill(stats["median"], "median", 0.8, "low", "robust to skew", flag)
    if ctx.role == "boolean":
        return Fill(ctx.mode, "mode", 0.85 if where == "low" else 0.75, "low" if where == "low" else "medium", "most frequent value", flag)
    if where == "low":
        if (ctx.mode_ratio or 0) >= 0.5:
            return Fill(ctx.mode, "mode", 0.85, "low", "one value dominates", flag)
        return Fill("Unknown", "sentinel", 0.7, "low", "no value dominates", flag)
    if (ctx.mode_ratio or 0) >= 0.6:
        return Fill(ctx.mode, "mode", 0.75, "medium", "one value dominates", flag)
    return Fill("Missing", "sentinel", 0.7, "medium", "no value dominates", flag)


def _kept_high(ctx: ColumnContext, stats: dict) -> Fill:
    why = "kept because it is preserved or its missingness is informative"
    if ctx.role == "numeric":
        return Fill(stats["median"], "median", 0.5, "high", why, True)
    if ctx.role == "boolean":
        return Fill(ctx.mode, "mode", 0.5, "high", why, True)
    if ctx.role == "datetime":
        return Fill("time" if ctx.time_ordered else None, "time_fill", 0.5, "high", why, True)
    return Fill("Missing", "sentinel", 0.5, "high", why, True)


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows that have both; null where either is constant."""
    a, b = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def partners_of(df: DataFrame, ctx: ColumnContext, contexts: dict[str, ColumnContext], rows: int) -> dict[str, float]:
    """|Pearson| of numeric columns with ``ctx``, pairwise complete, in one job; only for columns that may use it."""
    if rows < CORR_MIN_ROWS:
        return {}
    others = [x.name for x in contexts.values() if x.kind in ("integer", "double") and x.name != ctx.name and x.non_null]
    m = agg_row(df, {n: pearson(c(n), c(ctx.name)) for n in others}) if others else {}
    return {n: abs(v) for n, v in m.items() if v is not None and v == v and abs(v) >= KNN_CORR}


def engine_missing(df: DataFrame, config: CleanConfig, report: CleanReport, contexts: dict[str, ColumnContext]) -> DataFrame:
    """Decide every column from aggregates, then fill all of them in one projection."""
    if config.impute is not None or config.mode is None:
        return df
    gaps = [x for x in contexts.values() if x.n_missing]
    if not gaps:
        return df
    numeric = [x for x in gaps if x.role == "numeric" and x.non_null]
    stats = _numeric_stats(df, config, numeric)
    change: dict[str, Column] = {}
    drop, timed, neighbours = [], [], []
    for x in gaps:
        own = stats.get(x.name, {"mean": None, "median": None, "outliers": False})
        partners: dict[str, float] = {}
        if x.role == "numeric" and config.mode == "aggressive" and band(x.ratio, config) == "medium" and config.advanced_imputation is not False and x.n_rows <= KNN_ROWS:
            partners = partners_of(df, x, contexts, x.n_rows)
            close = sorted((n for n, r in partners.items() if r < KNN_MAX_CORR), key=lambda n: -partners[n])[:KNN_PARTNERS]
            own["knn"] = close if len(close) >= 2 else None
        fill = decide(x, config, own, rank_models(x, config, own["outliers"], partners))
        note = dict(column=x.name, rationale=fill.rationale, risk=fill.risk, confidence=fill.confidence, model_id=fill.model)
        share = f"{x.n_missing} missing ({100 * x.ratio:.1f}%)"
        if fill.what is None:
            report.add("missing", f"preserved {share}", outcome="preserved", **note)
            if x.role == "target":
                report.warn(f"target column '{x.name}' has {share}; rows without a label usually go")
            elif x.role == "id":
                report.recommend(f"id column '{x.name}' has {share}; check whether those rows can be joined")
            elif fill.risk in ("high", "medium"):
                report.recommend(f"review '{x.name}': {share}")
            continue
        if fill.what == "drop":
            drop.append(x.name)
            report.add("missing", f"dropped column: {share}", count=1, outcome="dropped", **note)
            continue
        if fill.indicator:
            name = f"{x.name}_was_missing"
            if name not in df.columns:
                change[name] = c(x.name).isNull()
                report.add("missing", f"added indicator {name!r}", column=x.name, count=x.n_missing, confidence=0.7, rationale="keeps what the gaps tell")
        if fill.what == "time":
            timed.append(x.name)
        elif fill.what == "knn":
            neighbours.append((x.name, own["knn"], own["median"]))
        else:
            change[x.name] = filled(df, x.name, fill.what)
        shown = fill.model if fill.what in ("time", "knn") else f"{fill.model} {fill.what!r}"
        report.add("missing", f"filled {share} with {shown}", count=x.n_missing, outcome="imputed", **note)
    for name, partners, fallback in neighbours:
        df = knn_fill(df, name, partners, fallback)
    if change:
        df = df.withColumns(change)
    for n in timed:
        df = time_fill(df, n)
    return df.drop(*drop) if drop else df


def _numeric_stats(df: DataFrame, config: CleanConfig, cols: list[ColumnContext]) -> dict[str, dict]:
    if not cols:
        return {}
    names = [x.name for x in cols]
    rows = cols[0].n_rows
    m = agg_row(df, {(n, k): v for n in names for k, v in (("mean", F.avg(c(n))), ("median", quantile(c(n), 0.5, config, rows)))})
    low = [x.name for x in cols if band(x.ratio, config) == "low"]
    edge = fences(df, config.with_(outlier_method="iqr", outlier_factor=1.5), low, min_values=1, integer_safe=False) if low else {}
    out = agg_row(df, {n: F.count_if(f.mask(c(n))) for n, f in edge.items()}) if edge else {}
    return {n: {"mean": _plain(m[n, "mean"]), "median": _plain(m[n, "median"]), "outliers": bool(out.get(n))} for n in names}


def _plain(v):
    return None if v is None else float(v)


def filled(df: DataFrame, name: str, value) -> Column:
    """The column with ``value`` in its gaps; an integer column takes a fraction as a double."""
    kind = df.schema[name].dataType
    if isinstance(value, float) and kind.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(c(name), F.lit(int(value)).cast(kind)) if value == int(value) else F.coalesce(c(name).cast("double"), F.lit(value))
    return F.coalesce(c(name), F.lit(value).cast(kind))


def time_fill(df: DataFrame, name: str) -> DataFrame:
    """Forward, then backward, in row order.

    Row order is cut in ranges; a range carries on from the last value of the
    ranges before it (one row each), so no single task sees the whole table.
    """
    ranged = df.withColumn("_p", row_range(df))
    known = F.when(c(name).isNotNull(), F.col(RID))
    ends = ranged.groupBy("_p").agg(F.max_by(c(name), known).alias("_last"), F.min_by(c(name), known).alias("_first"))
    before, after = Window.orderBy("_p"), Window.orderBy(F.desc("_p"))  # one row per range
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_p", F.last("_last", True).over(upto(before)).alias("_before"), F.last("_first", True).over(upto(after)).alias("_after"))
    rows = ranged.join(F.broadcast(carry), "_p", "left")  # as many rows as ranges
    up, down = (Window.partitionBy("_p").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(RID), F.desc(RID)))
    value = F.coalesce(F.last(c(name), True).over(up), F.col("_before"), F.last(c(name), True).over(down), F.col("_after"))
    return rows.withColumn("_filled", value).withColumn(name, F.col("_filled")).select(*(c(n) for n in df.columns))


def knn_fill(df: DataFrame, name: str, partners: list[str], fallback: float | None) -> DataFrame:
    """Mean of the nearest rows by scaled partner columns; only tables of KNN_ROWS rows at most come here,
    so the donors are a bounded table that a broadcast carries."""
    scale = agg_row(df, {(p, k): v for p in partners for k, v in (("m", F.avg(c(p))), ("s", F.stddev_samp(c(p).cast("double"))))})
    cols = [F.coalesce((c(p).cast("double") - float(scale[p, "m"])) / (scale[p, "s"] or 1.0), F.lit(0.0)).alias(f"p{i}") for i, p in enumerate(partners)]
    donors = df.filter(c(name).isNotNull()).select(c(name).cast("double").alias("v"), *cols).toPandas().to_numpy()

    @F.pandas_udf("double")
    def near(*columns: pd.Series) -> pd.Series:
        x = np.stack([col.to_numpy() for col in columns], 1)
        k = min(NEIGHBOURS, len(donors))
        out = np.empty(len(x))
        for at in range(0, len(x), BLOCK):  # distances of a block of rows to all donors at once
            part = x[at : at + BLOCK]
            d = np.stack([(donors[:, j + 1] - part[:, j, None]) ** 2 for j in range(part.shape[1])]).sum(0)
            out[at : at + BLOCK] = donors[np.argpartition(d, k - 1, axis=1)[:, :k], 0].mean(1)
        return pd.Series(out)

    return df.withColumn(name, F.when(c(name).isNotNull(), c(name).cast("double")).otherwise(near(*cols)))


def plain_impute(df: DataFrame, config: CleanConfig, report: CleanReport) -> DataFrame:
    """impute= on every column with gaps: mean or median of numbers, mode of the rest."""
    if config.impute is None:
        return df
    from ..plans.context import build_contexts, modes

    contexts = build_contexts(df, config, need_modes=False, need_counts=False)
    gaps = [x for x in contexts.values() if x.n_missing and x.non_null and x.kind != "nested"]
    numeric = [x for x in gaps if x.kind in ("integer", "double") and config.impute != "mode"]
    stats = _numeric_stats(df, config, numeric)
    rest = modes(df, [x.name for x in gaps if x not in numeric and x.kind in ("string", "boolean")], contexts)
    change = {}
    for x in gaps:
        if x in numeric:
            how = "mean" if config.impute == "mean" else "median"
            value = stats[x.name][how]
        elif x.name in rest:
            how, value = "mode", rest[x.name][0]
        elif config.impute == "mode" and x.kind in ("integer", "double", "datetime"):
            how, value = "mode", agg_row(df, {0: F.mode(c(x.name), True)})[0]
            value = float(value) if x.kind in ("integer", "double") else value
        else:
            continue
        change[x.name] = filled(df, x.name, value)
        report.add("impute", f"filled {x.n_missing} missing with {how} {value!r}", column=x.name, count=x.n_missing, risk="medium", outcome="imputed")
    return df.withColumns(change) if change else df
