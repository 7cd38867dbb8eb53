"""Outliers: fences, the policy of the decision engine, and the plain clip and flag options."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CleanConfig
from ..plans.context import ColumnContext, kind_of, sample_skew
from ..plans.repair import RID, agg_row, c
from ..report import CleanReport
from . import isolation

FACTOR = {"iqr": 1.5, "zscore": 3.0}
MIN_VALUES, HEAVY, REMOVAL_WARN, NORMAL_SKEW = 20, 0.15, 0.02, 0.5


@dataclass
class Fence:
    low: float
    high: float
    label: str

    #: Intervals of ordinary values, where these aren't all from ``low`` to ``high``.
    inside: tuple[tuple[float, float], ...] = ()

    def mask(self, col: Column) -> Column:
        if self.inside:
            usual = reduce(lambda a, b: a | b, ((col > lo) & (col <= hi) for lo, hi in self.inside))
            return F.coalesce(~usual, F.lit(False))
        return F.coalesce((col < self.low) | (col > self.high), F.lit(False))


def quantile(col: Column, p: list[float] | float, config: CleanConfig, rows: int | None) -> Column:
    """Exact with linear interpolation; beyond ``exact_quantile_rows`` rows, to 1e-4 of rank in bounded memory."""
    if rows is not None and rows > config.exact_quantile_rows:
        return F.percentile_approx(col.cast("double"), p, 10_000)
    return F.percentile(col.cast("double"), p)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.name != RID and kind_of(f.dataType) in ("integer", "double")]


def fences(df: DataFrame, config: CleanConfig, cols: list[str] | None = None, min_values: int = MIN_VALUES, integer_safe: bool = True) -> dict[str, Fence]:
    """Fences of each numeric column with enough values; none where the spread is zero."""
    cols = numeric_columns(df) if cols is None else cols
    if not cols:
        return {}
    rows = df.count()
    m = agg_row(df, {(n, k): v for n in cols for k, v in (("n", F.count(c(n))), ("q", quantile(c(n), [0.25, 0.75], config, rows)), ("mean", F.avg(c(n))), ("std", F.stddev_samp(c(n).cast("double"))))})
    method = dict.fromkeys(cols, config.outlier_method)
    isolated = isolation_fences(df, config, {n: m[n, "n"] for n in cols}, integer_safe) if config.outlier_method == "isolation_forest" else {}
    note = " (isolation_forest found nothing or too few values, fell back)" if config.outlier_method == "isolation_forest" else ""
    if config.outlier_method in ("auto", "isolation_forest"):
        inner = {}
        for n in cols:
            q = m[n, "q"]
            x = c(n).cast("double")
            if q and q[1] > q[0]:
                x = F.when(x.between(q[0] - 3 * (q[1] - q[0]), q[1] + 3 * (q[1] - q[0])), x)
            inner |= {(n, "skew"): F.skewness(x), (n, "n"): F.count(x)}
        s = agg_row(df, inner)
        method = {n: "zscore" if (k := sample_skew(s[n, "skew"], s[n, "n"])) is not None and abs(k) < NORMAL_SKEW else "iqr" for n in cols}
    out = {}
    for n in cols:
        if m[n, "n"] < min_values:
            continue
        if n in isolated:
            out[n] = isolated[n]
            continue
        factor = config.outlier_factor or FACTOR[method[n]]
        if method[n] == "iqr":
            q1, q3 = m[n, "q"]
            if q3 == q1:
                continue
            low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        else:
            if not m[n, "std"]:
                continue
            mean = float(m[n, "mean"])
            low, high = mean - factor * m[n, "std"], mean + factor * m[n, "std"]
        if integer_safe and kind_of(df.schema[n].dataType) == "integer":
            low, high = float(low // 1), float(-(-high // 1))
        out[n] = Fence(low, high, f"method={method[n]}, factor={factor:g}{note}")
    return out


def isolation_fences(df: DataFrame, config: CleanConfig, counts: dict[str, int], integer_safe: bool = True) -> dict[str, Fence]:
    """Fences by an isolation forest a column, from a bounded sample of its values; low and high are the extremes of the ordinary ones."""
    cols = [n for n, k in counts.items() if k >= isolation.MIN_VALUES]
    if not cols:
        return {}
    share = min(1.0, isolation.SAMPLE / max(counts.values()))
    row = F.xxhash64(F.col(RID) if RID in df.columns else F.struct(*(c(n) for n in cols)), F.lit(config.random_state))
    some = df if share == 1 else df.filter(F.pmod(row, F.lit(1_000_000)) < int(share * 1_000_000))
    sample = some.select(*(c(n).cast("double").alias(n) for n in cols)).toPandas()
    found = {n: isolation.inliers(v, config.random_state) for n in cols if len(v := sample[n].dropna().to_numpy()) >= isolation.MIN_VALUES}
    masks = {n: Fence(0, 0, "", tuple(inside)) for n, inside in found.items() if inside and inside != [(-np.inf, np.inf)]}
    usual = {n: F.when(~f.mask(c(n).cast("double")), c(n).cast("double")) for n, f in masks.items()}
    edges = agg_row(df, {(n, k): f(v) for n, v in usual.items() for k, f in (("lo", F.min), ("hi", F.max))}) if usual else {}
    out = {}
    for n, f in masks.items():
        low, high = edges[n, "lo"], edges[n, "hi"]
        if low is None:
            continue
        if integer_safe and kind_of(df.schema[n].dataType) == "integer":
            low, high = float(low // 1), float(-(-high // 1))
        out[n] = Fence(low, high, "method=isolation_forest, contamination=auto", f.inside)
    return out


def choose(ctx: ColumnContext, config: CleanConfig, share: float) -> tuple[str | None, str]:
    """(action or None to preserve, reason)."""
    if ctx.role in ("id", "target"):
        return None, f"{ctx.role} column: its values are never altered"
    if ctx.sensitive:
        return None, "extreme values of this kind of column are usually the signal"
    if config.outlier_action is None:
        return None, "outlier_action is None"
    if ctx.name in config.preserve_columns:
        return None, "listed in preserve_columns"
    if config.outlier_action != "auto":
        return config.outlier_action, f"outlier_action={config.outlier_action} requested"
    if share > HEAVY:
        return "flag", "heavy-tailed: the extremes are likely real"
    return ("flag", "balanced mode flags, it doesn't alter") if config.mode == "balanced" else ("cap", "aggressive mode caps to the fences")


def flag_name(df: DataFrame, name: str) -> str:
    base, k = f"{name}_outlier", 2
    out = base
    while out in df.columns:
        out, k = f"{base}_{k}", k + 1
    return out


def engine_outliers(df: DataFrame, config: CleanConfig, report: CleanReport, contexts: dict[str, ColumnContext]) -> DataFrame:
    """Detect on the filled data, all columns at once; then one projection and at most one filter."""
    if config.outliers is not None or config.mode is None:
        return df
    found = {n: f for n, f in fences(df, config).items() if n in contexts}
    if not found:
        return df
    m = agg_row(df, {(n, k): v for n, f in found.items() for k, v in (("out", F.count_if(f.mask(c(n)))), ("n", F.count(c(n))))} | {"*": F.count(F.lit(1))})
    change: dict[str, Column] = {}
    remove: Column | None = None
    for n, fence in found.items():
        count = m[n, "out"]
        if not count:
            continue
        share = count / m[n, "n"]
        detail = f"{count} outlier(s), {100 * share:.1f}% of values ({fence.label})"
        action, reason = choose(contexts[n], config, share)
        confidence = 0.85 if share <= 0.02 else 0.7 if share <= 0.10 else 0.5
        risk = "low" if share <= 0.02 else "medium"
        if action is None:
            report.add("outliers", f"preserved {detail}", column=n, rationale=reason, confidence=0.9, model_id="preserve")
            if contexts[n].sensitive:
                report.recommend(f"column '{n}' has {count} extreme value(s), preserved; review them")
            continue
        if config.outlier_action in ("cap", "remove") and share > HEAVY:
            report.warn(f"column '{n}': {config.outlier_action} applied to {100 * share:.0f}% of its values; they may be real")
        mask = fence.mask(c(n))
        if action == "cap":
            kind = df.schema[n].dataType
            change[n] = F.when(c(n).isNotNull(), F.greatest(F.least(c(n).cast("double"), F.lit(fence.high)), F.lit(fence.low)).cast(kind))
            report.add("outliers", f"capped {detail} to [{fence.low:g}, {fence.high:g}]", column=n, count=count, rationale=reason, risk=risk, confidence=confidence, model_id="cap")
        elif action == "remove":
            remove = mask if remove is None else remove | mask
            report.add("outliers", f"removed rows with {detail}", column=n, count=count, rationale=reason, risk="medium" if share <= 0.02 else "high", confidence=confidence, model_id="remove")
        else:
            base = f"{n}_outlier"
            if base in df.columns and kind_of(df.schema[base].dataType) == "boolean" and not df.filter(~c(base).eqNullSafe(mask)).limit(1).count():
                continue  # flagged by an earlier run
            name = flag_name(df, n)
            change[name] = mask
            report.add("outliers", f"flagged {detail} in new column {name!r}", column=n, count=count, rationale=reason, confidence=confidence, model_id="flag")
    if change:
        df = df.withColumns(change)
    if remove is not None:
        gone = df.filter(remove).count()
        df = df.filter(~remove)
        if gone / m["*"] > REMOVAL_WARN:
            report.warn(f"outlier removal dropped {gone} row(s), {100 * gone / m['*']:.1f}% of the data; outlier_action='cap' would keep them")
    return df


def plain_outliers(df: DataFrame, config: CleanConfig, report: CleanReport) -> DataFrame:
    """outliers='clip' or 'flag' on every numeric column."""
    if config.outliers is None:
        return df
    found = fences(df, config, min_values=1)
    counts = agg_row(df, {n: F.count_if(f.mask(c(n))) for n, f in found.items()}) if found else {}
    change: dict[str, Column] = {}
    for n, fence in found.items():
        if not counts[n]:
            continue
        if config.outliers == "clip":
            change[n] = F.when(c(n).isNotNull(), F.greatest(F.least(c(n).cast("double"), F.lit(fence.high)), F.lit(fence.low)).cast(df.schema[n].dataType))
        else:
            change[flag_name(df, n)] = fence.mask(c(n))
        report.add("outliers", f"{config.outliers}: {counts[n]} value(s) ({fence.label})", column=n, count=counts[n])
    return df.withColumns(change) if change else df
