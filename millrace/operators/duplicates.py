"""Duplicate rows: first, last, none, or aggregated, on all columns or a subset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CleanConfig
from ..plans.repair import RID, c, data_columns
from ..report import CleanReport

COUNT = "_rows_of_group"


def drop_duplicates(df: DataFrame, config: CleanConfig, report: CleanReport, rows: int | None = None) -> DataFrame:
    """Nulls are equal. Without a subset, equal rows are alike, so the kept row id is a grouped minimum
    (pre-aggregated in the map tasks); a hot group of copies costs one row per task."""
    if not config.drop_duplicates:
        return df
    cols = data_columns(df)
    if config.duplicate_subset:
        missing = [n for n in config.duplicate_subset if n not in cols]
        if missing:
            raise ValueError(f"duplicate_subset names unknown columns {missing}; names are those after renaming")
    if any(isinstance(df.schema[n].dataType, (T.MapType, T.VariantType)) for n in cols):
        return df  # not comparable
    if config.time_index and not config.allow_timeseries_duplicates and not config.duplicate_subset:
        return df
    keys = list(config.duplicate_subset or cols)
    total, groups = df.groupBy(*(c(n) for n in keys)).agg(F.count(F.lit(1)).alias(COUNT)).agg(F.sum(COUNT), F.count(F.lit(1))).first()
    total = total or 0
    extra = total - groups
    if not extra:
        return df
    share = extra / total
    out = _kept(df, keys, cols, config)
    removed = extra
    if config.duplicate_keep == "drop":
        removed = df.groupBy(*(c(n) for n in keys)).agg(F.count(F.lit(1)).alias(COUNT)).filter(F.col(COUNT) > 1).agg(F.sum(COUNT)).first()[0]
    high = share > config.duplicate_threshold
    report.add("drop_duplicates", f"removed {removed} duplicate row(s) ({100 * share:.1f}%), keep={config.duplicate_keep}", count=removed, risk="medium" if high else "low", rationale="equal rows carry no further information")
    if high:
        report.warn(f"{100 * share:.1f}% of the rows are duplicates; check the export or join that made them")
        report.recommend("review where the duplicate rows come from")
    return out


def _kept(df: DataFrame, keys: list[str], cols: list[str], config: CleanConfig) -> DataFrame:
    """One row per group, by aggregates that the map tasks begin; rows without a place in the order come last."""
    how = config.duplicate_keep
    rest = [n for n in cols if n not in keys]
    groups = df.groupBy(*(c(n) for n in keys))
    place = F.struct(F.col(RID).isNull(), F.col(RID))
    if how == "aggregate" and config.duplicate_subset:
        number = lambda n: isinstance(df.schema[n].dataType, T.NumericType)
        values = [(F.avg(c(n)) if number(n) else F.min_by(c(n), F.when(c(n).isNotNull(), F.struct(place, *_orderable(df, [n]))))).alias(n) for n in rest]
        return groups.agg(*values, F.min(RID).alias(RID)).select(*(c(n) for n in cols), RID)
    row = F.struct(*(c(n) for n in rest), F.col(RID))
    out = [c(n) if n in keys else F.col(f"_row.`{n}`").alias(n) for n in cols]
    if how == "drop":
        return groups.agg(F.count(F.lit(1)).alias(COUNT), F.first(row).alias("_row")).filter(F.col(COUNT) == 1).select(*out, F.col(f"_row.{RID}").alias(RID))
    if not rest:
        pick = F.max(RID) if how == "last" else F.min(RID)
        return groups.agg(pick.alias(RID)).select(*(c(n) for n in cols), RID)
    place = F.struct(place, *_orderable(df, rest))  # ties in the order are broken by the other columns
    pick = F.max_by(row, place) if how == "last" else F.min_by(row, place)
    return groups.agg(pick.alias("_row")).select(*out, F.col(f"_row.{RID}").alias(RID))


def _orderable(df: DataFrame, cols: list[str]) -> list[Column]:
    return [c(n) for n in cols if not isinstance(df.schema[n].dataType, (T.MapType, T.VariantType))]
