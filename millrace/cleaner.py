"""The pipeline: plan each step from aggregates, apply it lazily, report every decision."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CleanConfig, make_config
from .operators.duplicates import drop_duplicates
from .operators.memory import optimize_memory
from .operators.missing import engine_missing, plain_impute
from .operators.outliers import engine_outliers, plain_outliers
from .plans.context import build_contexts
from .plans.repair import RID, agg_row, c, data_columns, repair, with_rid
from .report import CleanReport


def to_spark(df, spark: SparkSession | None = None) -> DataFrame:
    """A Spark frame from a Spark, pandas, Polars or Arrow table."""
    if isinstance(df, DataFrame):
        return df
    import pandas as pd
    import pyarrow as pa

    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if isinstance(df, pa.Table):
        return spark.createDataFrame(df)
    if isinstance(df, pd.DataFrame):
        return spark.createDataFrame(pa.Table.from_pandas(df, preserve_index=False))
    if type(df).__module__.startswith("polars") and hasattr(df, "to_arrow"):
        return spark.createDataFrame(df.to_arrow())
    raise TypeError(f"expected a table, got {type(df).__name__}")


def missing_cells(df: DataFrame) -> tuple[int, int]:
    """(rows, missing cells) by one aggregate."""
    cols = data_columns(df)
    m = agg_row(df, {"*": F.count(F.lit(1))} | {n: F.count(c(n)) for n in cols})
    return m["*"], m["*"] * len(cols) - sum(m[n] for n in cols)


def run_pipeline(df: DataFrame, config: CleanConfig) -> tuple[DataFrame, CleanReport]:
    """All steps in order: names, text, empties, types, constants, duplicates, missing, outliers, impute, clip, memory."""
    began, report = time.time(), CleanReport()
    df = with_rid(df, config)
    report.cols_before = len(data_columns(df))
    if len(set(df.columns)) == len(df.columns):
        from .plans.repair import fold_nan

        report.rows_before, report.missing_before = missing_cells(fold_nan(df))
    else:
        report.rows_before = df.count()
    df = repair(df, config, report)
    held = None
    if config.drop_duplicates or config.mode or config.impute or config.outliers or config.optimize_memory:
        held = df = df.persist()  # several aggregates and the result read the repaired table
    df = drop_duplicates(df, config, report)
    if data_columns(df):
        if config.mode is not None and (config.impute is None or config.outliers is None):
            contexts = build_contexts(df, config, need_counts=False)
            df = engine_missing(df, config, report, contexts)
            df = engine_outliers(df, config, report, contexts)
        df = plain_impute(df, config, report)
        df = plain_outliers(df, config, report)
        df = optimize_memory(df, config, report)
    report.rows_after, report.missing_after = missing_cells(df)
    report.cols_after = len(data_columns(df))
    if held is not None:
        held.unpersist()
    report.duration_seconds = time.time() - began
    return df.drop(RID) if RID in df.columns else df, report


class Cleaner:
    """A reusable configuration; ``report_`` holds the last report."""

    def __init__(self, config: CleanConfig | None = None, **options) -> None:
        self.config = make_config(config, **options)
        self.report_: CleanReport | None = None

    def clean(self, df) -> DataFrame:
        out, self.report_ = run_pipeline(to_spark(df), self.config)
        return out
