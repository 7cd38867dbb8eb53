"""Semantic validity of columns: reference sets, full-match patterns, or functions on distinct values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.repair import c


@dataclass(frozen=True)
class SemanticValidatorConfig:
    name: str
    kind: str = "reference"
    columns: tuple[str, ...] = ()
    reference: tuple[str, ...] = ()
    regex: str | None = None
    case_sensitive: bool = False
    function: Callable[[list], list] | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("reference", "regex", "callable"):
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.kind == "regex" and not self.regex:
            raise ValueError("kind='regex' needs regex=")
        if self.kind == "callable" and self.function is None:
            raise ValueError("kind='callable' needs function=")

    def valid(self, x: Column) -> Column:
        """True where a value is valid; a function gets Arrow batches of values."""
        s = x.cast("string")
        if self.kind == "reference":
            return s.isin(*self.reference) if self.case_sensitive else F.lower(s).isin(*(r.casefold() for r in self.reference))
        if self.kind == "regex":
            return s.rlike(rf"\A(?:{'' if self.case_sensitive else '(?i)'}{self.regex})\z")
        function = self.function

        @F.pandas_udf("boolean")
        def call(values: pd.Series) -> pd.Series:
            return pd.Series([bool(v) for v in function(values.tolist())])

        return call(s)


@dataclass
class ColumnValidation:
    column: str
    validator: str
    checked: int
    invalid: int
    samples: list[str] = field(default_factory=list)

    @property
    def valid_share(self) -> float:
        return 1 - self.invalid / self.checked if self.checked else 1.0


def run_semantic_validation(df: DataFrame, configs: tuple[SemanticValidatorConfig, ...]) -> dict[str, ColumnValidation]:
    """Nulls are valid; the last config of a column wins. Functions see each distinct value once."""
    chosen = {n: k for k in configs for n in k.columns if n in df.columns}
    out = {}
    for n, k in chosen.items():
        values = df.filter(c(n).isNotNull()).groupBy(c(n).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        judged = values.withColumn("ok", F.coalesce(k.valid(F.col("v")), F.lit(False)))
        row = judged.agg(F.sum("n"), F.sum(F.when(~F.col("ok"), F.col("n"))), F.min_by("v", F.when(~F.col("ok"), F.col("v")))).first()
        samples = [r[0] for r in judged.filter(~F.col("ok")).orderBy("v").limit(5).select("v").collect()] if row[1] else []
        out[n] = ColumnValidation(n, k.name, row[0] or 0, row[1] or 0, samples)
    return out
