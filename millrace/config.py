"""Options of a cleaning run: a frozen, self-validating dataclass."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, fields, replace

#: Whole-cell spellings of "missing", compared in lower case after stripping.
SENTINELS = (
    "", "-", "--", "---", "?", "??",
    "na", "n/a", "n\\a", "\\n", "n.a", "n.a.", "nan", "null", "none", "nil", "missing",
    "(null)", "(none)", "(blank)", "(empty)", "(missing)",
    "#n/a", "#n/a n/a", "#na", "#null!", "#div/0!", "#ref!", "#value!", "#name?", "#num!",
)

CHOICES = {
    "strategy": ("conservative", "balanced", "aggressive", "auto"),
    "duplicate_keep": ("first", "last", "drop", "aggregate"),
    "outlier_action": (None, "auto", "flag", "cap", "remove"),
    "outlier_method": ("iqr", "zscore", "auto", "isolation_forest"),
    "impute": (None, "auto", "mean", "median", "mode"),
    "outliers": (None, "clip", "flag"),
    "missing_indicators": (True, False, "auto"),
    "advanced_imputation": (True, False, "auto"),
    "dayfirst": (True, False, "auto"),
}


@dataclass(frozen=True)
class CleanConfig:
    """All options; column names given to options are names after renaming."""

    column_names: bool = True
    drop_empty_rows: bool = True
    drop_empty_columns: bool = True
    drop_constant_columns: bool = False
    strip_whitespace: bool = True
    normalize_sentinels: bool = True
    extra_sentinels: tuple[str, ...] = ()
    fix_dtypes: bool = True
    numeric_threshold: float = 0.95
    datetime_threshold: float = 0.95
    preserve_leading_zeros: bool = True
    dayfirst: bool | str = "auto"
    decimal: str = "."
    thousands: str = ","
    drop_duplicates: bool = True
    duplicate_subset: tuple[str, ...] | None = None
    strategy: str = "balanced"
    missing_threshold_low: float = 0.05
    missing_threshold_medium: float = 0.3
    missing_threshold_high: float = 0.6
    duplicate_threshold: float = 0.1
    outlier_action: str | None = "auto"
    preserve_original: bool = True
    verbose: bool = True
    preserve_columns: tuple[str, ...] = ()
    target_column: str | None = None
    id_columns: tuple[str, ...] = ()
    duplicate_keep: str = "first"
    allow_timeseries_duplicates: bool = False
    advanced_imputation: bool | str = "auto"
    missing_indicators: bool | str = "auto"
    impute: str | None = None
    outliers: str | None = None
    outlier_method: str = "iqr"
    outlier_factor: float | None = None
    optimize_memory: bool = False
    category_threshold: float = 0.5
    reset_index: bool = False
    sample_size: int = 10_000
    random_state: int = 0
    #: Spark options: the column that orders rows, the column of a time index,
    #: and the number of rows above which quantiles are approximate (1e-4 of rank).
    order_by: str | None = None
    time_index: str | None = None
    exact_quantile_rows: int = 2_000_000

    def __post_init__(self) -> None:
        for name in ("extra_sentinels", "preserve_columns", "id_columns", "duplicate_subset"):
            value = getattr(self, name)
            if isinstance(value, str):
                raise TypeError(f"{name} takes a list of strings, not one string")
            if value is not None:
                object.__setattr__(self, name, tuple(value))
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, got {getattr(self, name)!r}")
        low, medium, high = self.missing_threshold_low, self.missing_threshold_medium, self.missing_threshold_high
        if not 0 < low < medium < high < 1:
            raise ValueError("missing thresholds must lie in (0, 1) and rise from low to high")
        if not 0 <= self.duplicate_threshold <= 1:
            raise ValueError("duplicate_threshold must lie in [0, 1]")
        for name in ("numeric_threshold", "datetime_threshold", "category_threshold"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in (0, 1]")
        if self.outlier_factor is not None and self.outlier_factor <= 0:
            raise ValueError("outlier_factor must be positive")
        if len(self.decimal) != 1 or len(self.thousands) != 1 or self.decimal == self.thousands:
            raise ValueError("decimal and thousands must be two different single characters")
        if self.sample_size < 1:
            raise ValueError("sample_size must be positive")

    @property
    def mode(self) -> str | None:
        """The engine's mode, or None when it is off."""
        return {"conservative": None, "auto": "aggressive"}.get(self.strategy, self.strategy)

    @property
    def sentinels(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*SENTINELS, *(s.strip().casefold() for s in self.extra_sentinels))))

    def with_(self, **options) -> CleanConfig:
        return replace(self, **options)


def make_config(config: CleanConfig | None = None, **options) -> CleanConfig:
    """A config from keyword options; unknown names raise TypeError with a near match."""
    known = [f.name for f in fields(CleanConfig)]
    for name in options:
        if name not in known:
            near = difflib.get_close_matches(name, known, 1)
            raise TypeError(f"unknown option {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    return replace(config or CleanConfig(), **options)


@dataclass(frozen=True)
class EngineConfig:
    """Accepted for callers that choose an engine; Spark plans and spills by itself."""

    engine: str = "spark"
    output_format: str = "spark"
    memory_limit_gb: float | None = None

    def __post_init__(self) -> None:
        if self.engine not in ("spark", "auto", "pandas", "polars", "duckdb"):
            raise ValueError(f"unknown engine {self.engine!r}")
        if self.output_format not in ("spark", "pandas", "arrow"):
            raise ValueError(f"unknown output_format {self.output_format!r}")
