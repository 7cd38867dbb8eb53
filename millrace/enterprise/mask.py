"""Masking rules: hash, redact, partial, regex scrub, drop; by name or by a pattern of names."""

from __future__ import annotations

import re
import secrets
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SCRUB, hmac_sha256, partial_mask, scrub
from ..plans.repair import agg_row, c

STRATEGIES = ("hash", "redact", "partial", "regex_scrub", "drop")


@dataclass(frozen=True)
class MaskingRule:
    name: str
    columns: tuple[str, ...] = ()
    pattern: str | None = None
    strategy: str = "hash"
    salt: str = ""
    hash_length: int = 16
    visible: int = 4
    placeholder: str = "***"
    scrub_patterns: tuple[str, ...] = ("email", "phone", "ssn", "credit_card")
    regexes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        unknown = set(self.scrub_patterns) - set(SCRUB)
        if unknown:
            raise ValueError(f"unknown scrub patterns {sorted(unknown)}")
        if not 4 <= self.hash_length <= 64:
            raise ValueError("hash_length must be 4 to 64")
        if not self.salt:  # without one, hashes can't be compared between runs
            object.__setattr__(self, "salt", secrets.token_hex(16))

    def targets(self, columns: list[str]) -> list[str]:
        return [n for n in columns if n in self.columns or (self.pattern and re.search(self.pattern, n, re.I))]


@dataclass
class MaskReport:
    masked: dict[str, int] = field(default_factory=dict)
    strategies: dict[str, str] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [*self.strategies]


def mask_dataframe(df: DataFrame, rules: tuple[MaskingRule, ...]) -> tuple[DataFrame, MaskReport]:
    """Rules in order; the counts are one aggregate, the masks one projection per rule."""
    report = MaskReport()
    for rule in rules:
        names = rule.targets(df.columns)
        if not names:
            continue
        if rule.strategy == "drop":
            df = df.drop(*names)
            report.dropped += names
            report.strategies |= dict.fromkeys(names, "drop")
            continue
        new = {}
        for n in names:
            s = c(n).cast("string")
            if rule.strategy == "hash":
                new[n] = hmac_sha256(c(n), rule.salt, rule.hash_length)
            elif rule.strategy == "redact":
                new[n] = F.when(c(n).isNotNull(), F.lit(rule.placeholder))
            elif rule.strategy == "partial":
                new[n] = partial_mask(c(n), rule.visible, rule.placeholder)
            else:
                new[n] = scrub(s, rule.scrub_patterns, rule.regexes, rule.placeholder)
        counts = agg_row(df, {n: F.count_if(~v.eqNullSafe(c(n).cast("string"))) for n, v in new.items()})
        for n in names:
            report.masked[n] = report.masked.get(n, 0) + counts[n]
            report.strategies[n] = rule.strategy
        df = df.withColumns(new)
    return df, report
