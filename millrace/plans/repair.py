"""Representation repair: plan from aggregates, then apply as one lazy projection.

Names, white space, sentinels, empty columns and rows, and text that holds
numbers, booleans or dates. One aggregate counts everything about the raw text,
a second one tests the conversions; both read only the string columns they need.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CleanConfig
from ..functions.text import is_sentinel, number, strip, unique_names
from ..report import CleanReport

RID = "_rid"
CHUNK = 60
TRUE, FALSE = ("true", "t", "yes", "y"), ("false", "f", "no", "n")
CURRENCY = "$€£₹"
#: Date formats tried in order; those that differ by day or month first stand apart.
ISO_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/M/d", "yyyy.M.d", "yyyy-M-d", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "d-MMM-yy", "MMM yyyy")
MONTH_FIRST = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M-d-yyyy", "M.d.yyyy", "M/d/yy")
DAY_FIRST = ("d/M/yyyy", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "d-M-yyyy", "d.M.yyyy", "d/M/yy")


#: What a letter run of a format stands for in a text.
FIELDS = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}"}
LONGEST_DATE = 40


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def shape_of(fmt: str) -> str:
    """The pattern of the texts that a date format may read, made from the format itself."""
    parts = re.finditer(r"'([^']*)'|([A-Za-z])\2*|.", fmt)
    return "".join(FIELDS[m[0]] if m[2] else re.escape(m[0] if m[1] is None else m[1]) for m in parts)


def date_shapes(day_first: bool | None = None) -> dict[str, list[str]]:
    """Formats by shape, in the order they are tried; ``day_first`` orders those that differ by day or month first."""
    either = (*DAY_FIRST, *MONTH_FIRST) if day_first else (*MONTH_FIRST, *DAY_FIRST)
    out: dict[str, list[str]] = {}
    for fmt in (*ISO_FORMATS, *either):
        out.setdefault(shape_of(fmt), []).append(fmt)
    return out


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != RID]


def data_columns(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n != RID]


def agg_row(df: DataFrame, measures: dict[str, Column]) -> dict:
    """Values of named aggregates, in jobs of CHUNK measures at most columns wide."""
    out: dict = {}
    items = list(measures.items())
    for i in range(0, len(items), CHUNK * 6):
        part = items[i : i + CHUNK * 6]
        row = df.agg(*(m.alias(f"m{j}") for j, (_, m) in enumerate(part))).first()
        out |= {name: row[j] for j, (name, _) in enumerate(part)}
    return out


def with_rid(df: DataFrame, config: CleanConfig) -> DataFrame:
    """A row id in the order of ``order_by``, or in the order of the scan."""
    if RID in df.columns:
        return df
    if config.order_by:
        return df.withColumn(RID, c(config.order_by))
    return df.withColumn(RID, F.monotonically_increasing_id())


def fold_nan(df: DataFrame) -> DataFrame:
    """NaN is missing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.when(~F.isnan(c(n)), c(n)) for n in floats}) if floats else df


def clean_names(df: DataFrame, config: CleanConfig, report: CleanReport) -> DataFrame:
    names = [n for n in df.columns if n != RID]
    if not config.column_names:
        if len(set(names)) < len(names):
            raise ValueError("duplicate column labels; leave column_names on to make them unique")
        return df
    new = unique_names(names)
    changed = [(a, b) for a, b in zip(names, new) if a != b]
    if not changed:
        return df
    shown = ", ".join(f"{a!r} -> {b!r}" for a, b in changed[:4]) + (", ..." if len(changed) > 4 else "")
    report.add("column_names", f"renamed {len(changed)} column(s): {shown}", count=len(changed))
    return df.toDF(*new, *([RID] if RID in df.columns else []))


def clean_text(df: DataFrame, config: CleanConfig, report: CleanReport) -> DataFrame:
    """Strip text and turn sentinels into nulls; one count job, one projection."""
    cols = text_columns(df)
    if not cols or not (config.strip_whitespace or config.normalize_sentinels):
        return df
    counts = agg_row(df, {(n, k): m for n in cols for k, m in (("strip", F.count_if(strip(c(n)) != c(n))), ("sentinel", F.count_if(is_sentinel(strip(c(n)), config.sentinels))))})
    change: dict[str, Column] = {}
    for n in cols:
        stripped, sentinel = counts[n, "strip"] or 0, counts[n, "sentinel"] or 0
        value = c(n)
        if config.strip_whitespace and stripped:
            report.add("strip_whitespace", f"stripped white space from {stripped} value(s)", column=n, count=stripped)
            value = strip(value)
        if config.normalize_sentinels and sentinel:
            report.add("normalize_sentinels", f"turned {sentinel} sentinel value(s) into nulls", column=n, count=sentinel)
            value = F.when(~is_sentinel(strip(c(n)), config.sentinels), value)
        if value is not None and (stripped or sentinel):
            change[n] = value
    return df.withColumns(change) if change else df


def drop_empty(df: DataFrame, config: CleanConfig, report: CleanReport) -> DataFrame:
    cols = data_columns(df)
    if not cols:
        return df
    counts = agg_row(df, {n: F.count(c(n)) for n in cols} | {"*rows": F.count(F.lit(1)), "*empty": F.count_if(_all_null(cols))})
    if not counts["*rows"]:
        return df
    if config.drop_empty_columns:
        gone = [n for n in cols if counts[n] == 0]
        if gone:
            for n in gone:
                report.add("drop_empty_columns", "dropped: every value is missing", column=n, count=1, outcome="dropped")
            df = df.drop(*(f"{n}" for n in gone))
            cols = [n for n in cols if n not in gone]
    if config.drop_empty_rows and counts["*empty"] and cols:
        report.add("drop_empty_rows", f"dropped {counts['*empty']} row(s) without any value", count=counts["*empty"])
        df = df.filter(~_all_null(cols))
    return df


def _all_null(cols: list[str]) -> Column:
    out = F.lit(True)
    for n in cols:
        out &= c(n).isNull()
    return out


def drop_constant(df: DataFrame, config: CleanConfig, report: CleanReport) -> DataFrame:
    """Columns with one value (null counts as one); lowest and highest tell, without a distinct count."""
    if not config.drop_constant_columns:
        return df
    cols = [f.name for f in df.schema if f.name != RID and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    stats = agg_row(df, {(n, k): m for n in cols for k, m in (("min", F.min(c(n))), ("max", F.max(c(n))), ("n", F.count(c(n))))} | {"*": F.count(F.lit(1))})
    if stats["*"] < 2:
        return df
    gone = [n for n in cols if stats[n, "n"] == 0 or (stats[n, "n"] == stats["*"] and stats[n, "min"] == stats[n, "max"])]
    for n in gone:
        report.add("drop_constant_columns", "dropped: one value in every row", column=n, count=1, outcome="dropped")
    return df.drop(*gone)


# -- text that holds other types ------------------------------------------


@dataclass
class Conversion:
    kind: str  # boolean, numeric, datetime
    value: Column
    coerced: int
    note: str = ""


def formatted_number(col: Column, config: CleanConfig) -> Column:
    """A number with currency signs and separators as plain text; other cells as they are."""
    t, d = (f"\\{x}" if not x.isalnum() else x for x in (config.thousands, config.decimal))
    form = rf"^\s*[+-]?\s*[{CURRENCY}]?\s*(\d{{1,3}}({t}\d{{3}})+|\d+)({d}\d+)?\s*[{CURRENCY}]?\s*$"
    plain = F.regexp_replace(col, rf"[{CURRENCY}\s{t}]", "")
    if config.decimal != ".":
        plain = F.regexp_replace(plain, d, ".")
    return F.when(col.rlike(form), plain).otherwise(col)


def parsed_date(col: Column, day_first: bool, seen: set[str] | None = None) -> Column:
    """The first format that reads a text; only formats of its shape are tried, of the shapes in ``seen``."""
    read = lambda formats: F.coalesce(*(F.try_to_timestamp(col, F.lit(f)).cast("timestamp_ntz") for f in formats))
    shapes = {s: formats for s, formats in date_shapes(day_first).items() if seen is None or s in seen}
    return F.coalesce(*(F.when(col.rlike(f"^{s}$"), read(formats)) for s, formats in shapes.items()))


def suggest(df: DataFrame, config: CleanConfig, cols: list[str] | None = None) -> dict[str, Conversion]:
    """The best conversion of each text column, boolean before number before date, by whole-column tests."""
    cols = text_columns(df) if cols is None else cols
    if not cols:
        return {}
    measures: dict = {}
    shapes = list(date_shapes())
    either = "|".join(dict.fromkeys(map(shape_of, MONTH_FIRST)))
    for n in cols:
        s, low = c(n), F.lower(c(n))
        dated = F.when((F.length(s) <= LONGEST_DATE) & s.rlike(f"^(?:{'|'.join(shapes)})$"), s)
        fields = F.split(F.when(dated.rlike(f"^(?:{either})$"), dated), "[^0-9]+")  # day and month, or month and day
        first, second = (F.get(fields, F.lit(i)).try_cast("int") for i in (0, 1))
        measures |= {
            (n, "n"): F.count(s),
            (n, "bool"): F.count_if(low.isin(*TRUE, *FALSE)),
            # spellings seen, over a vocabulary of bounded size
            (n, "spellings"): F.size(F.collect_set(F.when(low.isin(*TRUE, *FALSE), s))),
            (n, "plain"): F.count(number(s)),
            (n, "formatted"): F.count(number(formatted_number(s, config))),
            (n, "zero"): F.bool_or(s.rlike(r"^\s*[+-]?0\d")),
            (n, "dated"): F.count(dated),
            **{(n, shape): F.count_if(dated.rlike(f"^{shape}$")) for shape in shapes},
            (n, "short"): F.count_if(F.length(s) <= LONGEST_DATE),
            (n, "day"): F.count_if(first.between(13, 31)),
            (n, "month"): F.count_if(~F.coalesce(first.between(13, 31), F.lit(False)) & second.between(13, 31)),
        }
    m = agg_row(df, measures)
    out: dict[str, Conversion] = {}
    second_look: dict = {}
    for n in cols:
        total = m[n, "n"]
        if not total:
            continue
        if m[n, "bool"] == total and m[n, "spellings"] <= 8:
            out[n] = Conversion("boolean", F.when(F.lower(c(n)).isin(*TRUE), True).when(F.lower(c(n)).isin(*FALSE), False), 0)
        elif not (config.preserve_leading_zeros and m[n, "zero"]) and (best := max(m[n, "plain"], m[n, "formatted"])) / total >= config.numeric_threshold:
            plain = m[n, "plain"] / total >= config.numeric_threshold
            value = number(c(n)) if plain else number(formatted_number(c(n), config))
            second_look[n] = ("numeric", value, total - (m[n, "plain"] if plain else best))
        elif m[n, "short"] and m[n, "dated"] / m[n, "short"] >= 0.6:
            day_first = config.dayfirst if isinstance(config.dayfirst, bool) else m[n, "day"] > m[n, "month"]
            second_look[n] = ("datetime", parsed_date(c(n), day_first, {s for s in shapes if m[n, s]}), None)
    tests = {}
    for n, (kind, value, _) in second_look.items():
        tests[n] = F.count(value) if kind == "datetime" else F.bool_and((value == F.floor(value)) & (F.abs(value) < float(2**63 - 1024)))
    found = agg_row(df, tests) if tests else {}
    for n, (kind, value, coerced) in second_look.items():
        if kind == "numeric":
            out[n] = Conversion(kind, value.cast("long") if found[n] else value, coerced, "integer" if found[n] else "double")
        elif found[n] / m[n, "n"] >= config.datetime_threshold:
            out[n] = Conversion(kind, value, m[n, "n"] - found[n])
    return out


def fix_types(df: DataFrame, config: CleanConfig, report: CleanReport) -> DataFrame:
    dates = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
    if dates:
        df = df.withColumns({n: c(n).cast("timestamp_ntz") for n in dates})
    found = suggest(df, config)
    for n, conversion in found.items():
        note = f", {conversion.coerced} unparseable value(s) became null" if conversion.coerced else ""
        report.add("fix_dtypes", f"converted text to {conversion.kind}{note}", column=n, count=1, risk="medium" if conversion.coerced else "low")
    return df.withColumns({n: v.value for n, v in found.items()}) if found else df


@dataclass
class Repaired:
    frame: DataFrame
    report: CleanReport = field(default_factory=CleanReport)


def repair(df: DataFrame, config: CleanConfig, report: CleanReport) -> DataFrame:
    """Steps in their fixed order: names, text, empty columns and rows, types, constants."""
    df = clean_names(fold_nan(df), config, report)
    df = clean_text(df, config, report)
    if config.drop_empty_columns or config.drop_empty_rows:
        df = drop_empty(df, config, report)
    if config.fix_dtypes:
        df = fix_types(df, config, report)
    return drop_constant(df, config, report)
