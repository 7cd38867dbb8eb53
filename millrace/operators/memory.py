"""Opt-in narrowing of numeric types; repeated text stays a string, as Parquet dictionaries do that work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CleanConfig
from ..plans.context import ID_NAME, kind_of
from ..plans.repair import RID, agg_row, c
from ..report import CleanReport

LADDER = ((T.ByteType(), 2**7), (T.ShortType(), 2**15), (T.IntegerType(), 2**31))


def optimize_memory(df: DataFrame, config: CleanConfig, report: CleanReport) -> DataFrame:
    """Integers to the narrowest type that holds them; doubles to float where each value survives. Ids stay."""
    if not config.optimize_memory:
        return df
    fields = {f.name: f.dataType for f in df.schema if f.name != RID and not ID_NAME.search(f.name) and f.name not in config.id_columns}
    ints = [n for n, t in fields.items() if kind_of(t) == "integer"]
    doubles = [n for n, t in fields.items() if isinstance(t, T.DoubleType)]
    m = agg_row(df, {(n, k): v for n in ints for k, v in (("lo", F.min(c(n))), ("hi", F.max(c(n))))} | {n: F.bool_and(c(n).cast("float").cast("double") == c(n)) for n in doubles})
    change = {}
    for n in ints:
        if m[n, "lo"] is None:
            continue
        for t, edge in LADDER:
            if -edge <= m[n, "lo"] and m[n, "hi"] < edge:
                if t.simpleString() != fields[n].simpleString() and kind_of(fields[n]) == "integer" and not isinstance(fields[n], tuple(type(x) for x, e in LADDER if e <= edge)):
                    change[n] = c(n).cast(t)
                    report.add("optimize_memory", f"narrowed {fields[n].simpleString()} to {t.simpleString()}", column=n, count=1)
                break
    for n in doubles:
        if m[n]:
            change[n] = c(n).cast("float")
            report.add("optimize_memory", "narrowed double to float", column=n, count=1)
    return df.withColumns(change) if change else df
