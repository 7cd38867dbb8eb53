"""Spellings of one value: keys, canonical choice, and the mapping applied by a join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint, ngram_key
from ..plans.repair import c

#: Mapping rows below which the mapping is broadcast.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class ClusterConfig:
    columns: tuple[str, ...] = ()
    method: str = "fingerprint"
    ngram_size: int = 2
    min_cluster_size: int = 2
    canonical: str = "most_frequent"

    def __post_init__(self) -> None:
        if self.method not in ("fingerprint", "ngram", "two_pass"):
            raise ValueError(f"unknown method {self.method!r}")
        if self.canonical not in ("most_frequent", "longest", "shortest", "first"):
            raise ValueError(f"unknown canonical policy {self.canonical!r}")
        if self.ngram_size < 1 or self.min_cluster_size < 2:
            raise ValueError("ngram_size must be 1 or more, min_cluster_size 2 or more")


def _canonical(policy: str):
    v, n = F.col("value"), F.col("n")
    if policy == "most_frequent":
        return F.max_by(v, F.struct(n, F.length(v), v))
    if policy == "longest":
        return F.max_by(v, F.struct(F.length(v), n, v))
    if policy == "shortest":
        return F.min_by(v, F.struct(F.length(v), -n, v))
    return F.min(v)


def clusters(df: DataFrame, column: str, config: ClusterConfig = ClusterConfig()) -> DataFrame:
    """key, canonical, variants (value, n), total of every group of two or more spellings."""
    counts = df.filter(c(column).isNotNull()).groupBy(c(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    key = ngram_key(F.col("value"), config.ngram_size) if config.method == "ngram" else fingerprint(F.col("value"))
    if config.method == "two_pass":
        key = ngram_key(fingerprint(F.col("value")), config.ngram_size)
    grouped = counts.withColumn("key", key).groupBy("key").agg(
        _canonical(config.canonical).alias("canonical"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("value")))).alias("v"), F.sum("n").alias("total")
    )
    variants = F.transform("v", lambda x: F.struct(x["value"].alias("value"), (-x["m"]).alias("n")))
    return grouped.filter(F.size("v") >= config.min_cluster_size).select("key", "canonical", variants.alias("variants"), "total")


def mapping(df: DataFrame, column: str, config: ClusterConfig = ClusterConfig()) -> DataFrame:
    """value, canonical of every spelling that would change."""
    rows = clusters(df, column, config).select("canonical", F.explode("variants.value").alias("value"))
    return rows.filter("value <> canonical").select("value", "canonical")


def merge_clusters(df: DataFrame, config: ClusterConfig) -> tuple[DataFrame, dict[str, int]]:
    """The table with canonical spellings, and the cells changed per column."""
    changed = {}
    for column in config.columns:
        table = mapping(df, column, config)
        if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            table = F.broadcast(table)
        joined = df.join(table, c(column).cast("string") == F.col("value"), "left")
        changed[column] = joined.filter("canonical is not null").count()
        df = joined.withColumn(column, F.coalesce("canonical", c(column))).select(*(c(n) for n in df.columns))
    return df, changed
