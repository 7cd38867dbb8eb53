"""A dirty table of any size from expressions of the row number, for benchmarks: no driver data, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING, SENTINEL = 0.15, 0.05
WORDS = ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta")


def dirty_table(spark: SparkSession, rows: int, *, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """id, 10 numbers, 5 categories, 2 e-mails, 2 texts, target; 15% null and 5% sentinels.

    Values depend on (row, column, seed) alone, so a lost task makes them again.
    """

    def unit(k: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003

    def spoiled(value: Column, k: int) -> Column:
        u = unit(k + 500)
        return F.when(u < MISSING, None).when(u < MISSING + SENTINEL, F.element_at(F.array(*map(F.lit, ("N/A", "-", "null", "?"))), (F.floor(unit(k + 900) * 4) + 1).cast("int"))).otherwise(value)

    pick = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), (F.floor(unit(k) * len(WORDS)) + 1).cast("int"))
    columns = [F.col("id")]
    columns += [F.when(unit(i + 500) >= MISSING, F.round(unit(i) * 1000, 3)).alias(f"num_{i}") for i in range(10)]
    columns += [spoiled(F.concat(F.when(unit(k + 300) < 0.1, "  ").otherwise(""), pick(k)), k).alias(f"cat_{k - 10}") for k in range(10, 15)]
    columns += [spoiled(F.concat(pick(k), F.lit("@example.com")), k).alias(f"email_{k - 20}") for k in (20, 21)]
    columns += [spoiled(F.concat_ws(" ", *(pick(k * 10 + j) for j in range(6))), k).alias(f"text_{k - 30}") for k in (30, 31)]
    columns += [(unit(40) < 0.3).cast("int").alias("target")]
    return spark.range(0, rows, 1, partitions).select(*columns)


def flatten(df: DataFrame) -> DataFrame:
    """One level of structs as columns named outer_inner."""
    out = []
    for f in df.schema:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)
