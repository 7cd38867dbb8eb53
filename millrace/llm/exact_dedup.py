"""Exact dedup over an extendible-hash index kept in shared files.

Every text gets a 64-bit key. The keys of all texts are counted first; a
directory of key prefixes doubles until each bucket holds at most ``capacity``
of them (a bucket that one key alone overfills cannot be split). The directory
routes every row to the owner of its bucket, a task that holds whole key ranges:
it sorts its rows by key and text, so rows of one key form a chain in which
texts are told apart by comparing their bytes, and equal ones stand together.
What the owners find is written to shared files (``index``), from which all
results are read; lost executors cost a retry.

Only DataFrame functions run here. Keys that hold more than a 10,000th of all
rows are dealt over SALTS owners; their chains, one row per owner and distinct
text, are then merged by their texts again.

Defined results: a null text is an empty text; equal empty texts are copies of
one another; an empty table gives an empty result; further columns are carried
whatever their names; of rows that repeat one doc_id with the same text exactly
one is kept; doc_id may be null: it is kept only where all copies have none.
"""

from __future__ import annotations

import json
from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import HOT_ROWS, HOT_SHARE, SALTS, materialize, read_table, release

#: Keys that a bucket holds before it splits, and bits of the deepest directory (beyond it buckets grow).
CAPACITY, MAX_DEPTH = 256, 18
#: Bits of the number of buckets that full ones are about at most: buckets grow beyond CAPACITY rather than the directory beyond memory.
MOST_BUCKETS = 15


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """Buckets as (prefix, depth, entries): doubled from one slot until none is overfull.

    ``keys`` has ``key`` and ``n``. One job counts the slots of the deepest
    directory (2**max_depth at most, whatever the input); doubling then splits
    overfull buckets on those counts.
    """
    slot = F.shiftrightunsigned("key", 64 - max_depth)
    counts = {r[0]: r[1] for r in keys.groupBy(slot.alias("s")).agg(F.sum("n")).collect()}
    depth, buckets = 0, {0: sum(counts.values())}
    done: list[tuple[int, int, int]] = []
    while buckets:
        over = {p for p, n in buckets.items() if n > capacity and depth < max_depth}
        done += [(p, depth, n) for p, n in buckets.items() if p not in over]
        depth += 1
        split: dict[int, int] = {}
        for s, n in counts.items() if over else ():
            p = s >> (max_depth - depth)
            if p >> 1 in over:
                split[p] = split.get(p, 0) + n
        buckets = split
    return sorted(done, key=lambda b: b[0] << (max_depth - b[1]))


def _slots(spark: SparkSession, buckets: list[tuple[int, int, int]], max_depth: int) -> DataFrame:
    """The directory as a table, slot to bucket: 2**max_depth rows at most."""
    ranges = [{"b": b, "lo": p << (max_depth - d), "hi": ((p + 1) << (max_depth - d)) - 1} for b, (p, d, _) in enumerate(buckets)]
    rows = F.inline(F.from_json(F.lit(json.dumps(ranges)), "array<struct<b:int,lo:bigint,hi:bigint>>"))
    return spark.range(1).select(rows).select(F.explode(F.sequence("lo", "hi")).alias("slot"), F.col("b").alias("bucket"))


def owned(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, bool]:
    """Rows as their owners see them, and whether some keys are dealt over several owners.

    Columns: row (all columns of ``docs``), text, bucket, key, salt, hot, chain
    (place of the text among those of its key), n and top (rows and largest
    doc_id of the text with this owner), nth (place of the row among those).
    """
    spark = docs.sparkSession
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    keys = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "exact-keys")
    rows, distinct = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    capacity = max(capacity, distinct >> MOST_BUCKETS)
    depth = min(max_depth, max(1, ceil(log2(max(distinct, 1) / capacity)) + 2)) if distinct > capacity else 1
    slots = _slots(spark, directory(keys.select("key", F.lit(1).alias("n")), capacity, depth), depth)
    hot_keys = materialize(keys.filter(F.col("n") > max(HOT_ROWS, rows // HOT_SHARE)).select("key", F.lit(True).alias("hot")), "exact-hot")  # HOT_SHARE rows at most
    release(keys)
    routed = (
        docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        .withColumn("key", F.xxhash64(F.coalesce("row.text", F.lit(""))))
        .withColumn("slot", F.shiftrightunsigned("key", 64 - depth))
        .join(F.broadcast(slots), "slot")
        .join(F.broadcast(hot_keys), "key", "left")
        .select("row", "bucket", "key", F.when(F.col("hot"), F.pmod(F.xxhash64("row.doc_id"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"), F.coalesce("hot", F.lit(False)).alias("hot"))
    )
    chains = routed.repartition("bucket", "salt").withColumn("text", F.coalesce("row.text", F.lit("")))
    copies = Window.partitionBy("bucket", "salt", "key", "text")
    chain = Window.partitionBy("bucket", "salt", "key").orderBy("text")
    nth = F.row_number().over(copies.orderBy(F.col("row.doc_id").desc_nulls_last()))
    every = copies.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = chains.withColumn("nth", nth).withColumn("n", F.count(F.lit(1)).over(every)).withColumn("top", F.max("row.doc_id").over(every))
    return out.withColumn("chain", F.dense_rank().over(chain)), hot_keys.limit(1).count() > 0


def _merged(found: DataFrame, text: str) -> DataFrame:
    """For each (key, salt, chain) of a hot key, what all its owners hold of that text: HOT_SHARE * SALTS rows at most, but for collisions."""
    firsts = found.filter(F.col("hot") & (F.col("nth") == 1)).select("key", "salt", "chain", F.col(text).alias("_text"), "n", "top")
    whole = firsts.groupBy("key", "_text").agg(F.sum("n").alias("all_n"), F.max("top").alias("all_top"), F.collect_list(F.struct("salt", "chain")).alias("at"))  # SALTS places at most
    return whole.select("key", F.explode("at").alias("at"), "all_n", "all_top").select("key", "at.salt", "at.chain", "all_n", "all_top")


def index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index in shared files, one entry per row of ``docs``: bucket, key, chain, doc_id, text_sha256, group_size, keep_id, kept."""
    rows, several = owned(docs.select("doc_id", "text"), capacity, max_depth)
    shown = rows.select("bucket", "key", "salt", "chain", "hot", "nth", "n", "top", F.col("row.doc_id").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"), F.when(F.col("hot") & (F.col("nth") == 1), F.col("text")).alias("hot_text"))
    entries = materialize(shown, "exact-index")
    if several:
        entries = entries.join(F.broadcast(_merged(entries, "hot_text")), ["key", "salt", "chain"], "left")
        entries = entries.withColumns({"n": F.coalesce("all_n", "n"), "top": F.coalesce("all_top", "top")})
    kept = (F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("top"))
    return entries.select("bucket", "key", "chain", "doc_id", "text_sha256", F.col("n").alias("group_size"), F.col("top").alias("keep_id"), kept.alias("kept"))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    return index(docs, capacity, max_depth).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket", "chain")


def keep_one(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The documents that exact dedup keeps, with all their columns: the owners' first rows, moved once."""
    rows, several = owned(docs, capacity, max_depth)
    firsts = rows.filter("nth = 1")
    if several:
        firsts = materialize(firsts, "exact-firsts")
        firsts = firsts.join(F.broadcast(_merged(firsts, "text")), ["key", "salt", "chain"], "left").filter(~F.col("hot") | F.col("row.doc_id").eqNullSafe(F.col("all_top")))
    return firsts.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
