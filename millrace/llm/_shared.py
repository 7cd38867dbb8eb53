"""Helpers the training-data operators share: shared tables, sizing, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a side may be broadcast; counted before every broadcast.
BROADCAST_ROWS = 200_000
#: The same for tables that are read again and again: about 1 MB.
SMALL_ROWS = 50_000
#: Target MB of packed data that one reducing task holds.
BUCKET_MB, TASK_MB = 24, 64
#: Tasks over which the rows of a hot key are dealt. A key is hot if it has over
#: HOT_ROWS rows and over 1/HOT_SHARE of all rows: HOT_SHARE keys at most.
SALTS, HOT_ROWS, HOT_SHARE = 64, 1000, 10_000
_ROOTS: dict[str, str] = {}
#: By application, the paths of materialized tables and the threads that wrote them.
_WRITTEN: dict[str, dict[str, int]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the one that ``spark.checkpoint.dir`` names.

    Where it is unset, a local folder serves a local master, as in tests; on a
    cluster that is an error, as other hosts would not see such a folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all hosts of {master} see")
        base = _ROOTS.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="millrace-")
        _ROOTS[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, {})[path] = threading.get_ident()
    df.write.parquet(path)
    trim_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def trim_driver(spark: SparkSession) -> bool:
    """The driver's JVM gives freed native memory back, as workers do (``trimmed``); whether it could: not every JVM has the command.

    Planning and compiling hundreds of small jobs leaves holes of some 200 MB in the C heap, which the garbage collector never sees.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        of_interface = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()  # the server's own class is closed to reflection
        invoke = next(m for m in of_interface if m.getName() == "invoke")
        args = new(jvm.java.lang.Object, 4)  # bean, operation, and no parameters
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, args)
    except Py4JError:
        return False
    return True


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN[spark.sparkContext.applicationId].pop(path, None)


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing lazy reads any more."""
    for t in tables:
        path = getattr(t, "_millrace_path", None)
        if path in _WRITTEN.get(t.sparkSession.sparkContext.applicationId, ()):
            _delete(t.sparkSession, path)


def written(spark: SparkSession) -> set[str]:
    """Paths of the tables that this application has materialized and not deleted."""
    return set(_WRITTEN.get(spark.sparkContext.applicationId, ()))


def release_since(spark: SparkSession, before: set[str], *kept: DataFrame) -> None:
    """Delete the tables that this thread materialized since ``before`` was taken, but ``kept``."""
    keep, me = before | {getattr(t, "_millrace_path", None) for t in kept}, threading.get_ident()
    for path, by in list(_WRITTEN.get(spark.sparkContext.applicationId, {}).items()):
        if by == me and path not in keep:
            _delete(spark, path)


def sweep(spark: SparkSession, *kept: DataFrame) -> int:
    """Delete every table that this application materialized but ``kept``; for when the results that read them are written."""
    keep = {getattr(t, "_millrace_path", None) for t in kept}
    gone = [p for p in list(_WRITTEN.get(spark.sparkContext.applicationId, ())) if p not in keep]
    for path in gone:
        _delete(spark, path)
    return len(gone)


def unused_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], deal: Column, n: str, total: int) -> DataFrame:
    """``rows`` left join ``table`` (one row per key, of which ``n`` of ``total`` rows have it) with hot keys dealt over SALTS tasks by ``deal``.

    Rows with a null key match nothing and are dealt over all tasks.
    """
    is_hot = F.col(n) > max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(table.filter(is_hot).select(*keys, F.lit(SALTS).alias("_salts")))  # HOT_SHARE rows at most
    null = F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull()
    salts = F.when(null, F.lit(1 << 30)).otherwise(F.coalesce("_salts", F.lit(1)))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(deal), salts).cast("int")).drop("_salts")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0)))).drop(n)
    return dealt.join(copies, [*keys, "_salt"], "left").drop("_salt")


def input_mb(df: DataFrame, text: str = "text") -> float:
    """MB of a frame as the optimizer knows it; where it doesn't, half the bytes of the text (Parquet's usual share)."""
    size = float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1e16:  # a frame without statistics
        size = 0.5 * (df.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    return size / 1e6


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], deal: Column, n: str, total: int) -> DataFrame:
    """As ``spread_join``, but a table that was counted to have SMALL_ROWS at most is broadcast."""
    if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(table.drop(n)), keys, "left")
    return spread_join(rows, table, keys, deal, n, total)


def spread_out(df: DataFrame, mb: float, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` to tasks of about TASK_MB where ``mb`` needs more of them than the session's shuffle partitions; else as it is."""
    n = int(mb / TASK_MB)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint after a size check; without the hint Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def trimmed(run):
    """``run`` (over Arrow batches), after which the worker gives freed memory back: it lives on for other tasks."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; cleared when full, so its memory is bounded."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space of the UTF-8 text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
