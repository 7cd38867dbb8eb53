"""Micro-batch cleaning with bounded state: batches, Structured Streaming, drift, rolling trust.

State per column is a handful of numbers: moments that merge exactly, a quantile
sketch (KLL, merged by Spark), the counts of at most ``max_categories`` values.
It lives on the driver and is written as JSON, so a restart goes on from it.
"""

from __future__ import annotations

import base64
import json
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..cleaner import run_pipeline, to_spark
from ..config import CleanConfig, make_config
from ..enterprise.trust import compute_trust_score
from ..operators.missing import filled
from ..plans.context import kind_of, role_of
from ..plans.repair import agg_row, c, data_columns
from ..report import CleanReport


@dataclass(frozen=True)
class StreamingCleanConfig:
    warmup_batches: int = 3
    max_categories: int = 256
    sketch_k: int = 200
    rolling_trust_window: int = 20
    fail_under_trust: float | None = None
    global_duplicates: bool = False
    window_size: int = 100_000
    drift_missing_jump: float = 0.25
    drift_cardinality_factor: float = 5.0
    drift_zscore: float = 4.0


class StreamingTrustError(RuntimeError):
    """A batch's trust is below ``fail_under_trust``."""


@dataclass
class Drift:
    kind: str
    column: str
    detail: str
    risk: str = "medium"


@dataclass
class ColumnState:
    kind: str
    role: str | None = None
    rows: int = 0
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    low: float | None = None
    high: float | None = None
    sketch: str | None = None
    counts: dict[str, int] = field(default_factory=dict)
    distinct: int = 0
    latest: str | None = None
    ordered: bool = True

    @property
    def std(self) -> float:
        return (self.m2 / (self.n - 1)) ** 0.5 if self.n > 1 else 0.0

    @property
    def missing_ratio(self) -> float:
        return 1 - self.n / self.rows if self.rows else 0.0

    def merge_moments(self, n: int, mean: float, m2: float) -> None:
        """Chan's exact merge of counts, means and squared deviations."""
        if not n:
            return
        total = self.n + n
        d = mean - self.mean
        self.mean += d * n / total
        self.m2 += m2 + d * d * self.n * n / total
        self.n = total

    def add_counts(self, new: dict[str, int], most: int) -> None:
        """Space-saving: a new value beyond ``most`` takes the place and count of the rarest."""
        for v, k in sorted(new.items(), key=lambda x: -x[1]):
            if v in self.counts or len(self.counts) < most:
                self.counts[v] = self.counts.get(v, 0) + k
            else:
                rare = min(self.counts, key=self.counts.__getitem__)
                self.counts[v] = self.counts.pop(rare) + k


class StreamingCleaner:
    """``clean_batch`` on any batch; ``clean_stream`` on a streaming frame by foreachBatch."""

    def __init__(self, config: CleanConfig | None = None, streaming: StreamingCleanConfig | None = None, **options) -> None:
        own = {k: options.pop(k) for k in list(options) if k in StreamingCleanConfig.__dataclass_fields__}
        self.streaming = streaming or StreamingCleanConfig(**own)
        base = make_config(config, **options)
        self.config = base.with_(strategy="conservative", drop_empty_columns=False, drop_constant_columns=False, impute=None, outliers=None)
        self.columns: dict[str, ColumnState] = {}
        self.batches = self.rows = 0
        self.scores: deque[float] = deque(maxlen=self.streaming.rolling_trust_window)
        self.weighted = 0.0
        self.reports: list[CleanReport] = []
        self.schema: dict[str, str] | None = None
        self.drift: list[Drift] = []
        self._seen: DataFrame | None = None

    # -- one batch

    def clean_batch(self, batch) -> tuple[DataFrame, CleanReport]:
        """Repair, drop repeats, test drift, learn, fill from what is known so far, score, gate."""
        df, report = run_pipeline(to_spark(batch), self.config)
        df = self._drop_seen(df, report)
        df = df.persist()
        stats = self._stats(df)
        found = self._drift(df, stats)
        self.drift += found
        for d in found:
            report.add("drift", f"{d.kind}: {d.detail}", column=d.column, risk=d.risk)
        self._observe(df, stats)
        warm = self.batches < self.streaming.warmup_batches
        out = self._defer(df, report) if warm else self._fill(df, report)
        self.batches += 1
        trust = compute_trust_score(out, config=self.config)
        self.rows += trust.n_rows
        self.weighted += trust.overall * trust.n_rows
        self.scores.append(trust.overall)
        report.streaming = {"batch": self.batches, "trust": trust.overall, "rolling_trust": sum(self.scores) / len(self.scores), "cumulative_trust": self.weighted / self.rows if self.rows else 100.0, "drift": bool(found), "warmup": warm}
        self.reports.append(report)
        edge = self.streaming.fail_under_trust
        if edge is not None and trust.overall < edge:
            raise StreamingTrustError(f"batch {self.batches}: trust {trust.overall:.1f} is below {edge}")
        return out, report

    def clean_batches(self, batches: Iterable) -> Iterator[tuple[DataFrame, CleanReport]]:
        for b in batches:
            yield self.clean_batch(b)

    def clean_stream(self, stream: DataFrame, output_path: str, checkpoint: str, *, format: str = "parquet", **trigger) -> StreamingQuery:
        """Cleaned micro-batches appended to ``output_path``; state is kept beside the checkpoint."""

        def run(batch: DataFrame, batch_id: int) -> None:
            if batch.limit(1).count():
                out, _ = self.clean_batch(batch)
                out.write.mode("append").format(format).save(output_path)

        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    # -- parts

    def _stats(self, df: DataFrame) -> dict:
        measures: dict = {"*": F.count(F.lit(1))}
        for n in data_columns(df):
            kind = kind_of(df.schema[n].dataType)
            measures[n, "n"] = F.count(c(n))
            if kind in ("integer", "double"):
                x = c(n).cast("double")
                measures |= {(n, "mean"): F.avg(x), (n, "var"): F.var_pop(x), (n, "lo"): F.min(x), (n, "hi"): F.max(x), (n, "sketch"): F.kll_sketch_agg_double(x, self.streaming.sketch_k)}
            elif kind == "datetime":
                measures |= {(n, "first"): F.min(c(n)).cast("string"), (n, "last"): F.max(c(n)).cast("string")}
            elif kind == "string":
                measures |= {(n, "length"): F.avg(F.length(c(n))), (n, "words"): F.avg(F.size(F.split(c(n), " ")))}
            if kind != "nested":
                measures[n, "distinct"] = F.approx_count_distinct(c(n))
        return agg_row(df, measures)

    def _drift(self, df: DataFrame, m: dict) -> list[Drift]:
        now = {n: kind_of(df.schema[n].dataType) for n in data_columns(df)}
        if self.schema is None:
            self.schema = now
            return []
        out = [Drift("new_column", n, "not in the first batch") for n in now if n not in self.schema]
        out += [Drift("missing_column", n, "absent from this batch") for n in self.schema if n not in now]
        for n, kind in now.items():
            old = self.columns.get(n)
            if old is None or n not in self.schema or not m["*"]:
                continue
            if kind != self.schema[n]:
                out.append(Drift("dtype", n, f"{self.schema[n]} became {kind}"))
                continue
            gap = 1 - m[n, "n"] / m["*"] - old.missing_ratio
            if gap > self.streaming.drift_missing_jump:
                out.append(Drift("missing_rate", n, f"rose by {gap:.2f}"))
            distinct = m.get((n, "distinct"), 0)
            if kind == "string" and distinct > 20 and distinct > self.streaming.drift_cardinality_factor * max(1, old.distinct):
                out.append(Drift("cardinality", n, f"{distinct} values"))
            if kind in ("integer", "double") and old.std and m[n, "mean"] is not None and abs(m[n, "mean"] - old.mean) > self.streaming.drift_zscore * old.std:
                out.append(Drift("mean_shift", n, f"{old.mean:g} to {m[n, 'mean']:g}", "high"))
        return out

    def _observe(self, df: DataFrame, m: dict) -> None:
        texts = []
        for n in data_columns(df):
            kind = kind_of(df.schema[n].dataType)
            s = self.columns.setdefault(n, ColumnState(kind))
            s.rows += m["*"]
            if s.role is None and m[n, "n"]:
                s.role = role_of(n, kind, self.config, m[n, "n"], m.get((n, "distinct")), m.get((n, "length")), m.get((n, "words")))
            if kind in ("integer", "double"):
                if m[n, "n"]:
                    s.merge_moments(m[n, "n"], m[n, "mean"], m[n, "var"] * m[n, "n"])
                    s.low = min(x for x in (s.low, m[n, "lo"]) if x is not None)
                    s.high = max(x for x in (s.high, m[n, "hi"]) if x is not None)
                    s.sketch = self._merged(df, s.sketch, m[n, "sketch"])
                continue
            s.n += m[n, "n"]
            if kind == "datetime" and m[n, "first"]:
                s.ordered &= s.latest is None or m[n, "first"] >= s.latest
                s.latest = max(x for x in (s.latest, m[n, "last"]) if x)
            if kind in ("string", "boolean") and s.role not in ("text", "id"):
                texts.append(n)
            s.distinct = max(s.distinct, m.get((n, "distinct")) or 0)
        for n in texts:
            top = df.filter(c(n).isNotNull()).groupBy(c(n).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(self.streaming.max_categories).collect()
            self.columns[n].add_counts({r["v"]: r["count"] for r in top}, self.streaming.max_categories)

    def _merged(self, df: DataFrame, old: str | None, new: bytes) -> str:
        new = bytes(new)
        if old is None:
            return base64.b64encode(new).decode()
        both = df.sparkSession.range(1).select(F.explode(F.array(F.lit(bytearray(new)), F.lit(bytearray(base64.b64decode(old))))).alias("s"))
        return base64.b64encode(bytes(both.agg(F.kll_merge_agg_double("s", self.streaming.sketch_k)).first()[0])).decode()

    def quantiles(self, df: DataFrame, column: str, ps: list[float]) -> list[float]:
        sketch = F.lit(bytearray(base64.b64decode(self.columns[column].sketch)))
        return list(df.sparkSession.range(1).select(*(F.kll_sketch_get_quantile_double(sketch, F.lit(p)) for p in ps)).first())

    def _defer(self, df: DataFrame, report: CleanReport) -> DataFrame:
        for n, gap in self._gaps(df).items():
            if gap:
                report.add("missing", f"deferred {gap} missing value(s): warming up", column=n, rationale="too few batches seen")
        return df

    def _gaps(self, df: DataFrame) -> dict[str, int]:
        return agg_row(df, {n: F.count_if(c(n).isNull()) for n in data_columns(df)})

    def _fill(self, df: DataFrame, report: CleanReport) -> DataFrame:
        change = {}
        for n, gap in self._gaps(df).items():
            s = self.columns[n]
            if not gap:
                continue
            value, how = None, ""
            if s.role == "numeric" and s.sketch:
                q1, q2, q3 = self.quantiles(df, n, [0.25, 0.5, 0.75])
                skew = abs(3 * (s.mean - q2) / s.std) if s.std else 0.0
                tails = s.low < q1 - 1.5 * (q3 - q1) or s.high > q3 + 1.5 * (q3 - q1)
                value, how = (float(s.mean), "mean") if skew < 0.5 and not tails else (float(q2), "median")
            elif s.role in ("categorical", "boolean") and s.counts:
                top = min(s.counts, key=lambda v: (-s.counts[v], v))
                if s.counts[top] / max(1, s.n) >= 0.5 or s.role == "boolean":
                    value, how = (top == "true" if s.role == "boolean" else top), "mode"
                else:
                    value, how = "Unknown", "sentinel"
            if value is None:
                report.add("missing", f"preserved {gap} missing value(s)", column=n, rationale=f"{s.role} column")
                continue
            change[n] = filled(df, n, value)
            report.add("missing", f"filled {gap} missing value(s) with {how} {value!r}", column=n, count=gap, confidence=0.8, model_id=how, outcome="imputed")
        return df.withColumns(change) if change else df

    def _drop_seen(self, df: DataFrame, report: CleanReport) -> DataFrame:
        """Rows of earlier batches go, for the first ``window_size`` distinct rows; opt-in."""
        if not self.streaming.global_duplicates:
            return df
        cols = data_columns(df)
        keyed = df.withColumn("_h", F.xxhash64(*(c(n) for n in cols)))
        fresh = keyed
        if self._seen is not None:
            fresh = keyed.join(F.broadcast(self._seen), "_h", "left_anti")  # window_size rows at most
            gone = keyed.count() - fresh.count()
            if gone:
                report.add("duplicates", f"dropped {gone} row(s) seen in earlier batches", count=gone)
        room = self.streaming.window_size - (self._seen.count() if self._seen is not None else 0)
        if room > 0:
            new = [(r[0],) for r in fresh.select("_h").distinct().limit(room).collect()]
            add = df.sparkSession.createDataFrame(new, "_h long") if new else None
            self._seen = add if self._seen is None else self._seen.union(add) if add is not None else self._seen
        return fresh.drop("_h")

    # -- state

    def state(self) -> dict:
        return {"batches": self.batches, "rows": self.rows, "weighted": self.weighted, "scores": list(self.scores), "schema": self.schema, "columns": {n: vars(s) for n, s in self.columns.items()}}

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.state(), f)

    def load(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            s = json.load(f)
        self.batches, self.rows, self.weighted, self.schema = s["batches"], s["rows"], s["weighted"], s["schema"]
        self.scores.extend(s["scores"])
        self.columns = {n: ColumnState(**v) for n, v in s["columns"].items()}

    def finalize(self) -> dict:
        return {"batches": self.batches, "rows": self.rows, "cumulative_trust": self.weighted / self.rows if self.rows else 100.0, "rolling_trust": sum(self.scores) / len(self.scores) if self.scores else 100.0, "drift": [vars(d) for d in self.drift], "roles": {n: s.role for n, s in self.columns.items()}, "actions": sum(len(r) for r in self.reports)}


def kafka_json(spark, servers: str, topic: str, schema: str, *, batch_size: int = 10_000, **options) -> DataFrame:
    """A streaming frame of JSON values from Kafka; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": batch_size}, **options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("x")).select("x.*")


def file_stream(spark, path: str, schema, *, format: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)


