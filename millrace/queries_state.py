"""Queries over streams, reports, sources and gates, with their SQL: what an engine remembers, writes or decides."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .cleaner import Cleaner, run_pipeline
from .config import CleanConfig
from .enterprise.compliance import ComplianceConfig, frame_hash, generate_compliance_report
from .enterprise.interface import EnterpriseConfig, clean_enterprise
from .enterprise.lineage import LineageTracker
from .enterprise.mask import MaskingRule
from .enterprise.semantic import SemanticValidatorConfig, run_semantic_validation
from .enterprise.trust import compute_trust_score
from .functions import text as X
from .integrations import evaluate_trust_gate, gate_manifest, gate_table
from .plans.context import build_contexts, informative, is_ordered
from .plans.repair import with_rid
from .queries import cleaned, tables
from .sources.files import read_table, write_table
from .sources.scratch import scratch_folder
from .streaming.cleaner import StreamingCleaner, file_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str):
    def put(fn):
        QUERIES[name], ORACLES[name] = fn, oracle
        return fn

    return put


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


# -- streams: events in four batches by event_id ------------------------------

_EVENTS = "SELECT event_id, event_type, value, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS gappy, CASE WHEN event_id % 20 = 0 THEN NULL ELSE 'web' END AS channel, event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS batch FROM events"


def batches(spark: SparkSession, d: str) -> list[DataFrame]:
    tables(spark, d, "events")
    df = spark.sql(_EVENTS.replace("//", "div"))
    return [df.filter(f"batch = {i}").drop("batch") for i in range(4)]


_STREAMED: dict[tuple[str, str], tuple[StreamingCleaner, list]] = {}


def streamed(spark: SparkSession, d: str) -> tuple[StreamingCleaner, list]:
    """All four batches cleaned, once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STREAMED:
        s = StreamingCleaner(drop_duplicates=False)
        _STREAMED[key] = s, list(s.clean_batches(batches(spark, d)))
    return _STREAMED[key]


@query("stream_moments", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 5) AS std, min(value) AS low, max(value) AS high FROM events")
def _(spark, d):
    x = streamed(spark, d)[0].columns["value"]
    return rows(spark, "n long, mean double, std double, low double, high double", (x.n, round(x.mean, 6), round(x.std, 5), x.low, x.high))


@query("stream_top_values", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return rows(spark, "value string, n long", *streamed(spark, d)[0].columns["event_type"].counts.items())


@query("stream_missing_ratio", "SELECT round(1 - count(CASE WHEN event_id % 10 <> 0 THEN value END) * 1.0 / count(*), 6)::DOUBLE AS ratio, count(*) AS rows_seen FROM events")
def _(spark, d):
    x = streamed(spark, d)[0].columns["gappy"]
    return rows(spark, "ratio double, rows_seen long", (round(x.missing_ratio, 6), x.rows))


@query("stream_warmup_defers", f"SELECT batch + 1 AS batch, batch < 3 AS warmup, CASE WHEN batch < 3 THEN count(*) - count(channel) ELSE 0 END AS gaps FROM ({_EVENTS}) GROUP BY batch")
def _(spark, d):
    done = streamed(spark, d)[1]
    return rows(spark, "batch long, warmup boolean, gaps long", *((r.streaming["batch"], r.streaming["warmup"], out.filter("channel is null").count()) for out, r in done))


@query("stream_fills_mode", f"SELECT event_id, coalesce(channel, 'web') AS channel FROM ({_EVENTS}) WHERE batch = 3")
def _(spark, d):
    return streamed(spark, d)[1][3][0].select("event_id", "channel")


@query("stream_trust", f"""
WITH b AS (SELECT batch, count(*) AS n, (count(event_id) + count(event_type) + count(value) + count(CASE WHEN batch = 3 THEN value ELSE gappy END) + count(CASE WHEN batch = 3 THEN 'web' ELSE channel END)) * 100.0 / (5 * count(*)) AS completeness FROM ({_EVENTS}) GROUP BY batch)
SELECT count(*) AS batches, sum(n)::BIGINT AS rows_seen, round(sum(n * completeness) / sum(n), 4)::DOUBLE AS cumulative, round(avg(completeness), 4)::DOUBLE AS rolling FROM b
""")
def _(spark, d):
    s, done = streamed(spark, d)
    score = [compute_trust_score(out).completeness for out, _ in done]
    n = [out.count() for out, _ in done]
    last = done[-1][1].streaming
    assert last["batch"] == len(score) and s.rows == sum(n)
    return rows(spark, "batches long, rows_seen long, cumulative double, rolling double", (s.batches, s.rows, round(sum(a * b for a, b in zip(n, score)) / sum(n), 4), round(sum(score) / len(score), 4)))


@query("stream_global_duplicates", "SELECT DISTINCT event_type, event_id % 7 AS k FROM events")
def _(spark, d):
    s = StreamingCleaner(global_duplicates=True, drop_duplicates=True)
    parts = [out for out, _ in s.clean_batches([b.selectExpr("event_type", "event_id % 7 as k") for b in batches(spark, d)])]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("stream_new_column_drift", "SELECT 'new_column' AS kind, 'extra' AS column_name UNION ALL SELECT 'missing_column', 'value' UNION ALL SELECT 'dtype', 'event_type'")
def _(spark, d):
    a, b, *_ = batches(spark, d)
    s = StreamingCleaner(drop_duplicates=False)
    s.clean_batch(a.select("event_id", "event_type", "value"))
    s.clean_batch(b.selectExpr("event_id", "event_id + 1 as event_type", "1 as extra"))
    return rows(spark, "kind string, column_name string", *((x.kind, x.column) for x in s.drift))


@query("stream_value_drift", "SELECT 'mean_shift' AS kind, 'value' AS column_name UNION ALL SELECT 'missing_rate', 'channel'")
def _(spark, d):
    a, b, *_ = batches(spark, d)
    s = StreamingCleaner(drop_duplicates=False)
    s.clean_batch(a.select("event_id", "value", "channel"))
    s.clean_batch(b.selectExpr("event_id", "value + 1e6 as value", "case when event_id % 2 = 0 then channel end as channel"))
    return rows(spark, "kind string, column_name string", *((x.kind, x.column) for x in s.drift))


@query("stream_state_restart", "SELECT count(value) AS n, round(avg(value), 6) AS mean, 4 AS batches FROM events")
def _(spark, d):
    parts = batches(spark, d)
    with tempfile.TemporaryDirectory() as folder:
        a = StreamingCleaner(drop_duplicates=False)
        list(a.clean_batches(parts[:2]))
        a.save(f"{folder}/state.json")
        b = StreamingCleaner(drop_duplicates=False)
        b.load(f"{folder}/state.json")
    list(b.clean_batches(parts[2:]))
    x = b.columns["value"]
    return rows(spark, "n long, mean double, batches int", (x.n, round(x.mean, 6), b.batches))


@query("stream_files", "SELECT event_id, trim(event_type) AS event_type FROM events")
def _(spark, d):
    folder = scratch_folder(spark, "stream")
    src = batches(spark, d)
    for b in src:
        b.selectExpr("event_id", "concat('  ', event_type, ' ') as event_type").write.mode("append").parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    s = StreamingCleaner(drop_duplicates=False)
    s.clean_stream(file_stream(spark, f"{folder}/in", schema), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_gate", "SELECT true AS stopped, 1 AS batches")
def _(spark, d):
    from .streaming.cleaner import StreamingTrustError

    s = StreamingCleaner(drop_duplicates=False, fail_under_trust=101.0)
    try:
        s.clean_batch(batches(spark, d)[0])
        stopped = False
    except StreamingTrustError:
        stopped = True
    return rows(spark, "stopped boolean, batches int", (stopped, s.batches))


@query("stream_finalize", "SELECT 4 AS batches, count(*) AS rows_seen, 'categorical' AS event_type_role, 'numeric' AS value_role FROM events")
def _(spark, d):
    out = streamed(spark, d)[0].finalize()
    return rows(spark, "batches int, rows_seen long, event_type_role string, value_role string", (out["batches"], out["rows"], out["roles"]["event_type"], out["roles"]["value"]))


# -- sources and sinks ---------------------------------------------------------


def _round_trip(kind: str, suffix: str):
    def run(spark, d):
        tables(spark, d, "orders")
        path = f"{scratch_folder(spark, 'file')}/orders{suffix}"
        write_table(spark.sql("SELECT o_orderkey AS k, o_orderstatus AS status, o_custkey AS cust FROM orders"), path)
        return read_table(spark, path).selectExpr("cast(k as bigint) as k", "status", "cast(cust as bigint) as cust")

    query(f"source_{kind}", "SELECT o_orderkey AS k, o_orderstatus AS status, o_custkey AS cust FROM orders")(run)


for _kind, _suffix in (("parquet", ".parquet"), ("csv", ".csv"), ("tsv", ".tsv"), ("json_lines", ".jsonl"), ("orc", ".orc")):
    _round_trip(_kind, _suffix)


@query("source_arrow", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def _(spark, d):
    import pyarrow.feather as feather

    tables(spark, d, "nation")
    path = f"{tempfile.mkdtemp(prefix='millrace-file-')}/nation.arrow"
    feather.write_feather(spark.sql("SELECT n_nationkey AS k, n_name AS name FROM nation").toArrow(), path, compression="uncompressed")
    return read_table(spark, path)


@query("source_pandas", "SELECT n_nationkey AS key, n_name AS name FROM nation")
def _(spark, d):
    tables(spark, d, "nation")
    return api.clean(spark.sql("SELECT n_nationkey AS `Key`, concat(' ', n_name) AS ` Name` FROM nation").toPandas(), strategy="conservative")


@query("source_path", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return api.clean(f"{d}/region.parquet", strategy="conservative")


@query("clean_csv", "SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, d):
    tables(spark, d, "nation")
    path = f"{scratch_folder(spark, 'file')}/in.csv"
    spark.sql("SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey % 2 = 0").coalesce(1).write.option("header", True).csv(path)
    return api.clean_csv(path, spark=spark, strategy="conservative").selectExpr("cast(key as int) as key", "name")


@query("cli_clean", "SELECT r_regionkey AS r_regionkey, r_name AS r_name FROM region")
def _(spark, d):
    import contextlib
    import io

    from .cli import main

    out = f"{scratch_folder(spark, 'cli')}/out.parquet"
    with contextlib.redirect_stdout(io.StringIO()):
        assert main(["clean", f"{d}/region.parquet", out, "--strategy", "conservative"]) == 0
    return spark.read.parquet(out)


@query("cleaner_object", "SELECT c_custkey, c_mktsegment FROM customer")
def _(spark, d):
    tables(spark, d, "customer")
    cleaner = Cleaner(strategy="conservative", fix_dtypes=False)
    return cleaner.clean(spark.sql("SELECT c_custkey, concat(c_mktsegment, '  ') AS c_mktsegment FROM customer"))


# -- types, dates, memory ------------------------------------------------------


@query("types_found", "SELECT 'bigint' AS whole, 'double' AS fraction, 'boolean' AS flag, 'timestamp_ntz' AS day, 'string' AS code, count(*) AS n FROM orders")
def _(spark, d):
    tables(spark, d, "orders")
    df = spark.sql("SELECT cast(o_custkey AS string) AS whole, concat(o_custkey, '.25') AS fraction, CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'n' END AS flag, date_format(o_orderdate, 'd MMM yyyy') AS day, concat('00', o_custkey) AS code FROM orders")
    out = cleaned(df, fix_dtypes=True)
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    return rows(spark, "whole string, fraction string, flag string, day string, code string, n long", (*(kinds[k] for k in ("whole", "fraction", "flag", "day", "code")), out.filter("whole is not null and fraction is not null and flag is not null and day is not null").count()))


def _dates(name: str, fmt: str, **options):
    def run(spark, d):
        tables(spark, d, "orders")
        out = cleaned(spark.sql(f"SELECT o_orderkey AS k, date_format(o_orderdate, \"{fmt}\") AS day FROM orders"), fix_dtypes=True, **options)
        return out.select("k", F.date_format("day", "yyyy-MM-dd").alias("day"))

    query(name, "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")(run)


for _name, _fmt, _opts in (
    ("dates_iso", "yyyy-MM-dd", {}), ("dates_iso_time", "yyyy-MM-dd'T'HH:mm:ss", {}), ("dates_slashes", "yyyy/M/d", {}), ("dates_long_month", "MMMM d, yyyy", {}), ("dates_short_month", "d-MMM-yyyy", {}),
    ("dates_day_first", "d/M/yyyy", {}), ("dates_day_first_dots", "d.M.yyyy", {"dayfirst": True}), ("dates_month_first_time", "M/d/yyyy H:mm", {"dayfirst": False}),
):
    _dates(_name, _fmt, **_opts)


@query("dates_partly_unreadable", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def _(spark, d):
    tables(spark, d, "orders")
    out = cleaned(spark.sql("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN 'some day' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS day FROM orders"), fix_dtypes=True, datetime_threshold=0.9)
    return out.select("k", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("memory_types", "SELECT 'tinyint' AS small, 'smallint' AS middle, 'float' AS exact, 'double' AS fine, sum(l_linenumber)::BIGINT AS total FROM lineitem")
def _(spark, d):
    tables(spark, d, "lineitem")
    out = cleaned(spark.sql("SELECT cast(l_linenumber AS bigint) AS small, cast(l_linenumber * 1000 AS bigint) AS middle, cast(l_linenumber AS double) / 2 AS exact, cast(l_linenumber AS double) / 3 AS fine FROM lineitem"), optimize_memory=True)
    kinds = [out.schema[k].dataType.simpleString() for k in ("small", "middle", "exact", "fine")]
    return rows(spark, "small string, middle string, exact string, fine string, total long", (*kinds, out.agg(F.sum("small")).first()[0]))


# -- facts about columns -------------------------------------------------------


@query("distinct_counts", "SELECT count(DISTINCT o_custkey) AS cust, count(DISTINCT o_orderpriority) AS priority, count(DISTINCT o_orderkey) AS orders FROM orders")
def _(spark, d):
    tables(spark, d, "orders")
    x = build_contexts(with_rid(spark.sql("SELECT o_custkey AS cust, o_orderpriority AS priority, o_orderkey AS orders FROM orders"), CleanConfig()), CleanConfig())
    return rows(spark, "cust long, priority long, orders long", tuple(x[k].nunique for k in ("cust", "priority", "orders")))


@query("time_order", "SELECT true AS rising, false AS falling")
def _(spark, d):
    tables(spark, d, "events")
    df = with_rid(spark.sql("SELECT event_id, ts, ts + make_interval(0, 0, 0, cast(-2 * event_id AS int)) AS back FROM events"), CleanConfig(order_by="event_id"))
    return rows(spark, "rising boolean, falling boolean", (is_ordered(df, "ts"), is_ordered(df, "back")))


@query("informative_gaps", "SELECT 'tells' AS column_name")
def _(spark, d):
    tables(spark, d, "orders")
    df = with_rid(spark.sql("SELECT o_custkey AS probe, CASE WHEN o_custkey > 1000 THEN NULL ELSE 'x' END AS tells, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'y' END AS random FROM orders"), CleanConfig())
    x = build_contexts(df, CleanConfig())
    return rows(spark, "column_name string", *((n,) for n in informative(df, ["tells", "random"], x)))


@query("explain_rows", "SELECT count(*) AS rows_before, count(DISTINCT o_custkey) AS rows_after FROM orders")
def _(spark, d):
    tables(spark, d, "orders")
    e = api.explain_clean(spark.sql("SELECT o_custkey AS k FROM orders"), strategy="conservative")
    return rows(spark, "rows_before long, rows_after long", (e.report.rows_before, e.report.rows_after))


@query("report_actions", "SELECT 'strip_whitespace' AS step, 'status' AS column_name, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS n FROM orders UNION ALL SELECT 'normalize_sentinels', 'status', count(*) FILTER (WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0) FROM orders")
def _(spark, d):
    from .queries import OFF, dirty

    report = run_pipeline(dirty(spark, d).select("order_key", "status"), CleanConfig(**OFF | {"strip_whitespace": True, "normalize_sentinels": True}))[1]
    return report.to_frame(spark).select("step", F.col("column").alias("column_name"), F.col("count").alias("n"))


@query("timeseries_duplicates_stay", "SELECT o_custkey % 5 AS k, o_orderstatus AS s FROM orders")
def _(spark, d):
    tables(spark, d, "orders")
    return cleaned(spark.sql("SELECT o_custkey % 5 AS k, o_orderstatus AS s FROM orders"), drop_duplicates=True, time_index="k")


# -- masks, validity, text -----------------------------------------------------

_PAD = {k: "".join(f"\\x{b ^ v:02X}" for b in b"fixed".ljust(64, b"\0")) for k, v in (("inner", 0x36), ("outer", 0x5C))}


@query("mask_hmac", f"SELECT c_custkey, substr(sha256('{_PAD['outer']}'::BLOB || unhex(sha256('{_PAD['inner']}'::BLOB || encode(c_name)))), 1, 16) AS c_name FROM customer")
def _(spark, d):
    tables(spark, d, "customer")
    return spark.table("customer").select("c_custkey", X.hmac_sha256(F.col("c_name"), "fixed").alias("c_name"))


@query("ngram_keys", "WITH s AS (SELECT n_nationkey AS k, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS s FROM nation) SELECT k, array_to_string(list_sort(list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i::INTEGER, 2)))), '') AS key FROM s")
def _(spark, d):
    tables(spark, d, "nation")
    return spark.table("nation").select(F.col("n_nationkey").alias("k"), X.ngram_key(F.col("n_name")).alias("key"))


@query("semantic_pattern", "SELECT count(*) AS checked, count(*) FILTER (WHERE NOT regexp_full_match(c_name, 'Customer#0*[0-9]{1,3}')) AS invalid FROM customer")
def _(spark, d):
    tables(spark, d, "customer")
    v = run_semantic_validation(spark.table("customer"), (SemanticValidatorConfig("name", kind="regex", columns=("c_name",), regex=r"Customer#0*[0-9]{1,3}", case_sensitive=True),))["c_name"]
    return rows(spark, "checked long, invalid long", (v.checked, v.invalid))


@query("partial_dates", "SELECT o_orderkey AS k, o_orderkey % 4 < 2 AS partial FROM orders")
def _(spark, d):
    tables(spark, d, "orders")
    df = spark.sql("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '2020' WHEN 1 THEN '2020-07' WHEN 2 THEN '2020-13' ELSE '2020-07-01' END AS s FROM orders")
    return df.select("k", X.partial_date(F.col("s")).alias("partial"))


@query("iso_dates", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '2024-02-29' END AS day FROM orders")
def _(spark, d):
    tables(spark, d, "orders")
    df = spark.sql("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '2023-02-29' ELSE '1/2/2023' END AS s FROM orders")
    return df.select("k", X.iso_date(F.col("s")).cast("string").alias("day"))


# -- compliance, lineage, gates ------------------------------------------------


def _reported(spark, d, **options):
    from .queries import OFF, dirty

    out, report = run_pipeline(dirty(spark, d).select("order_key", "status", "priority"), CleanConfig(**OFF | {"strip_whitespace": True, "normalize_sentinels": True, "drop_duplicates": True}))
    return out, generate_compliance_report(report, ["patient_name", "email", "order_key"], config=ComplianceConfig(**options))


@query("compliance_audit_trail", "SELECT 'MODIFY' AS action, 'strip_whitespace' AS kind, 'normalized' AS basis, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS n FROM orders UNION ALL SELECT 'MODIFY', 'sentinel_normalize', 'normalized', count(*) FILTER (WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0) FROM orders")
def _(spark, d):
    records = _reported(spark, d)[1].reports["21cfr11"].records
    return rows(spark, "action string, kind string, basis string, n long", *((r["action"], r["kind"], r["basis"], r["count"]) for r in records))


@query("compliance_processing_record", "SELECT 'controller' AS entry, false AS ok UNION ALL SELECT 'contact', true UNION ALL SELECT 'purpose', true UNION ALL SELECT 'legal basis', true UNION ALL SELECT 'retention', true UNION ALL SELECT 'data subjects', true")
def _(spark, d):
    checks = _reported(spark, d, controller_contact="x@y.z", data_subject_categories=("customers",))[1].reports["gdpr"].checks
    return rows(spark, "entry string, ok boolean", *((k["name"].removeprefix("Article 30: "), k["ok"]) for k in checks))


@query("compliance_alcoa", "SELECT 'Attributable' AS entry, true AS ok UNION ALL SELECT 'Legible', true UNION ALL SELECT 'Contemporaneous', true UNION ALL SELECT 'Original', true UNION ALL SELECT 'Accurate', true UNION ALL SELECT 'Complete', true UNION ALL SELECT 'Consistent', true UNION ALL SELECT 'Enduring', true UNION ALL SELECT 'Available', true")
def _(spark, d):
    checks = _reported(spark, d, input_hash="abc", operator_id="me")[1].reports["alcoa"].checks
    return rows(spark, "entry string, ok boolean", *((k["name"], k["ok"]) for k in checks))


@query("compliance_sox", "SELECT 'fail' AS below, 'pass' AS above")
def _(spark, d):
    status = [_reported(spark, d, trust_score=t)[1].reports["sox404"].status for t in (79.9, 80.0)]
    return rows(spark, "below string, above string", tuple(status))


@query("compliance_hipaa", "SELECT 'names' AS entry, 'patient_name' AS open_columns UNION ALL SELECT 'email', ''")
def _(spark, d):
    checks = {k["name"]: k["detail"] for k in _reported(spark, d, masked_columns=("email",))[1].reports["hipaa"].checks}
    return rows(spark, "entry string, open_columns string", *((n, ",".join(checks[n])) for n in ("names", "email")))


@query("compliance_frame_hash", "SELECT true AS same_in_any_order, false AS same_of_other_rows")
def _(spark, d):
    tables(spark, d, "orders")
    df = spark.table("orders").select("o_orderkey", "o_custkey")
    one = frame_hash(df)
    return rows(spark, "same_in_any_order boolean, same_of_other_rows boolean", (one == frame_hash(df.orderBy(F.desc("o_custkey"))), one == frame_hash(df.filter("o_orderkey > 5"))))


@query("lineage_columns", "SELECT 'START' AS event, 'status' AS column_name WHERE false UNION ALL SELECT 'COMPLETE', 'order_key' UNION ALL SELECT 'COMPLETE', 'status'")
def _(spark, d):
    from .queries import dirty

    df = dirty(spark, d).select("order_key", "status", "empty_col")
    tracker = LineageTracker()
    tracker.start(df)
    tracker.complete(df, df.drop("empty_col"))
    return rows(spark, "event string, column_name string", *((e["eventType"], n) for e in tracker.events for o in e["outputs"] for n in o["facets"]["columnLineage"]["fields"]))


@query("enterprise_clean", "SELECT c_custkey AS c_custkey, concat('***', right(c_name, 2)) AS c_name FROM customer")
def _(spark, d):
    tables(spark, d, "customer")
    return clean_enterprise(spark.sql("SELECT c_custkey, concat(' ', c_name) AS c_name FROM customer"), EnterpriseConfig(masking=(MaskingRule("m", columns=("c_name",), strategy="partial", visible=2),)), strategy="conservative").frame


_GAPPY = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS s FROM orders"


@query("gate_statuses", "SELECT 'pass' AS low, 'fail' AS high, 'warn' AS warned, 'skip' AS skipped")
def _(spark, d):
    tables(spark, d, "orders")
    df = spark.sql(_GAPPY)
    status = [evaluate_trust_gate(df, t, on_fail=how, clean_first=False)[1].status for t, how in ((10, "fail"), (101, "fail"), (101, "warn"), (101, "skip"))]
    return rows(spark, "low string, high string, warned string, skipped string", tuple(status))


@query("gate_table", f"SELECT count(*) AS n, true AS passed FROM ({_GAPPY})")
def _(spark, d):
    tables(spark, d, "orders")
    spark.sql(_GAPPY).createOrReplaceTempView("gated_orders")
    r = gate_table(spark, "gated_orders", 10, strategy="conservative", drop_duplicates=False)
    return rows(spark, "n long, passed boolean", (r.rows, r.passed))


@query("gate_manifest", "SELECT 'gated_nation' AS model, count(*) AS n, 'pass' AS status FROM nation")
def _(spark, d):
    tables(spark, d, "nation")
    spark.table("nation").createOrReplaceTempView("gated_nation")
    folder = tempfile.mkdtemp(prefix="millrace-gate-")
    nodes = {"model.a": {"resource_type": "model", "name": "gated_nation"}, "test.b": {"resource_type": "test", "name": "t"}, "model.c": {"resource_type": "model", "name": "other"}}
    with open(f"{folder}/manifest.json", "w", encoding="utf-8") as f:
        json.dump({"nodes": nodes}, f)
    got = gate_manifest(spark, f"{folder}/manifest.json", 10, select=("gated_nation",), audit_dir=folder, strategy="conservative")
    assert os.path.exists(f"{folder}/gated_nation_audit.json")
    return rows(spark, "model string, n long, status string", *((n, r.rows, r.status) for n, r in got.items()))


@query("json_batches", "SELECT event_id, event_type FROM events WHERE event_id < 500")
def _(spark, d):
    from functools import reduce

    from .sources.files import json_batches

    tables(spark, d, "events")
    messages = [json.dumps({"event_id": r[0], "event_type": r[1]}) for r in spark.sql("SELECT event_id, event_type FROM events WHERE event_id < 500").toLocalIterator()]
    return reduce(DataFrame.union, json_batches(spark, messages, "event_id long, event_type string", batch_size=200))


@query("cli_gate", "SELECT 0 AS passes, 1 AS fails, 0 AS warns")
def _(spark, d):
    import contextlib
    import io

    from .cli import main

    with contextlib.redirect_stdout(io.StringIO()):
        codes = tuple(main(["gate", f"{d}/nation.parquet", "--threshold", t, "--on-fail", how]) for t, how in (("10", "fail"), ("101", "fail"), ("101", "warn")))
    return rows(spark, "passes int, fails int, warns int", codes)


@query("outlier_isolation_tails", "SELECT 'flagged' AS kind, count(*) AS n FROM lineitem WHERE l_orderkey % 997 = 0")
def _(spark, d):
    tables(spark, d, "lineitem")
    df = spark.sql("SELECT CASE WHEN l_orderkey % 997 = 0 THEN 1e6 ELSE l_quantity END AS v FROM lineitem")
    out = cleaned(df, strategy="balanced", outlier_method="isolation_forest")
    return out.filter("v_outlier and v > 1e5").agg(F.lit("flagged").alias("kind"), F.count(F.lit(1)).alias("n")).select("kind", "n")
