"""Queries over the driver's tables, one per operator, with their SQL where SQL can say the same.

Dirty inputs are made by one SELECT that both engines read alike; the queries
then run the engine's operators on them, whole tables at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .cleaner import run_pipeline
from .config import CleanConfig, make_config
from .domains.packs import FINANCE, RETAIL, TRANSPORT, Rule
from .domains.runner import validate
from .enterprise.cluster import ClusterConfig, clusters, merge_clusters
from .enterprise.mask import MaskingRule, mask_dataframe
from .enterprise.semantic import SemanticValidatorConfig, run_semantic_validation
from .enterprise.trust import compute_trust_score
from .functions import text as X
from .operators.missing import pearson, time_fill
from .operators.outliers import fences
from .plans.context import build_contexts
from .plans.repair import RID, fold_nan, with_rid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return put


OFF = dict(column_names=False, drop_empty_rows=False, drop_empty_columns=False, fix_dtypes=False, drop_duplicates=False, strategy="conservative", strip_whitespace=False, normalize_sentinels=False)

#: A dirty order table: white space, sentinels, formatted numbers, flags as words, gaps.
DIRTY = """
SELECT o_orderkey AS order_key, o_custkey AS cust_key,
  CASE WHEN o_orderkey % 11 = 0 THEN concat('  ', o_orderstatus, ' ') WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN '$1,250' WHEN o_orderkey % 9 = 0 THEN 'null' ELSE cast(o_custkey AS varchar(20)) END AS amount_text,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS flag,
  concat('0', cast(o_custkey AS varchar(20))) AS padded,
  CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE cast(o_custkey % 50 AS double) END AS qty,
  CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  cast(NULL AS varchar(10)) AS empty_col, 'x' AS constant_col
FROM orders
"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "orders")
    return spark.sql(DIRTY.replace("varchar(20)", "string").replace("varchar(10)", "string"))


def cleaned(df: DataFrame, **options) -> DataFrame:
    return run_pipeline(df, make_config(CleanConfig(**OFF), **options))[0]


# -- representation ----------------------------------------------------------

_STATUS = "CASE WHEN o_orderkey % 11 = 0 THEN {a} WHEN o_orderkey % 7 = 0 THEN {b} ELSE o_orderstatus END"


@query("strip_sentinels", f"SELECT o_orderkey AS order_key, {_STATUS.format(a='o_orderstatus', b='NULL')} AS status, CASE WHEN o_orderkey % 5 = 0 THEN '$1,250' WHEN o_orderkey % 9 = 0 THEN NULL ELSE cast(o_custkey AS varchar) END AS amount_text FROM orders")
def _(spark, d):
    return cleaned(dirty(spark, d), strip_whitespace=True, normalize_sentinels=True).select("order_key", "status", "amount_text")


@query("strip_only", f"SELECT o_orderkey AS order_key, {_STATUS.format(a='o_orderstatus', b=repr('N/A'))} AS status FROM orders")
def _(spark, d):
    return cleaned(dirty(spark, d), strip_whitespace=True).select("order_key", "status")


@query("snake_case_names", "SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS nation_name_2 FROM nation")
def _(spark, d):
    tables(spark, d, "nation")
    return cleaned(spark.table("nation").select(F.col("n_nationkey").alias("NationKey"), F.col("n_name").alias(" Nation Name "), F.col("n_regionkey").alias("nation-name")), column_names=True)


@query("drop_empty_columns", "SELECT o_orderkey AS order_key, 'x' AS constant_col FROM orders")
def _(spark, d):
    return cleaned(dirty(spark, d).select("order_key", "empty_col", "constant_col"), drop_empty_columns=True)


@query("drop_empty_rows", "SELECT s AS status, q AS qty FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS q FROM orders) WHERE s IS NOT NULL OR q IS NOT NULL")
def _(spark, d):
    tables(spark, d, "orders")
    df = spark.sql("SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS qty FROM orders")
    return cleaned(df, drop_empty_rows=True)


@query("drop_constant_columns", "SELECT o_orderkey AS order_key FROM orders")
def _(spark, d):
    return cleaned(dirty(spark, d).select("order_key", "constant_col", "empty_col"), drop_constant_columns=True)


@query("parse_booleans", "SELECT o_orderkey AS order_key, o_orderkey % 2 = 0 AS flag FROM orders")
def _(spark, d):
    return cleaned(dirty(spark, d).select("order_key", "flag"), fix_dtypes=True)


@query("parse_numbers", "SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 5 = 0 THEN 1250 WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS amount_text FROM orders")
def _(spark, d):
    return cleaned(dirty(spark, d).select("order_key", "amount_text"), fix_dtypes=True, normalize_sentinels=True).select("order_key", F.col("amount_text").cast("long").alias("amount_text"))


@query("keep_leading_zeros", "SELECT o_orderkey AS order_key, concat('0', cast(o_custkey AS varchar)) AS padded FROM orders")
def _(spark, d):
    return cleaned(dirty(spark, d).select("order_key", "padded"), fix_dtypes=True)


@query("parse_dates", "SELECT o_orderkey AS order_key, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(spark, d):
    tables(spark, d, "orders")
    df = spark.sql("SELECT o_orderkey AS order_key, date_format(o_orderdate, 'M/d/yyyy') AS day FROM orders")
    out = cleaned(df, fix_dtypes=True)
    return out.select("order_key", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("european_numbers", "SELECT o_orderkey AS order_key, o_custkey + 0.5 AS price_text FROM orders")
def _(spark, d):
    tables(spark, d, "orders")
    df = spark.sql("SELECT o_orderkey AS order_key, concat(format_string('%d', o_custkey), ',5') AS price_text FROM orders")
    return cleaned(df, fix_dtypes=True, decimal=",", thousands=".").select("order_key", F.col("price_text").cast("decimal(20,1)").alias("price_text"))


# -- duplicates --------------------------------------------------------------

_PAIRS = "SELECT o_custkey % 300 AS k, o_orderkey AS v, o_custkey AS w FROM orders"


def pairs(spark, d):
    tables(spark, d, "orders")
    return spark.sql(_PAIRS)


@query("dedup_full_rows", "SELECT DISTINCT o_custkey % 300 AS k, o_orderstatus AS s FROM orders")
def _(spark, d):
    tables(spark, d, "orders")
    return cleaned(spark.sql("SELECT o_custkey % 300 AS k, o_orderstatus AS s FROM orders"), drop_duplicates=True)


@query("dedup_first", f"SELECT k, v, w FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v) AS r FROM ({_PAIRS})) WHERE r = 1")
def _(spark, d):
    return cleaned(pairs(spark, d), drop_duplicates=True, duplicate_subset=("k",), order_by="v")


@query("dedup_last", f"SELECT k, v, w FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS r FROM ({_PAIRS})) WHERE r = 1")
def _(spark, d):
    return cleaned(pairs(spark, d), drop_duplicates=True, duplicate_subset=("k",), duplicate_keep="last", order_by="v")


@query("dedup_drop_all", f"SELECT k, v, w FROM (SELECT *, count(*) OVER (PARTITION BY w) AS c FROM ({_PAIRS})) WHERE c = 1")
def _(spark, d):
    return cleaned(pairs(spark, d), drop_duplicates=True, duplicate_subset=("w",), duplicate_keep="drop")


@query("dedup_aggregate", f"SELECT k, round(avg(v), 4) AS v, round(avg(w), 4) AS w FROM ({_PAIRS}) GROUP BY k")
def _(spark, d):
    out = cleaned(pairs(spark, d), drop_duplicates=True, duplicate_subset=("k",), duplicate_keep="aggregate", order_by="v")
    return out.select("k", F.round("v", 4).alias("v"), F.round("w", 4).alias("w"))


# -- missing values ----------------------------------------------------------

_QTY = "CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE cast(o_custkey % 50 AS double) END"


@query("fill_low_numeric", f"WITH t AS (SELECT o_orderkey AS order_key, {_QTY} AS qty FROM orders) SELECT order_key, round(coalesce(qty, (SELECT avg(qty) FROM t)), 6) AS qty FROM t")
def _(spark, d):
    out = cleaned(dirty(spark, d).select("order_key", "qty"), strategy="balanced", missing_indicators=False, outlier_action=None)
    return out.select("order_key", F.round("qty", 6).alias("qty"))


@query("fill_median", f"WITH t AS (SELECT o_orderkey AS order_key, {_QTY} AS qty FROM orders) SELECT order_key, coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM t)) AS qty FROM t")
def _(spark, d):
    return cleaned(dirty(spark, d).select("order_key", "qty"), impute="median")


@query("fill_mode", "WITH t AS (SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders), m AS (SELECT priority FROM t WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1) SELECT order_key, coalesce(priority, (SELECT priority FROM m)) AS priority FROM t")
def _(spark, d):
    return cleaned(dirty(spark, d).select("order_key", "priority"), impute="mode")


@query("fill_sentinel", "SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 40 = 0 THEN 'Unknown' ELSE o_orderpriority END AS priority FROM orders")
def _(spark, d):
    return cleaned(dirty(spark, d).select("order_key", "priority"), strategy="balanced", missing_indicators=False)


@query("missing_indicators", f"WITH t AS (SELECT o_orderkey AS order_key, {_QTY} AS qty FROM orders) SELECT order_key, round(coalesce(qty, (SELECT avg(qty) FROM t)), 6) AS qty, qty IS NULL AS qty_was_missing FROM t")
def _(spark, d):
    out = cleaned(dirty(spark, d).select("order_key", "qty"), strategy="balanced", missing_indicators=True, outlier_action=None)
    return out.withColumn("qty", F.round("qty", 6))


@query("forward_fill", """
WITH t AS (SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders)
SELECT rid, strftime(coalesce(last_value(d IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(d IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), '%Y-%m-%d') AS d FROM t
""")
def _(spark, d):
    tables(spark, d, "orders")
    df = spark.sql("SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders")
    out = time_fill(df.withColumn(RID, F.col("rid")), "d")
    return out.select("rid", F.date_format("d", "yyyy-MM-dd").alias("d"))


@query("drop_extreme_columns", "SELECT o_orderkey AS order_key, o_orderstatus AS status FROM orders")
def _(spark, d):
    tables(spark, d, "orders")
    df = spark.sql("SELECT o_orderkey AS order_key, o_orderstatus AS status, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 9 END AS rest FROM orders")
    return cleaned(df, strategy="aggressive", missing_indicators=False)


# -- outliers ----------------------------------------------------------------

_FENCES = "SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM t"
_SPIKES = "SELECT l_orderkey AS k, l_linenumber AS l, CASE WHEN l_orderkey % 97 = 0 THEN cast(l_quantity AS double) * 40 ELSE cast(l_quantity AS double) END AS l_quantity FROM lineitem"


def spikes(spark, d):
    tables(spark, d, "lineitem")
    return spark.sql(_SPIKES)


@query("outlier_flag", f"WITH t AS ({_SPIKES}), f AS ({_FENCES}) SELECT k, l, l_quantity, l_quantity < q1 - 1.5 * (q3 - q1) OR l_quantity > q3 + 1.5 * (q3 - q1) AS l_quantity_outlier FROM t, f")
def _(spark, d):
    return cleaned(spikes(spark, d), strategy="balanced", id_columns=("k", "l"))


@query("outlier_cap", f"WITH t AS ({_SPIKES}), f AS ({_FENCES}) SELECT k, l, greatest(least(l_quantity, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)) AS l_quantity FROM t, f")
def _(spark, d):
    return cleaned(spikes(spark, d), strategy="aggressive", outlier_action="cap", id_columns=("k", "l"))


@query("outlier_remove", f"WITH t AS ({_SPIKES}), f AS ({_FENCES}) SELECT k, l, l_quantity FROM t, f WHERE NOT (l_quantity < q1 - 1.5 * (q3 - q1) OR l_quantity > q3 + 1.5 * (q3 - q1))")
def _(spark, d):
    return cleaned(spikes(spark, d), strategy="balanced", outlier_action="remove", id_columns=("k", "l"))


@query("outlier_zscore_clip", f"WITH t AS ({_SPIKES}), f AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM t) SELECT k, l, round(greatest(least(l_quantity, m + 3 * s), m - 3 * s), 4) AS l_quantity FROM t, f")
def _(spark, d):
    out = cleaned(spikes(spark, d).select(F.col("k").cast("string").alias("k"), F.col("l").cast("string").alias("l"), "l_quantity"), outliers="clip", outlier_method="zscore")
    return out.select(F.col("k").cast("long").alias("k"), F.col("l").cast("long").alias("l"), F.round("l_quantity", 4).alias("l_quantity"))


@query("outlier_fences", "SELECT 'c_acctbal' AS column_name, round(quantile_cont(c_acctbal, 0.25) - 1.5 * (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)), 4) AS low, round(quantile_cont(c_acctbal, 0.75) + 1.5 * (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)), 4) AS high FROM customer")
def _(spark, d):
    tables(spark, d, "customer")
    f = fences(spark.table("customer").select("c_acctbal"), CleanConfig())["c_acctbal"]
    return spark.range(1).select(F.lit("c_acctbal").alias("column_name"), F.round(F.lit(f.low), 4).alias("low"), F.round(F.lit(f.high), 4).alias("high"))


# -- profiles ----------------------------------------------------------------


@query("column_statistics", "SELECT 'l_quantity' AS name, count(*) AS n_rows, count(*) - count(l_quantity) AS n_missing, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, round(skewness(l_quantity), 5) AS skew FROM lineitem")
def _(spark, d):
    tables(spark, d, "lineitem")
    x = build_contexts(with_rid(fold_nan(spark.table("lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"))), CleanConfig()), CleanConfig())["l_quantity"]
    return spark.range(1).select(F.lit("l_quantity").alias("name"), F.lit(x.n_rows).cast("long").alias("n_rows"), F.lit(x.n_missing).cast("long").alias("n_missing"), F.round(F.lit(float(x.mean)), 6).alias("mean"), F.round(F.lit(x.std), 6).alias("std"), F.round(F.lit(x.skew), 5).alias("skew"))


@query("pairwise_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def _(spark, d):
    tables(spark, d, "lineitem")
    return spark.table("lineitem").agg(F.round(pearson(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


@query("duplicate_count", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey % 300 AS k, o_orderstatus AS s FROM orders)) AS n FROM orders")
def _(spark, d):
    tables(spark, d, "orders")
    df = spark.sql("SELECT o_custkey % 300 AS k, o_orderstatus AS s FROM orders")
    return spark.range(1).select(F.lit(api.duplicate_rows(df)).cast("long").alias("n"))


@query("infer_roles", "SELECT 'o_orderkey' AS column_name, 'id' AS role UNION ALL SELECT 'o_custkey', 'numeric' UNION ALL SELECT 'o_orderstatus', 'categorical' UNION ALL SELECT 'o_totalprice', 'numeric' UNION ALL SELECT 'o_orderdate', 'datetime' UNION ALL SELECT 'o_orderpriority', 'categorical'")
def _(spark, d):
    tables(spark, d, "orders")
    return api.infer_roles(spark.table("orders")).select(F.col("column").alias("column_name"), "role")


@query("trust_score", """
WITH t AS (SELECT o_custkey % 300 AS k, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)
SELECT round(100.0 * (count(k) + count(s)) / (2 * count(*)), 6) AS completeness, 100.0 AS validity, round(100.0 * (SELECT count(*) FROM (SELECT DISTINCT k, s FROM t)) / count(*), 6) AS uniqueness, 100.0 AS consistency FROM t
""")
def _(spark, d):
    tables(spark, d, "orders")
    t = compute_trust_score(spark.sql("SELECT o_custkey % 300 AS k, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders"))
    return spark.range(1).select(*(F.round(F.lit(float(v)), 6).alias(k) for k, v in (("completeness", t.completeness), ("validity", t.validity), ("uniqueness", t.uniqueness), ("consistency", t.consistency))))


@query("profile_orders")
def _(spark, d):
    tables(spark, d, "orders")
    return api.profile(spark.table("orders")).to_frame(spark)


@query("suggest_plan")
def _(spark, d):
    return api.suggest_plan(dirty(spark, d)).to_frame(spark)


@query("compare_plans")
def _(spark, d):
    return api.compare_plans(dirty(spark, d))


@query("compare_clean")
def _(spark, d):
    return api.compare_clean(dirty(spark, d))


@query("clean_balanced", f"""
WITH t AS (SELECT DISTINCT o_orderkey AS order_key, o_custkey AS cust_key, CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status,
  o_orderkey % 2 = 0 AS flag, {_QTY} AS qty FROM orders)
SELECT order_key, cust_key, coalesce(status, 'Missing') AS status, flag, round(coalesce(qty, (SELECT avg(qty) FROM t)), 6) AS qty FROM t
""")
def _(spark, d):
    df = dirty(spark, d).select("order_key", "cust_key", "status", "flag", "qty", "empty_col")
    out = run_pipeline(df, CleanConfig(missing_indicators=False, outlier_action=None))[0]
    return out.withColumn("qty", F.round("qty", 6))


# -- clusters, masks, validity ------------------------------------------------

_NAMES = "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN concat(n_name, ' Co.') WHEN c_custkey % 3 = 1 THEN concat('co ', lower(n_name)) ELSE concat(n_name, ' CO') END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey"


def names(spark, d):
    tables(spark, d, "customer", "nation")
    return spark.sql(_NAMES)


_KEY = "array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(trim(name)), '[^a-z0-9 ]', '', 'g'), ' +'), lambda x: x <> ''))), ' ')"


@query("cluster_fingerprint", f"WITH c AS (SELECT name, count(*) AS n FROM ({_NAMES}) GROUP BY name), g AS (SELECT {_KEY} AS key, name, n FROM c) SELECT key, arg_max(name, (n, length(name), name)) AS canonical, count(*) AS variants, sum(n)::BIGINT AS total FROM g GROUP BY key HAVING count(*) >= 2")
def _(spark, d):
    return clusters(names(spark, d), "name").select("key", "canonical", F.size("variants").cast("long").alias("variants"), "total")


@query("merge_clusters", f"WITH c AS (SELECT name, count(*) AS n FROM ({_NAMES}) GROUP BY name), g AS (SELECT {_KEY} AS key, name, n FROM c), m AS (SELECT key, arg_max(name, (n, length(name), name)) AS canonical FROM g GROUP BY key) SELECT k, canonical AS name FROM ({_NAMES}) JOIN g USING (name) JOIN m USING (key)")
def _(spark, d):
    return merge_clusters(names(spark, d), ClusterConfig(columns=("name",)))[0]


@query("cluster_ngram")
def _(spark, d):
    return clusters(names(spark, d), "name", ClusterConfig(method="ngram")).select("key", "canonical", "total")


@query("mask_partial", "SELECT c_custkey, concat('***', right(c_name, 4)) AS c_name FROM customer")
def _(spark, d):
    tables(spark, d, "customer")
    return mask_dataframe(spark.table("customer").select("c_custkey", "c_name"), (MaskingRule("m", columns=("c_name",), strategy="partial", salt="s"),))[0]


@query("mask_redact", "SELECT c_custkey, '***' AS c_name FROM customer")
def _(spark, d):
    tables(spark, d, "customer")
    return mask_dataframe(spark.table("customer").select("c_custkey", "c_name"), (MaskingRule("m", pattern="name$", strategy="redact", salt="s"),))[0]


@query("mask_scrub", r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '***', 'g') AS text FROM documents")
def _(spark, d):
    tables(spark, d, "documents")
    return mask_dataframe(spark.table("documents").select("doc_id", "text"), (MaskingRule("m", columns=("text",), strategy="regex_scrub", scrub_patterns=("email",), salt="s"),))[0]


@query("mask_hash")
def _(spark, d):
    tables(spark, d, "customer")
    return mask_dataframe(spark.table("customer").select("c_custkey", "c_name"), (MaskingRule("m", columns=("c_name",), salt="fixed"),))[0]


@query("semantic_reference", "SELECT 'o_orderstatus' AS column_name, count(*) AS checked, count(*) FILTER (WHERE lower(o_orderstatus) NOT IN ('f', 'o')) AS invalid FROM orders WHERE o_orderstatus IS NOT NULL")
def _(spark, d):
    tables(spark, d, "orders")
    v = run_semantic_validation(spark.table("orders"), (SemanticValidatorConfig("status", columns=("o_orderstatus",), reference=("F", "O")),))["o_orderstatus"]
    return spark.range(1).select(F.lit("o_orderstatus").alias("column_name"), F.lit(v.checked).cast("long").alias("checked"), F.lit(v.invalid).cast("long").alias("invalid"))


# -- rule packs ---------------------------------------------------------------

_LEDGER = "SELECT concat('t', cast(l_orderkey AS varchar(20))) AS transaction_id, CASE WHEN l_linenumber = 1 THEN 'bad date' ELSE '2020-01-15' END AS date, CASE WHEN l_linenumber % 2 = 0 THEN 10 ELSE 0 END AS debit, CASE WHEN l_linenumber % 2 = 1 THEN 10 ELSE 0 END AS credit, CASE WHEN l_linenumber = 3 THEN 'usd' ELSE 'USD' END AS currency FROM lineitem"


@query("rules_finance", f"""
WITH t AS ({_LEDGER}), b AS (SELECT *, sum(debit) OVER (PARTITION BY transaction_id) - sum(credit) OVER (PARTITION BY transaction_id) AS gap FROM t)
SELECT 'FIN-003' AS rule_id, count(*) FILTER (WHERE date = 'bad date') AS violations FROM b
UNION ALL SELECT 'FIN-005', count(*) FILTER (WHERE currency = 'usd') FROM b
UNION ALL SELECT 'FIN-006', count(*) FILTER (WHERE abs(gap) > 0.01) FROM b
""")
def _(spark, d):
    tables(spark, d, "lineitem")
    out = validate(spark.sql(_LEDGER.replace("varchar(20)", "string")), FINANCE).to_frame()
    return out.filter("rule_id in ('FIN-003', 'FIN-005', 'FIN-006')").select("rule_id", "violations")


_GTIN = "SELECT CASE WHEN p_partkey % 2 = 0 THEN '4006381333931' WHEN p_partkey % 3 = 0 THEN '4006381333932' ELSE 'x1' END AS gtin FROM part"


@query("rules_retail", f"WITH t AS ({_GTIN}) SELECT 'GS1-002' AS rule_id, count(*) FILTER (WHERE gtin = 'x1') AS violations FROM t UNION ALL SELECT 'GS1-003', count(*) FILTER (WHERE gtin = '4006381333932') FROM t")
def _(spark, d):
    tables(spark, d, "part")
    return validate(spark.sql(_GTIN), RETAIL).to_frame().filter("rule_id in ('GS1-002', 'GS1-003')").select("rule_id", "violations")


@query("rules_sibling_reference", "SELECT 'GTFS-T003' AS rule_id, count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) AS violations FROM orders")
def _(spark, d):
    tables(spark, d, "orders", "customer")
    trips = spark.sql("SELECT o_custkey AS route_id, 's' AS service_id, o_orderkey AS trip_id FROM orders")
    routes = spark.sql("SELECT c_custkey AS route_id FROM customer WHERE c_custkey % 2 = 0")
    return validate(trips, TRANSPORT["trips"], siblings={"routes": routes}).to_frame().filter("rule_id = 'GTFS-T003'").select("rule_id", "violations")


@query("rules_rising_sequence", "SELECT 'GTFS-ST004' AS rule_id, count(*) FILTER (WHERE s <= prev) AS violations FROM (SELECT s, lag(s) OVER (PARTITION BY t ORDER BY rid) AS prev FROM (SELECT l_orderkey AS t, l_linenumber % 4 AS s, l_orderkey * 10 + l_linenumber AS rid FROM lineitem))")
def _(spark, d):
    tables(spark, d, "lineitem")
    df = spark.sql("SELECT l_orderkey AS trip_id, l_linenumber % 4 AS stop_sequence, '1:00:00' AS arrival_time, '1:00:00' AS departure_time, 'a' AS stop_id, l_orderkey * 10 + l_linenumber AS rid FROM lineitem")
    return validate(df.withColumnRenamed("rid", RID), TRANSPORT["stop_times"]).to_frame().filter("rule_id = 'GTFS-ST004'").select("rule_id", "violations")


@query("rule_unique", "SELECT 'GTFS-S004' AS rule_id, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS violations FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def _(spark, d):
    tables(spark, d, "orders")
    df = spark.sql("SELECT o_custkey AS stop_id, 1.0D AS stop_lat, 2.0D AS stop_lon FROM orders")
    return validate(df, TRANSPORT["stops"]).to_frame().filter("rule_id = 'GTFS-S004'").select("rule_id", "violations")


@query("rule_range", "SELECT 'R1' AS rule_id, count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) AS violations FROM lineitem")
def _(spark, d):
    from .domains.packs import Pack

    tables(spark, d, "lineitem")
    pack = Pack("own", "1", ("l_quantity",), (), (), {}, (Rule("R1", "format", "error", ("l_quantity",), "range", {"min": 5, "max": 45}),))
    return validate(spark.table("lineitem"), pack).to_frame().select("rule_id", "violations")


@query("gs1_check_digit", "SELECT p_partkey, cast((10 - list_sum(list_transform(range(1, 13), lambda i: cast(substr(code, cast(i AS INTEGER), 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS INTEGER) = cast(substr(code, 13, 1) AS INTEGER) AS ok FROM (SELECT p_partkey, lpad(cast(p_partkey * 7919 AS varchar), 13, '0') AS code FROM part)")
def _(spark, d):
    tables(spark, d, "part")
    return spark.table("part").select("p_partkey", X.gs1_valid(F.lpad((F.col("p_partkey") * 7919).cast("string"), 13, "0")).alias("ok"))
