"""The cleaning core on small tables: steps, bands, roles, outliers, idempotence."""

import pandas as pd
import pytest

import millrace as M
from millrace.config import make_config
from millrace.functions.text import snake_case, unique_names


def frame(n=60):
    return pd.DataFrame(
        {
            "Customer ID": [f"C{i}" for i in range(n)],
            " Amount ($)": ["$1,234.50" if i % 7 else "N/A" for i in range(n)],
            "Active?": ["yes", "No", "YES"] * (n // 3),
            "empty": [""] * n,
            "city": ["  Paris ", "Lyon", None] * (n // 3),
            "Qty": [float(i % 10) if i % 11 else None for i in range(n)],
        }
    )


def test_names():
    assert snake_case("HTTPServerName") == "http_server_name"
    assert unique_names(["a b", "A_B", "a_b_2", "", "x"]) == ["a_b", "a_b_3", "a_b_2", "column_3", "x"]


def test_unknown_option_names_a_near_one():
    with pytest.raises(TypeError, match="drop_duplicates"):
        make_config(drop_duplicate=True)
    with pytest.raises(ValueError):
        make_config(missing_threshold_low=0.5)


def test_clean_balanced(spark):
    out, report = M.clean(frame(), return_report=True)
    got = out.toPandas()
    assert list(got.columns)[:3] == ["customer_id", "amount", "active"]
    assert "empty" not in got and got["active"].dtype == bool
    assert got["amount"].max() == 1234.5 and got["amount"].notna().all()
    assert "city" in report.columns_preserved  # a third is missing: balanced keeps the column as it is
    assert got["qty"].notna().all() and report.missing_after == 20


def test_aggressive_drops_and_is_idempotent(spark):
    out, report = M.clean(frame(), return_report=True, strategy="aggressive")
    assert "city" in report.columns_dropped
    _, again = M.clean(out, return_report=True, strategy="aggressive")
    assert not again


def test_strategies_keep_or_drop(spark):
    rows = M.compare_clean(frame(), strategies=("conservative", "balanced")).toPandas().set_index("strategy")
    assert rows.loc["conservative", "missing"] > rows.loc["balanced", "missing"]


def test_target_id_and_text_are_never_filled(spark):
    n = 40
    pdf = pd.DataFrame({"label": [None, 1.0] * (n // 2), "user_id": [None, "u"] * (n // 2), "note": [None, "a long remark about nothing at all in many words"] * (n // 2)})
    out, report = M.clean(pdf, return_report=True, drop_duplicates=False, drop_empty_rows=False)
    assert out.toPandas().isna().sum().tolist() == [20, 20, 20]
    assert any("label" in w for w in report.warnings)


def test_outliers_flagged_capped_removed(spark):
    pdf = pd.DataFrame({"v": [float(i % 10) for i in range(99)] + [1000.0]})
    flagged = M.clean(pdf, drop_duplicates=False).toPandas()
    assert flagged["v_outlier"].sum() == 1 and flagged["v"].max() == 1000
    assert M.clean(pdf, drop_duplicates=False, outlier_action="cap").toPandas()["v"].max() < 30
    assert M.clean(pdf, drop_duplicates=False, outlier_action="remove").count() == 99


def test_sensitive_column_is_preserved(spark):
    pdf = pd.DataFrame({"price": [float(i % 10) for i in range(99)] + [1000.0]})
    out, report = M.clean(pdf, drop_duplicates=False, return_report=True)
    assert out.columns == ["price"] and report.by_step("outliers")[0].count == 0


@pytest.mark.parametrize("keep,rows", [("first", 3), ("last", 3), ("drop", 2)])
def test_duplicates(spark, keep, rows):
    pdf = pd.DataFrame({"k": [1, 1, 2, None], "n": [5, 5, 6, 7]})
    assert M.clean(pdf, strategy="conservative", duplicate_keep=keep).count() == rows


def test_empty_table_and_nested(spark):
    df = spark.createDataFrame([], "a string, b double, c array<int>")
    out, report = M.clean(df, return_report=True)
    assert out.count() == 0 and not report
    nested = spark.createDataFrame([(1, [1, 2]), (2, None)], "a int, b array<int>")
    assert M.clean(nested).count() == 2


def test_profile_and_plan(spark):
    p = M.profile(frame(), include_plan=True)
    kinds = {x.name: x.would_convert_to for x in p.columns}
    assert kinds[" Amount ($)"] == "numeric" and kinds["Active?"] == "boolean"
    assert {x.name: x.model for x in p.plan.columns}["qty"] in ("mean", "median")


def test_trust_score(spark):
    t = M.compute_trust_score(pd.DataFrame({"a": [1, 1, None, 4], "b": ["x", "x", "y", None]}))
    assert t.completeness == 75 and t.uniqueness == 75 and t.grade in "ABC"


def test_enterprise_masks_and_gates(spark):
    rule = M.MaskingRule("m", columns=("email",), strategy="partial", visible=2)
    pdf = pd.DataFrame({"email": ["ab@cd.org"] * 3, "v": [1, 2, 3]})
    r = M.clean_enterprise(pdf, M.EnterpriseConfig(masking=(rule,), fail_under_trust=101))
    assert not r.passed and set(r.frame.toPandas()["email"]) == {"***rg"}
    assert [e["eventType"] for e in r.lineage.events] == ["START", "COMPLETE"]
    bundle = M.generate_compliance_report(r.report, r.frame.columns)
    assert set(bundle.reports) == {"21cfr11", "gdpr", "alcoa", "sox404", "hipaa"}


def test_streaming_warms_up_then_fills(spark):
    s = M.StreamingCleaner(warmup_batches=1)
    batch = pd.DataFrame({"k": ["a", "b", None, "a"] * 5, "x": [1.0, None, 3, 4] * 5, "n": range(20)})
    first, report = s.clean_batch(batch)
    assert report.streaming["warmup"] and first.filter("k is null").count() == 5
    second, _ = s.clean_batch(batch)
    assert second.filter("k is null or x is null").count() == 0
    shifted = batch.assign(x=batch.x * 1000)
    s.clean_batch(shifted)
    assert any(d.kind == "mean_shift" for d in s.drift)


def test_duplicates_without_a_place_in_the_order(spark):
    """Rows whose order_by is null are neither lost nor emptied; ties are broken by the other columns."""
    df = spark.createDataFrame([(1, "x", None), (1, "y", None), (2, "b", 5), (2, "a", 5), (3, "p", None), (3, "q", 7)], "k int, v string, o int")
    for keep, want in (("first", [(1, "x", None), (2, "a", 5), (3, "q", 7)]), ("last", [(1, "y", None), (2, "b", 5), (3, "p", None)]), ("drop", [])):
        out = M.clean(df, strategy="conservative", duplicate_subset=("k",), duplicate_keep=keep, order_by="o", drop_duplicates=True)
        assert sorted(map(tuple, out.collect()), key=repr) == want
    out = M.clean(df, strategy="conservative", duplicate_subset=("k",), duplicate_keep="aggregate", order_by="o", drop_duplicates=True)
    assert sorted(map(tuple, out.select("k", "v").collect())) == [(1, "x"), (2, "a"), (3, "q")]


def test_report_counters_come_from_its_log(spark):
    df = spark.createDataFrame([(1, " a "), (1, " a "), (2, "n/a")], "id int, name string")
    _, report = M.clean(df, strategy="conservative", return_report=True, drop_duplicates=True)
    assert report.duplicates_removed == 1 == sum(a.count for a in report.by_step("drop_duplicates"))
    assert report.cells_changed == sum(a.count for a in report) and len(report) == len(report.actions) and bool(report)
    shown = report.to_dict()
    assert shown["rows_before"] == 3 and shown["rows_after"] == 2 and [a["step"] for a in shown["actions"]] == [a.step for a in report]
    assert report.to_frame(spark).count() == len(report) and report.to_markdown().count("\n") == len(report) + 1 and "rows 3 -> 2" in report.summary()


def test_dates_of_every_format_are_read(spark):
    from datetime import datetime

    from millrace.plans.repair import ISO_FORMATS, MONTH_FIRST, parsed_date, shape_of
    from pyspark.sql import functions as F

    at = datetime(2021, 3, 14, 5, 6, 7)
    for fmt in (*ISO_FORMATS, *MONTH_FIRST):
        row = spark.createDataFrame([(at,)], "t timestamp").select(F.date_format("t", fmt).alias("s")).select("s", parsed_date(F.col("s"), False).alias("d"), F.col("s").rlike(f"^{shape_of(fmt)}$").alias("ok")).first()
        assert row.ok and row.d is not None and (row.d.year, row.d.month) == (2021, 3), fmt


def test_isolation_forest(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = np.append(rng.normal(100, 5, 300), 5000.0)
    out, report = M.clean(pd.DataFrame({"v": v}), return_report=True, strategy="aggressive", outlier_method="isolation_forest", outlier_action="cap", drop_duplicates=False)
    assert out.toPandas()["v"].max() < 1000 and "isolation_forest" in report.by_step("outliers")[0].description
    few = pd.DataFrame({"v": np.append(rng.normal(100, 5, 50), 5000.0)})
    out, report = M.clean(few, return_report=True, strategy="aggressive", outlier_method="isolation_forest", outlier_action="cap", drop_duplicates=False)
    assert out.toPandas()["v"].max() < 5000 and "fell back" in report.by_step("outliers")[0].description


def test_isolation_intervals():
    import numpy as np

    from millrace.operators.isolation import inliers

    rng = np.random.default_rng(1)
    inside = inliers(np.concatenate([rng.normal(0, 1, 2000), [50.0, -60.0]]))
    holds = lambda x: any(lo < x <= hi for lo, hi in inside)
    assert holds(0.0) and holds(0.5) and not holds(50.0) and not holds(-60.0) and not holds(30.0)
    assert inliers(np.full(500, 3.0)) in ([], [(-np.inf, np.inf)])


def test_knn_fill_against_brute_force(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from millrace.operators.missing import knn_fill

    rng = np.random.default_rng(5)
    a, b = rng.normal(size=700), rng.normal(size=700)
    v = np.where(np.arange(700) % 7 == 0, np.nan, a + b)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(700), "v": v, "a": a, "b": b})).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = knn_fill(df, "v", ["a", "b"], None).toPandas().sort_values("i")["v"].to_numpy()
    z = np.stack([(x - x.mean()) / x.std(ddof=1) for x in (a, b)], 1)
    known = np.flatnonzero(~np.isnan(v))
    for i in np.flatnonzero(np.isnan(v)):
        near = known[np.argsort(((z[known] - z[i]) ** 2).sum(1))[:5]]
        assert abs(got[i] - v[near].mean()) < 1e-9


def test_time_fill_in_an_order_of_texts(spark):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from millrace.operators.missing import time_fill
    from millrace.plans.context import is_ordered, row_range
    from millrace.plans.repair import RID

    rows = [(f"k{i:04d}", datetime(2024, 1, 1) + timedelta(hours=i) if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, f"{RID} string, t timestamp_ntz").repartition(5)
    assert df.select(row_range(df).alias("p")).distinct().count() > 1 and is_ordered(df, "t")
    got = [r.t for r in time_fill(df, "t").orderBy(RID).collect()]
    last, want = None, []
    for _, t in rows:
        last = t or last
        want.append(last or datetime(2024, 1, 1, 1))
    assert got == want


def test_order_of_times_beyond_the_years_of_python(spark):
    from millrace.plans.context import is_ordered
    from millrace.plans.repair import RID

    spark.range(400).selectExpr(f"id AS {RID}", "date'2024-01-01' + cast(id * 10000 AS int) AS up", "date'2024-01-01' - cast(id * 10000 AS int) AS down").createOrReplaceTempView("far_times")
    for kind in ("date", "timestamp", "timestamp_ntz"):
        df = spark.sql(f"SELECT {RID}, cast(up AS {kind}) AS up, cast(down AS {kind}) AS down FROM far_times")
        assert is_ordered(df, "up") and not is_ordered(df, "down")
    nulls = spark.sql(f"SELECT {RID}, cast(NULL AS date) AS t FROM far_times")
    assert is_ordered(nulls, "t") and is_ordered(nulls.limit(0), "t")


def test_distinct_counts_are_exact_in_large_tables(spark):
    from millrace.plans.context import EXACT_ROWS

    n = EXACT_ROWS + 20_000
    df = spark.range(n).selectExpr("id % 15000 AS k", "concat('t', id div 3) AS t", "cast(id AS double) / 7 AS x", "if(id % 2 = 0, null, id) AS odd")
    got = {r["column"]: r["nunique"] for r in M.infer_roles(df).collect()}
    assert got == {"k": 15_000, "t": n // 3, "x": n, "odd": n // 2}
