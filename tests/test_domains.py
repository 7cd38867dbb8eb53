"""Rule packs: known violations, repairs, feeds."""

import datetime

import pandas as pd
import pytest

from millrace import clean
from millrace.domains.packs import HEALTHCARE, MEDIA, SINGLE, TRANSPORT
from millrace.domains.runner import choose_pack, validate


def failing(report):
    return {f["rule_id"]: f["violations"] for f in report.domain_findings if not f["passed"]}


def test_all_rules_are_there():
    packs = [*SINGLE.values(), *TRANSPORT.values(), *HEALTHCARE.values(), *MEDIA.values()]
    ids = [r.id for p in packs for r in p.rules]
    assert len(ids) == len(set(ids)) == 117


def test_finance(spark):
    pdf = pd.DataFrame({"txn_id": ["a", "a", "b", None], "date": ["2024-01-01", "01/31/2024", "2024-02-30", "2024-01-05"], "debit": ["10", "0", "5.123", "1"], "credit": ["0", "10", "0", "1"], "currency": ["USD", "usd", "EUR", "GBP"]})
    out, report = clean(pdf, domain="finance", return_report=True)
    assert failing(report) == {"FIN-001": 1, "FIN-003": 2, "FIN-004": 1, "FIN-005": 1, "FIN-006": 1, "FIN-007": 1}
    assert "2024-01-31" in set(out.toPandas()["date"])


def test_retail_strips_digits(spark):
    out, report = clean(pd.DataFrame({"gtin": ["4006381333931", "400638133393 1", "4006381333932"]}), domain="retail", return_report=True)
    assert failing(report)["GS1-002"] == 1 and failing(report)["GS1-003"] == 1
    assert (out.toPandas()["gtin"] == "4006381333931").sum() == 2


def test_media_and_healthcare(spark):
    _, report = clean(pd.DataFrame({"eidr_id": ["10.5240/7791-8534-2C23-9030-8004-7", "bad"], "runtime": ["90", "-1"]}), domain="media", return_report=True)
    assert failing(report) == {"MD-C002": 1, "MD-C007": 1}
    out, report = clean(pd.DataFrame({"mrn": ["1", "2"], "dob": ["1990", "1950-01-01"], "sex": ["Male", "x"]}), domain="healthcare", return_report=True)
    assert failing(report) == {"HC-P003I": 1, "HC-P005": 2} and out.toPandas()["sex"].tolist() == ["male", "x"]


def test_clock_can_be_fixed(spark):
    pdf = pd.DataFrame({"field_id": ["f"], "operation_date": ["2024-05-01"]})
    pack = choose_pack("agriculture", list(pdf.columns))
    past = validate(spark.createDataFrame(pdf), pack, today=datetime.date(2024, 1, 1))
    assert {f.rule.id for f in past.findings if f.violations} == {"AG-003"}


def test_feed(spark):
    feed = {
        "routes": pd.DataFrame({"route_id": ["r1"], "route_type": ["3"]}),
        "trips": pd.DataFrame({"route_id": ["r1", "r9"], "service_id": ["s", "s"], "trip_id": ["t1", "t2"]}),
        "notes": pd.DataFrame({"x": [1]}),
    }
    out, report = clean(feed, domain="transport", return_report=True)
    assert failing(report) == {"GTFS-T003": 1} and set(out) == {"routes", "trips", "notes"}


def test_selectors_need_a_domain():
    with pytest.raises(TypeError):
        clean(pd.DataFrame({"a": [1]}), gtfs_file="stops")
