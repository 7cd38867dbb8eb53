"""Readers, writers, the synthetic table, own packs."""

import json

import pytest
from pyspark.sql import functions as F

import millrace as M
from millrace import clean, clean_csv
from millrace.domains.loader import load_pack
from millrace.domains.runner import validate
from millrace.sources.files import read_table, write_table
from millrace.sources.synthetic import dirty_table, flatten


@pytest.mark.parametrize("suffix", ["parquet", "csv", "json", "orc"])
def test_round_trip(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    path = str(tmp_path / f"t.{suffix}")
    write_table(df, path, "jsonl" if suffix == "json" else None)
    back = read_table(spark, path, "jsonl" if suffix == "json" else None)
    assert sorted(int(r["k"]) for r in back.collect()) == [1, 2]


def test_clean_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Order ID,Amount\n1,\"$1,200\"\n2,N/A\n2,N/A\n")
    out = clean_csv(str(tmp_path / "in.csv"), spark=spark)
    assert out.columns == ["order_id", "amount"] and out.count() == 2


def test_synthetic_table_is_dirty_and_repeatable(spark):
    a, b = dirty_table(spark, 500, partitions=1), dirty_table(spark, 500, partitions=3)
    assert a.exceptAll(b).count() == 0
    share = a.filter(F.col("num_0").isNull()).count() / 500
    assert 0.08 < share < 0.25
    assert clean(a, strategy="conservative").filter("cat_0 = 'N/A'").count() == 0


def test_flatten(spark):
    df = spark.sql("select 1 as a, named_struct('x', 2, 'y', 3) as s")
    assert flatten(df).columns == ["a", "s_x", "s_y"]


def test_own_pack(spark, tmp_path):
    rules = [
        {"id": "R1", "layer": "format", "severity": "error", "field": "v", "check": "range", "params": {"min": 0, "max": 10}, "repair": "reject"},
        {"id": "R2", "layer": "reference", "severity": "warning", "field": "k", "check": "enum", "params": {"values": ["A"], "case_insensitive": True}},
    ]
    path = tmp_path / "pack.json"
    path.write_text(json.dumps({"name": "own", "rules": rules}))
    df = spark.createDataFrame([("a", 5), ("b", 50)], "k string, v int")
    out = validate(df, load_pack(str(path)))
    assert {f.rule.id: f.violations for f in out.findings} == {"R1": 1, "R2": 1} and out.frame.count() == 1


@pytest.fixture
def flight_server():
    import threading

    import pyarrow as pa

    flight = pytest.importorskip("pyarrow.flight")
    table = pa.table({"k": pa.array(range(25), pa.int64()), "v": [f" v{i} " for i in range(25)]})

    class Server(flight.FlightServerBase):
        def get_flight_info(self, context, descriptor):
            ends = [flight.FlightEndpoint(t, [flight.Location.for_grpc_tcp("127.0.0.1", self.port)]) for t in (b"0", b"1")]
            return flight.FlightInfo(table.schema, descriptor, ends, table.num_rows, -1)

        def do_get(self, context, ticket):
            return flight.RecordBatchStream(table.slice(0, 10) if ticket.ticket == b"0" else table.slice(10))

    server = Server("grpc+tcp://127.0.0.1:0")
    threading.Thread(target=server.serve, daemon=True).start()
    yield f"grpc+tcp://127.0.0.1:{server.port}"
    server.shutdown()


def test_flight_tables_and_batches(spark, flight_server):
    from millrace.sources.files import flight_batches, read_flight

    df = read_flight(spark, flight_server, ("any",))
    assert sorted(r.k for r in df.collect()) == list(range(25)) and df.columns == ["k", "v"]
    assert [b.count() for b in flight_batches(spark, flight_server, ("any",), batch_size=7)] == [7, 3, 7, 7, 1]
    assert len(list(flight_batches(spark, flight_server, ("any",), batch_size=7, max_batches=2))) == 2
    cleaned = [out for out, _ in M.StreamingCleaner(drop_duplicates=False).clean_batches(flight_batches(spark, flight_server, ("any",), batch_size=20))]
    assert sorted(r.v for out in cleaned for r in out.collect()) == sorted(f"v{i}" for i in range(25))


def test_json_batches_flush_the_rest(spark):
    from millrace.sources.files import json_batches

    messages = [f'{{"a": {i}}}'.encode() for i in range(23)]
    assert [[r.a for r in b.collect()] for b in json_batches(spark, messages, "a long", batch_size=10)] == [list(range(10)), list(range(10, 20)), [20, 21, 22]]
    assert len(list(json_batches(spark, iter(messages), "a long", batch_size=10, max_batches=1))) == 1


def test_command_line(spark, tmp_path, capsys):
    import json

    from millrace.cli import main

    src, out = str(tmp_path / "in.csv"), str(tmp_path / "out.parquet")
    (tmp_path / "in.csv").write_text("name,email\n a ,x@y.org\n b ,z@y.org\n")
    assert main(["clean", src, out, "--strategy", "conservative", "--mask", "email:redact", "--lineage", str(tmp_path / "run.jsonl"), "--actor", "me", "--quiet"]) == 0
    assert {(r.name, r.email) for r in spark.read.parquet(out).collect()} == {("a", "***"), ("b", "***")} and capsys.readouterr().out == ""
    assert [json.loads(x)["eventType"] for x in (tmp_path / "run.jsonl").read_text().splitlines()] == ["START", "COMPLETE"]
    assert main(["gate", out, "--threshold", "10"]) == 0 and main(["gate", out, "--threshold", "101"]) == 1 and main(["gate", out, "--threshold", "101", "--on-fail", "warn"]) == 0
    capsys.readouterr()
    assert main(["benchmark-stream", out, "--batches", "2"]) == 0 and json.loads(capsys.readouterr().out)["rows"] == 2
    assert main(["trust", out, "--fail-under-trust", "101"]) == 1
