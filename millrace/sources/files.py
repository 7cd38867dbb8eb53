"""Readers and writers by suffix: Parquet, CSV, JSON, ORC, Arrow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".orc": "orc", ".feather": "arrow", ".arrow": "arrow", ".ipc": "arrow"}


def format_of(path: str, given: str | None = None) -> str:
    if given:
        return given
    name = path.rstrip("/").lower().removesuffix(".gz")
    for suffix, kind in FORMATS.items():
        if name.endswith(suffix):
            return kind
    return "parquet"


def _separator(path: str) -> str:
    return "\t" if path.rstrip("/").lower().removesuffix(".gz").endswith(".tsv") else ","


def read_table(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """CSV cells are read as text: cleaning decides their types. Arrow files come in through the driver."""
    kind = format_of(path, format)
    if kind == "csv":
        return spark.read.options(header=True, inferSchema=False, sep=_separator(path), **options).csv(path)
    if kind in ("json", "jsonl"):
        return spark.read.options(multiLine=kind == "json", **options).json(path)
    if kind == "arrow":
        import pyarrow.feather as feather

        return spark.createDataFrame(feather.read_table(path))
    return spark.read.options(**options).format(kind).load(path)


def write_table(df: DataFrame, path: str, format: str | None = None, mode: str = "overwrite") -> None:
    kind = format_of(path, format)
    if kind == "csv":
        df.write.mode(mode).options(header=True, sep=_separator(path)).csv(path)
    else:
        df.write.mode(mode).format("json" if kind in ("json", "jsonl") else kind).save(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A warehouse table; pass partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def flight_batches(spark: SparkSession, location: str, path: tuple[str, ...] = (), *, batch_size: int = 10_000, max_batches: int | None = None) -> Iterator[DataFrame]:
    """Batches of an Arrow Flight stream in turn, as for ``StreamingCleaner.clean_batches``; the last one may be smaller."""
    for n, (table, start) in enumerate((t, s) for t in _flight_tables(location, path) for s in range(0, t.num_rows, batch_size)):
        if n == max_batches:
            return
        yield spark.createDataFrame(table.slice(start, batch_size))


def _flight_tables(location: str, path: tuple[str, ...]) -> Iterator:
    from pyarrow import Table, flight

    client = flight.connect(location)
    info = client.get_flight_info(flight.FlightDescriptor.for_path(*path))
    for endpoint in info.endpoints:
        for chunk in client.do_get(endpoint.ticket):
            yield Table.from_batches([chunk.data])


def read_flight(spark: SparkSession, location: str, path: tuple[str, ...] = ()) -> DataFrame:
    """An Arrow Flight table, its endpoints read in parallel: a task each, at the endpoint's own location where it names one."""
    from pyarrow import flight

    info = flight.connect(location).get_flight_info(flight.FlightDescriptor.for_path(*path))
    tickets = [(e.ticket.ticket, e.locations[0].uri.decode() if e.locations else location) for e in info.endpoints]

    def read(batches):
        from pyarrow import flight

        for batch in batches:
            for ticket, place in zip(batch.column("ticket").to_pylist(), batch.column("place").to_pylist()):
                for chunk in flight.connect(place).do_get(flight.Ticket(ticket)):
                    yield chunk.data

    schema = spark.createDataFrame(info.schema.empty_table()).schema
    return spark.createDataFrame(tickets, "ticket binary, place string").repartition(max(1, len(tickets))).mapInArrow(read, schema)


def json_batches(spark: SparkSession, messages: Iterable[str | bytes], schema: str, *, batch_size: int = 10_000, max_batches: int | None = None) -> Iterator[DataFrame]:
    """Batches of JSON messages, as a Kafka consumer gives them; what is left at the end is a last, smaller batch."""
    messages, n = iter(messages), 0
    while (max_batches is None or n < max_batches) and (part := [(m.decode() if isinstance(m, bytes) else m,) for m in islice(messages, batch_size)]):
        n += 1
        yield spark.createDataFrame(part, "value string").select(F.from_json("value", schema).alias("x")).select("x.*")


def register(df: DataFrame, name: str) -> DataFrame:
    """A temporary view, for SQL over a cleaned table."""
    df.createOrReplaceTempView(name)
    return df
