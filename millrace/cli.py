"""Command line: clean, profile, trust, gate, stream, stream-kafka, benchmark-stream."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import asdict

from pyspark.sql import SparkSession

from .api import clean, profile
from .enterprise.cluster import ClusterConfig
from .enterprise.interface import EnterpriseConfig, clean_enterprise
from .enterprise.mask import MaskingRule
from .enterprise.trust import compute_trust_score
from .integrations import evaluate_trust_gate, gate_manifest
from .sources.files import read_table, write_table
from .streaming.cleaner import StreamingCleaner, file_stream, kafka_json


def load_options(path: str | None) -> dict:
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f) or {}
        return json.load(f)


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="millrace")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, says in (("clean", "clean a table"), ("profile", "describe a table"), ("trust", "score a table"), ("gate", "pass or fail a table by its trust"), ("stream", "clean files as a stream"), ("stream-kafka", "clean JSON messages as a stream"), ("benchmark-stream", "time batches of a table")):
        p = sub.add_parser(name, help=says)
        p.add_argument("input", help="path; for stream-kafka the servers")
        p.add_argument("--in-format")
        p.add_argument("--config", help="YAML or JSON file with options")
        p.add_argument("--fail-under-trust", type=float)
        if name in ("clean", "stream", "stream-kafka"):
            p.add_argument("output")
            p.add_argument("--out-format")
            p.add_argument("--strategy", default="balanced")
            p.add_argument("--report")
        if name == "clean":
            p.add_argument("--domain")
            p.add_argument("--mask", action="append", default=[], metavar="COL:STRATEGY")
            p.add_argument("--cluster", action="append", default=[], metavar="COL")
            p.add_argument("--lineage", help="write run events here")
            p.add_argument("--actor")
            p.add_argument("--quiet", action="store_true")
        if name == "gate":
            p.add_argument("--threshold", type=float, default=80.0)
            p.add_argument("--on-fail", choices=("fail", "warn", "skip"), default="fail")
            p.add_argument("--manifest", action="store_true", help="the input is a dbt manifest")
            p.add_argument("--select", nargs="*", default=[])
            p.add_argument("--audit-dir")
        if name in ("stream", "stream-kafka"):
            p.add_argument("--checkpoint", required=True)
        if name == "stream-kafka":
            p.add_argument("--topic", required=True)
            p.add_argument("--schema", required=True)
        if name == "benchmark-stream":
            p.add_argument("--batches", type=int, default=4)
    return parser


def _clean(spark: SparkSession, args: argparse.Namespace, options: dict) -> int:
    df = read_table(spark, args.input, args.in_format)
    options |= {"strategy": args.strategy}
    if args.mask or args.cluster or args.lineage or args.actor:
        masks = tuple(MaskingRule(f"cli{i}", columns=(m.rpartition(":")[0],), strategy=m.rpartition(":")[2]) for i, m in enumerate(args.mask))
        enterprise = EnterpriseConfig(actor=args.actor, masking=masks, enable_clustering=bool(args.cluster), clustering=ClusterConfig(columns=tuple(args.cluster)) if args.cluster else None)
        result = clean_enterprise(df, enterprise, **options)
        df, report = result.frame, result.report
        if args.lineage and result.lineage is not None:
            result.lineage.write(args.lineage)
    else:
        df, report = clean(df, return_report=True, **options | ({"domain": args.domain} if args.domain else {}))
    write_table(df, args.output, args.out_format)
    if args.report:
        with open(args.report, "w", encoding="utf-8") as f:
            f.write(report.to_json())
    if not args.quiet:
        print(report.summary())
    return int(args.fail_under_trust is not None and compute_trust_score(df).overall < args.fail_under_trust)


def _gate(spark: SparkSession, args: argparse.Namespace, options: dict) -> int:
    if args.manifest:
        results = gate_manifest(spark, args.input, args.threshold, tuple(args.select), args.audit_dir, on_fail=args.on_fail, **options)
    else:
        results = {args.input: evaluate_trust_gate(read_table(spark, args.input, args.in_format), args.threshold, on_fail=args.on_fail, **options)[1]}
    print(json.dumps({name: r.to_dict() for name, r in results.items()}, indent=2))
    return int(not all(r.passed for r in results.values()))


def _stream(spark: SparkSession, args: argparse.Namespace, options: dict) -> int:
    cleaner = StreamingCleaner(strategy=args.strategy, fail_under_trust=args.fail_under_trust, **options)
    if args.command == "stream":
        source = file_stream(spark, args.input, read_table(spark, args.input, args.in_format).schema)
    else:
        source = kafka_json(spark, args.input, args.topic, args.schema)
    cleaner.clean_stream(source, args.output, args.checkpoint).awaitTermination()
    print(json.dumps(cleaner.finalize(), default=str))
    return 0


def _benchmark(spark: SparkSession, args: argparse.Namespace, options: dict) -> int:
    cleaner, took = StreamingCleaner(**options), []
    for part in read_table(spark, args.input, args.in_format).randomSplit([1.0] * args.batches, 0):
        began = time.time()
        cleaner.clean_batch(part)[0].write.format("noop").mode("overwrite").save()
        took.append(round(time.time() - began, 3))
    print(json.dumps({"batches": took, "rows": cleaner.rows, "rows_per_second": round(cleaner.rows / max(sum(took), 1e-9), 1)}))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    options = load_options(args.config)
    run = {"clean": _clean, "gate": _gate, "stream": _stream, "stream-kafka": _stream, "benchmark-stream": _benchmark}.get(args.command)
    if run:
        return run(spark, args, options)
    df = read_table(spark, args.input, args.in_format)
    if args.command == "profile":
        print(json.dumps(profile(df, **options).to_dict(), default=str, indent=2))
        return 0
    trust = compute_trust_score(df)
    print(json.dumps(asdict(trust) | {"grade": trust.grade}, indent=2))
    return int(args.fail_under_trust is not None and trust.overall < args.fail_under_trust)


if __name__ == "__main__":
    sys.exit(main())
