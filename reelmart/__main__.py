"""Command line for ``spark-submit``: one sub-command per job."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession

from reelmart import schemas
from reelmart.operators.logs import parse_review_logs
from reelmart.operators.purchases import stage_user_purchase
from reelmart.operators.reviews import classify_reviews
from reelmart.plans.increments import load_increment
from reelmart.plans.warehouse import build_warehouse, load_stage_tables, refresh_at_once
from reelmart.scratch import cleared_scratch
from reelmart.session import build_session
from reelmart.sinks.csv_files import write_csv
from reelmart.sources.csv_files import (
    infer_csv,
    read_log_reviews,
    read_movie_reviews,
    read_user_purchase,
    read_user_purchase_and_rejects,
)
from reelmart.sources.relational import read_relational


_RELATIONAL = ("url", "table", "column", "lower", "upper", "partitions")


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="reelmart")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("parse-logs", "classify-reviews"):
        job = jobs.add_parser(name)
        job.add_argument("input")
        job.add_argument("output")
    purchases = jobs.add_parser("stage-purchases")
    purchases.add_argument("input", nargs="?", help="CSV; or give the --jdbc arguments")
    purchases.add_argument("output")
    tables = jobs.add_parser("load-stage-tables")
    for name in schemas.STAGE_TABLES:
        tables.add_argument(f"--{name.replace('_', '-')}", dest=name, help="staged CSV folder")
    purchases.add_argument("--rejects", help="folder for the records that do not fit, which else fail the job")
    describe = jobs.add_parser("describe-csv", help="names and types of a CSV, and what widened them")
    describe.add_argument("input")
    refresh, increment = jobs.add_parser("refresh"), jobs.add_parser("load-increment")
    refresh.add_argument("--at-once", action="store_true", help="versioned tables, which readers see all or none of")
    for job in (refresh, increment):
        job.add_argument("--logs", required=True)
        job.add_argument("--reviews", required=True)
        job.add_argument("--purchases", help="CSV; or give the --jdbc arguments")
        job.add_argument("--as-of", type=dt.date.fromisoformat)
    for job in (tables, refresh, increment):
        job.add_argument("--database", required=True)
    for job in (purchases, refresh, increment):
        for name in _RELATIONAL:
            kind = int if name == "partitions" else str
            job.add_argument(f"--jdbc-{name}", type=kind, help="purchases from a relational table")
    for name in ("parse-logs", "refresh", "load-increment"):
        jobs.choices[name].add_argument("--date-format", default="yyyy-MM-dd")
        jobs.choices[name].add_argument("--fail-on-malformed", action="store_true")
    for name in ("classify-reviews", "refresh", "load-increment"):
        jobs.choices[name].add_argument("--keyword", default="good")
    for name in ("parse-logs", "classify-reviews", "refresh", "load-increment"):
        jobs.choices[name].add_argument("--fail-on-bad-rows", action="store_true")
    for job in jobs.choices.values():
        job.add_argument("--single-line", action="store_true", help="no field holds a line break")
    return parser


def _purchases(spark: SparkSession, args: argparse.Namespace, path: str | None) -> DataFrame:
    """The purchase lines from the CSV, or from the relational table if one is named."""
    if not args.jdbc_url:
        if not path:
            raise SystemExit("purchases: a CSV or the --jdbc arguments are needed")
        return read_user_purchase(spark, path, multiline=not args.single_line)
    given = {name: getattr(args, f"jdbc_{name}") for name in _RELATIONAL}
    missing = [f"--jdbc-{name}" for name, value in given.items() if value is None]
    if missing:
        raise SystemExit(f"purchases: {', '.join(missing)} missing")
    return read_relational(spark, **given)


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    multiline = {"multiline": not args.single_line}
    if args.job == "load-stage-tables":
        given = {name: getattr(args, name) for name in schemas.STAGE_TABLES if getattr(args, name)}
        load_stage_tables(spark, args.database, given, **multiline)
        return
    if args.job == "describe-csv":
        _describe(spark, args.input)
        return
    if args.job == "stage-purchases" and args.rejects:
        if not args.input:
            raise SystemExit("stage-purchases: --rejects needs a CSV")
        good, rejects = read_user_purchase_and_rejects(spark, args.input)
        write_csv(stage_user_purchase(good), args.output)
        write_csv(rejects, args.rejects)
        return
    if args.job == "stage-purchases":
        write_csv(stage_user_purchase(_purchases(spark, args, args.input)), args.output)
        return
    options = {**multiline, "fail_on_bad_rows": args.fail_on_bad_rows}
    if args.job == "parse-logs":
        raw = read_log_reviews(spark, args.input, **options)
        report = Observation()
        rows = parse_review_logs(raw, args.date_format, args.fail_on_malformed, report)
        write_csv(rows, args.output, trim=True)
        _print_report(report.get)
    elif args.job == "classify-reviews":
        raw = read_movie_reviews(spark, args.input, **options)
        write_csv(classify_reviews(raw, args.keyword), args.output, trim=True)
    else:
        if args.job == "load-increment":
            load = load_increment
        else:
            load = refresh_at_once if args.at_once else build_warehouse
        report = load(
            spark,
            args.database,
            read_log_reviews(spark, args.logs, **options),
            read_movie_reviews(spark, args.reviews, **options),
            _purchases(spark, args, args.purchases),
            args.as_of,
            args.keyword,
            args.date_format,
            args.fail_on_malformed,
        )
        _print_report(report)


def _describe(spark: SparkSession, path: str) -> None:
    found = infer_csv(spark, path)
    for field in found.schema.fields:
        print(f"{field.name}: {field.dataType.simpleString()}")
    for w in found.widenings:
        print(f"{w.column} from {w.before} to {w.after} by line {w.line}, byte {w.offset} of {w.file}")


def _print_report(counts: dict[str, int]) -> None:
    for name, count in counts.items():
        print(f"{name}: {count}")


def main(argv: list[str] | None = None) -> None:
    args = _arguments().parse_args(argv)
    spark = build_session(f"reelmart {args.job}")
    with cleared_scratch(spark):
        _run(spark, args)


if __name__ == "__main__":
    main()
