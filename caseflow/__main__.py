"""Command line for the jobs: ``spark-submit ... -m caseflow`` style arguments."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from caseflow import sources as src
from caseflow.plans import jobs
from caseflow.schema import CANON, ENRICHED
from caseflow.session import configure


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="caseflow")
    commands = parser.add_subparsers(dest="job", required=True)

    def command(name: str, *required: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for option in required:
            sub.add_argument(f"--{option}", required=True)
        return sub

    load = command("load", "wide", "long", "single", "single-country", "out")
    load.add_argument("--tags", nargs=3, default=["WIDE", "LONG", "SINGLE"])
    load.add_argument("--wide-deaths", help="wide file of deaths")
    load.add_argument("--wide-recovered", help="wide file of recoveries")
    offload = command("offload", "cases", "format")
    offload.add_argument("--option", action="append", default=[], help="key=value")
    export = command("export", "cases", "out")
    export.add_argument("--max-files", type=int)
    compact = command("compact", "source", "target")
    compact.add_argument("--max-files", type=int)
    for name in ("enrich", "reports", "explore"):
        sub = command(name, "out")
        sub.add_argument("--cases", help="Parquet folder")
        sub.add_argument("--format", help="read a document collection instead")
        sub.add_argument("--option", action="append", default=[], help="key=value")
        if name == "reports":
            sub.add_argument("--exclude", help="CSV of names to leave out of the cumulative reports")
    command("dashboard", "enriched", "names", "out")
    return parser


def _options(args: argparse.Namespace) -> dict[str, str]:
    return dict(pair.split("=", 1) for pair in args.option)


def _cases(spark: SparkSession, args: argparse.Namespace):
    if args.format:
        return src.read_documents(spark, args.format, _options(args), CANON)
    return src.read_parquet(spark, args.cases, CANON)


def _names(spark: SparkSession, path: str):
    """A table of names; the first column is the one that counts."""
    table = src.read_csv_strings(spark, path, escaped=False)
    return table.select(table[0].alias("name"))


def main(argv: list[str] | None = None) -> None:
    args = _arguments().parse_args(argv)
    spark = configure(SparkSession.builder.appName(f"caseflow {args.job}")).getOrCreate()
    if args.job == "load":
        jobs.load(
            spark, wide=args.wide, long=args.long, single=args.single,
            single_country=args.single_country, out=args.out, tags=tuple(args.tags),
            wide_deaths=args.wide_deaths, wide_recovered=args.wide_recovered,
        )
    elif args.job == "offload":
        jobs.offload(spark, cases=args.cases, fmt=args.format, options=_options(args))
    elif args.job == "export":
        jobs.export_jsonl(spark, cases=args.cases, out=args.out, max_files=args.max_files)
    elif args.job == "compact":
        src.compact_jsonl(spark, args.source, args.target, max_files=args.max_files)
    elif args.job == "enrich":
        jobs.enrich(_cases(spark, args), out=args.out)
    elif args.job == "reports":
        jobs.reports(_cases(spark, args), out=args.out, exclude=_names(spark, args.exclude) if args.exclude else None)
    elif args.job == "explore":
        jobs.explore(_cases(spark, args), out=args.out)
    elif args.job == "dashboard":
        jobs.dashboard(src.read_parquet(spark, args.enriched, ENRICHED), _names(spark, args.names), out=args.out)


if __name__ == "__main__":
    main()
