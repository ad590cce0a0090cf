"""The command line: python -m kvern.cli --join no-partitioning ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from kvern.config import FORMATS, OUTPUTS, Join, JoinSpec, OutputSpec, Unit
from kvern.log import LEVELS, configure, get_logger
from kvern.plans.report import render
from kvern.plans.runner import run_join


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kvern", description="Joins two generated relations and reports how long the phases took.")
    p.add_argument("--primary", type=int, default=10_000_000, help="rows of the build relation")
    p.add_argument("--secondary", type=int, default=200_000_000, help="rows of the probe relation")
    p.add_argument("--skew", type=float, default=1.05, help="skew of the foreign keys")
    p.add_argument("--log", choices=LEVELS, default="debug")
    p.add_argument("--join", choices=[j.value for j in Join], required=True)
    p.add_argument("--format", choices=FORMATS, default="json")
    p.add_argument("-u", "--unit", choices=[u.value for u in Unit], default="ms")
    p.add_argument("-o", "--output", choices=OUTPUTS, default="file")
    p.add_argument("-f", "--filename", default="hashjoin.txt")
    p.add_argument("-p", "--partitions", type=int, help="radix join only; 32 unless given")
    p.add_argument("--seed", type=int, help="of the foreign keys")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if not e.code else 1
    configure(args.log)
    log = get_logger("join")
    try:
        spec = JoinSpec(args.join, args.primary, args.secondary, args.skew, args.partitions, args.seed)
        output = OutputSpec(args.filename, args.format, args.output, args.unit)
        report = run_join(SparkSession.builder.appName("kvern").getOrCreate(), spec)
        render(report, output)
    except Exception as e:  # the command's boundary: any failure is exit code 1
        log.error("%s", e)
        return 1
    log.about("secondary").info("%s: %d of %d probe rows matched", spec.join, report.matched, spec.secondary)
    return 0


if __name__ == "__main__":
    sys.exit(main())
