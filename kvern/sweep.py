"""The sweep: python -m kvern.sweep --path results ...; a JSON file for each run, and a table of all phases."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from kvern.plans.report import sweep_table, timings, to_json
from kvern.plans.runner import SWEEP, sweep


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kvern.sweep", description=__doc__)
    p.add_argument("-p", "--path", type=Path, default=Path("results"))
    p.add_argument("-s", "--skew", type=float, default=1.05)
    p.add_argument("--primary", type=int, default=10_000_000)
    p.add_argument("--secondary", type=int, default=200_000_000)
    p.add_argument("--partitions", type=int, nargs="+", default=SWEEP)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("kvern sweep").getOrCreate()
    reports = sweep(spark, args.primary, args.secondary, args.skew, args.partitions)
    args.path.mkdir(parents=True, exist_ok=True)
    for report in reports:
        (args.path / f"partitions_{report.parameters.get('NumberOfPartitions', 1)}.txt").write_text(to_json(report))
    names = ["NoPartitioning", *(f"Radix{n}" for n in args.partitions)]
    rows = {r["phase"]: r for r in sweep_table(timings(spark, reports), names).collect()}  # three rows
    lines = [" ".join(["NumberOfPartitions", *names]), *(" ".join([p, *(str(rows[p][n]) for n in names)]) for p in ("Partition", "Build", "Probe"))]
    (args.path / "figure.dat").write_text("\n".join(lines) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
