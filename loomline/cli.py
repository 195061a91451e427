"""Command line: run a study on files, clean nothing implicitly, exit non-zero on failure."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from loomline.functions import configs
from loomline.plans import study
from loomline.sources import runs, wide


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loomline", description="Daily panel analytics on Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="full study on wide or long files")
    run.add_argument("--attention", required=True)
    run.add_argument("--returns", required=True)
    run.add_argument("--risk-free")
    run.add_argument("--config")
    run.add_argument("--out", required=True)
    run.add_argument("--run-id")
    show = commands.add_parser("show", help="metrics of a finished run")
    show.add_argument("--out", required=True)
    show.add_argument("--run-id", required=True)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    spark = SparkSession.builder.appName("loomline").getOrCreate()
    try:
        if args.command == "show":
            runs.read_run(spark, args.out, args.run_id)["metrics"].orderBy("name").show(200, False)
            return 0
        cfg = configs.load(study.StudyConfig, args.config) if args.config else study.StudyConfig()
        data = wide.load_inputs(spark, args.attention, args.returns, args.risk_free)
        result = study.run_study(data["attention"], data["returns"], cfg, data.get("risk_free"))
        tables = study.model_tables(result) | {"metrics": study.report(result, cfg)}
        runs.write_run(spark, args.out, args.run_id or configs.settings_hash(cfg), tables, configs.to_dict(cfg))
        return 0
    except (ValueError, LookupError, OSError) as problem:
        print(f"loomline: {problem}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
