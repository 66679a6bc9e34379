"""python -m lakeloom run WORKFLOW -c CONFIG: run a workflow and print its results."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans.workflow import run_workflow


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lakeloom")
    run = parser.add_subparsers(dest="command", required=True).add_parser("run", help="run a workflow")
    run.add_argument("workflow")
    run.add_argument("-c", "--config", default="lakeloom.yml")
    run.add_argument("-v", "--verbose", action="store_true")
    args = parser.parse_args(argv)
    results = run_workflow(SparkSession.builder.getOrCreate(), args.workflow, args.config, verbose=args.verbose)
    try:
        import yaml

        print(yaml.safe_dump(json.loads(json.dumps(results, default=str)), sort_keys=False))
    except ImportError:
        print(json.dumps(results, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
