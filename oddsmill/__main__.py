"""Command line: ``python -m oddsmill validate CONFIG | init LEVEL/NAME PATH | list-runs LOG | run-info LOG RUN | run QUERY DIR | version``."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="oddsmill")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("validate", help="check a configuration")
    one.add_argument("config")
    one = commands.add_parser("init", help="write a template")
    one.add_argument("template")
    one.add_argument("path")
    one = commands.add_parser("list-runs", help="the latest runs of a log")
    one.add_argument("log")
    one.add_argument("--status")
    one.add_argument("--limit", type=int, default=20)
    one = commands.add_parser("run-info", help="fields and steps of a run")
    one.add_argument("log")
    one.add_argument("run")
    one = commands.add_parser("run", help="print the first rows of a registered query")
    one.add_argument("query")
    one.add_argument("dir")
    one.add_argument("--rows", type=int, default=20)
    commands.add_parser("version")
    a = parser.parse_args(argv)

    if a.command == "version":
        print(__version__)
        return 0
    from .sources import config

    if a.command == "validate":
        try:
            config.load(a.config)
        except (ValueError, OSError) as e:
            print(e, file=sys.stderr)
            return 1
        print("valid")
        return 0
    if a.command == "init":
        config.dump(config.template(*a.template.split("/", 1)), a.path)
        return 0

    from .operators import governance
    from .plans.execution import session

    spark = session()
    if a.command == "run":
        from .plans import more_queries  # noqa: F401  registers its queries
        from .plans.queries import QUERIES

        if a.query not in QUERIES:
            print(f"unknown query: {a.query}", file=sys.stderr)
            return 1
        QUERIES[a.query](spark, a.dir).show(a.rows, truncate=False)
        return 0
    log = spark.read.schema(governance.EVENT_SCHEMA).parquet(a.log)
    if a.command == "list-runs":
        governance.list_runs(governance.runs_of(log), a.status, limit=a.limit).show(a.limit, truncate=False)
        return 0
    fields = {r["field"]: r["value"] for r in governance.recorded(log, "run").where(f"id = '{a.run.replace(chr(39), chr(39) * 2)}'").collect()}
    print(json.dumps(fields, sort_keys=True, indent=2))
    governance.steps_of(log, a.run).orderBy("started").show(truncate=False)
    return 0 if fields else 1


if __name__ == "__main__":
    sys.exit(main())
