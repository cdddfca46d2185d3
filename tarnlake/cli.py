"""Command line: ``python -m tarnlake.cli --warehouse FOLDER list|describe|head|stats|sql|serve``; settings also come from the environment."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tarnlake.services import Tools, check_config, config_from_env
from tarnlake.session import Lake


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="tarnlake", description=__doc__)
    made.add_argument("--warehouse", help="folder of the tables")
    kinds = made.add_subparsers(dest="command", required=True)
    kinds.add_parser("list", help="tables of a namespace").add_argument("namespace", nargs="?", default="default")
    for name, text in (("describe", "columns and partitions of a table"), ("stats", "snapshots, files and rows of a table")):
        kinds.add_parser(name, help=text).add_argument("table")
    head = kinds.add_parser("head", help="first rows of a table")
    head.add_argument("table")
    head.add_argument("-n", type=int, default=5)
    kinds.add_parser("sql", help="run a statement").add_argument("text")
    kinds.add_parser("serve", help="answer tool requests, a line of JSON each, from standard input")
    return made


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out=print, lines=None) -> int:
    given = parser().parse_args(arguments)
    config = config_from_env() | ({"warehouse": given.warehouse} if given.warehouse else {})
    try:
        check_config(config)
        lake = Lake(spark or SparkSession.builder.getOrCreate(), config["warehouse"])
        if given.command == "list":
            names = lake.list_tables(given.namespace)
            out("\n".join(names) if names else f"no tables in {given.namespace}")
        elif given.command == "describe":
            table = lake.open(given.table)
            for f in table.meta["fields"]:
                out(f"{f['id']}\t{f['name']}\t{f['type'] if isinstance(f['type'], str) else json.dumps(f['type'])}\t{'required' if f['required'] else ''}")
            for s in table.meta["spec"]:
                out(f"partition\t{s['name']}\t{s['transform']}\t{s['column']}")
        elif given.command == "stats":
            out(json.dumps(lake.stats(given.table), indent=1, default=str))
        elif given.command == "head":
            for r in lake.head(given.table, given.n).collect():
                out(json.dumps(r.asDict(True), default=str))
        elif given.command == "sql":
            for r in lake.capped(lake.sql(given.text))[0]:
                out(json.dumps(r, default=str))
        else:
            Tools(lake).serve(lines if lines is not None else sys.stdin, lambda x: out(x))
    except Exception as e:  # noqa: BLE001 - a message instead of a trace
        print(f"tarnlake: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
