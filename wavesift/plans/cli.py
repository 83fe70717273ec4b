"""Command line: run a parameter file, inspect a result, write a template.

    python -m wavesift.plans.cli run pars.json out_folder
    python -m wavesift.plans.cli inspect out_folder
    python -m wavesift.plans.cli template
"""

from __future__ import annotations

import argparse
import json
import sys

from wavesift.plans.params import Param, engine_schema, from_json, from_yaml
from wavesift.plans.reconstruct import Reconstruction
from wavesift.plans.session import session


def template() -> Param:
    """Default parameters with one engine."""
    schema = engine_schema()
    out = schema.defaults()
    out.engines = Param(engine00=schema.defaults(entry=schema.at("engines.*")))
    return out


def overridden(pars: Param, changes: list[str]) -> Param:
    """``pars`` with entries of the form path=json value replaced."""
    for change in changes:
        path, _, value = change.partition("=")
        pars[path] = json.loads(value)
    return pars


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wavesift", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("file")
    run.add_argument("out")
    run.add_argument("--set", action="append", default=[], metavar="PATH=JSON")
    run.add_argument("--master")
    inspect = commands.add_parser("inspect")
    inspect.add_argument("path")
    inspect.add_argument("--master")
    commands.add_parser("template")
    args = parser.parse_args(argv)
    if args.command == "template":
        print(json.dumps(template().to_dict(), indent=2))
        return 0
    spark = session(args.master)
    if args.command == "inspect":
        for part in ("content", "iter_info", "params"):
            print(part)
            spark.read.parquet(f"{args.path}/{part}").printSchema()
        return 0
    pars = (from_yaml if args.file.endswith((".yml", ".yaml")) else from_json)(args.file)
    r = Reconstruction(spark, overridden(pars, args.set))
    r.save(args.out)
    r.iter_info().show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
