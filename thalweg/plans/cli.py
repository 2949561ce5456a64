"""Command line: `route --router R config`, or a router's name and a configuration."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from thalweg.plans.routers import ROUTERS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="thalweg", description="Muskingum river routing on Spark")
    commands = p.add_subparsers(dest="command")
    route = commands.add_parser("route", help="route with a router of choice")
    route.add_argument("config")
    route.add_argument("--router", required=True, choices=sorted(ROUTERS))
    for name, router in ROUTERS.items():
        commands.add_parser(name, help=router.__doc__.splitlines()[0]).add_argument("config")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    found = parser().parse_args(args)
    if not found.command:
        parser().print_help()
        return 1
    router = ROUTERS[found.router if found.command == "route" else found.command]
    router(spark or SparkSession.builder.appName("thalweg").getOrCreate(), found.config).route()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
