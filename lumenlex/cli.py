"""Command line: ingest, show-shard, gen-works-subset, build-posting, query."""

from __future__ import annotations

import argparse
import tomllib

from pyspark.sql import SparkSession

from lumenlex.plans import ingest as jobs
from lumenlex.sources import works as io


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenlex", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("ingest", help="compact and check raw shards")
    c.add_argument("--entity", default="works", choices=sorted(jobs.Entity.registry))
    c.add_argument("--raw", required=True)
    c.add_argument("--compact", required=True)
    c.add_argument("--manifest", help="JSON manifest whose record counts the shards must have")
    c.add_argument("--report", help="folder of the log and report tables")
    c.add_argument("--forced-fetch", action="store_true", help="work on shards again that are done")
    c = commands.add_parser("show-shard", help="the first records of a shard")
    c.add_argument("--path", required=True)
    c.add_argument("--n", type=int, default=5)
    c = commands.add_parser("gen-works-subset", help="cut a subset by a profile's condition and check it")
    c.add_argument("--compact", required=True)
    c.add_argument("--subset", required=True)
    c.add_argument("--condition")
    c.add_argument("--config", help="TOML file with [works-subset.subset-profiles]")
    c.add_argument("--profile", default="full-en")
    c = commands.add_parser("build-posting", help="build the index of a subset")
    c.add_argument("--works", required=True)
    c.add_argument("--index", required=True)
    c.add_argument("--k1", type=float, default=1.2)
    c.add_argument("--b", type=float, default=0.75)
    c.add_argument("--block-size", type=int, default=128)
    c.add_argument("--no-stem", action="store_true")
    c = commands.add_parser("query", help="the k best documents for a query")
    c.add_argument("--index", required=True)
    c.add_argument("--query", required=True)
    c.add_argument("--k", type=int, default=10)
    c.add_argument("--exhaustive", action="store_true")
    return top


def condition_of(args: argparse.Namespace) -> str:
    if args.condition:
        return args.condition
    if not args.config:
        raise SystemExit("give --condition, or --config and --profile")
    with open(args.config, "rb") as f:
        return tomllib.load(f)["works-subset"]["subset-profiles"][args.profile]


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"lumenlex {args.command}").getOrCreate()
    if args.command == "ingest":
        print(jobs.ingest(spark, args.entity, args.raw, args.compact, args.manifest, args.report, args.forced_fetch))
    elif args.command == "show-shard":
        io.show_shard(spark, args.path, args.n).show(args.n, truncate=False, vertical=True)
    elif args.command == "gen-works-subset":
        print(jobs.make_subset(spark, args.compact, args.subset, condition_of(args)))
    elif args.command == "build-posting":
        jobs.build_index(spark, args.works, args.index, args.k1, args.b, args.block_size, not args.no_stem)
    else:
        for row in jobs.run_query(spark, args.index, args.query, args.k, args.exhaustive).collect():
            print(row["raw_id"], row["score"])


if __name__ == "__main__":
    main()
