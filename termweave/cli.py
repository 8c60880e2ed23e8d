"""A thin command line: ``python -m termweave.cli query terms.txt kitten -n 2``; ``repl`` reads the same commands line by line.

A dictionary is a file or folder that ``read_terms`` reads; insert, delete and clear write a new one.
"""

from __future__ import annotations

import argparse
import shlex
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.distance import ALGORITHMS
from termweave.operators import dictionary
from termweave.operators.search import FuzzyIndex
from termweave.sources import terms as files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="termweave", exit_on_error=False)
    commands = out.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", help="terms within a distance of a word")
    query.add_argument("dictionary")
    query.add_argument("term")
    query.add_argument("-n", "--distance", type=int, default=2)
    query.add_argument("--algorithm", choices=ALGORITHMS, default=ALGORITHMS[0])
    query.add_argument("--prefix", action="store_true")
    query.add_argument("--limit", type=int)
    for name in ("info", "clear", "minimize"):
        commands.add_parser(name).add_argument("dictionary")
    convert = commands.add_parser("convert", help="write a dictionary in another format")
    convert.add_argument("dictionary")
    convert.add_argument("target")
    convert.add_argument("--to", choices=files.FORMATS)
    for name in ("insert", "delete"):
        edit = commands.add_parser(name)
        edit.add_argument("dictionary")
        edit.add_argument("target", help="where the changed dictionary is written")
        edit.add_argument("terms", nargs="+")
    commands.add_parser("settings", help="formats, algorithms and defaults")
    commands.add_parser("repl", help="read commands from standard input")
    return out


def execute(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Lines of output."""
    read = lambda: files.read_terms(spark, args.dictionary)
    words = lambda: spark.createDataFrame([(t,) for t in args.terms], "term string")
    if args.command == "query":
        asked = FuzzyIndex(read(), args.algorithm).builder(spark.createDataFrame([(args.term,)], "query string")).max_distance(args.distance).ordered()
        asked = asked.prefix() if args.prefix else asked
        return [f"{t}\t{d}" for _, t, d in (asked.limit(args.limit) if args.limit else asked).collect()]
    if args.command == "info":
        return [f"{k}\t{v}" for k, v in dictionary.stats(read()).first().asDict().items()] + [f"format\t{files.detect_content(spark, args.dictionary)}"]
    if args.command == "settings":
        return [f"formats\t{' '.join(files.FORMATS)}", f"algorithms\t{' '.join(ALGORITHMS)}", "distance\t2"]
    if args.command == "convert":
        files.convert(spark, args.dictionary, args.target, target_format=args.to)
        return [args.target]
    if args.command in ("insert", "delete"):
        changed: DataFrame = (dictionary.insert if args.command == "insert" else dictionary.remove)(read().select("term"), words())
        files.write_terms(changed, args.target)
        return [args.target]
    path = args.dictionary.rstrip("/")
    if args.command == "clear":
        files.write_terms(dictionary.clear(read().select("term")), f"{path}.cleared", files.detect_format(path))
        return [f"{path}.cleared"]
    files.write_terms(read().orderBy(F.col("term")), f"{path}.parquet", "parquet")  # minimize: one sorted table
    return [f"{path}.parquet"]


def repl(spark: SparkSession, lines) -> list[str]:
    """Run commands line by line; ``exit`` or ``quit`` ends, a faulty line is reported and skipped."""
    out: list[str] = []
    for line in lines:
        parts = shlex.split(line, comments=True)
        if parts[:1] in (["exit"], ["quit"]):
            break
        if parts:
            try:
                out += execute(spark, parser().parse_args(parts))
            except (argparse.ArgumentError, SystemExit, ValueError) as error:
                out.append(f"error\t{error}")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("termweave").getOrCreate()
    got = repl(spark, sys.stdin) if args.command == "repl" else execute(spark, args)
    sys.stdout.write("".join(f"{x}\n" for x in got))


if __name__ == "__main__":
    main()
