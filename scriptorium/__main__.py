"""``python -m scriptorium collect | stylometry | typo``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import commands, reports


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scriptorium")
    kinds = top.add_subparsers(dest="command", required=True)
    one = kinds.add_parser("collect", help="samples of one's own writing from mail or letters")
    one.add_argument("adapter", help="mbox, applemail, folder or detect")
    one.add_argument("source", nargs="?")
    for name in ("tag", "out", "lang", "since", "surface"):
        one.add_argument(f"--{name}")
    listed = {"type": lambda v: v.split(","), "action": "extend", "default": []}
    one.add_argument("--me", **listed)
    one.add_argument("--author", **listed)
    one.add_argument("--not", dest="unlike", **listed)
    two = kinds.add_parser("stylometry", help="measures of samples, and exemplars")
    two.add_argument("inputs", nargs="+")
    for name in ("lang", "out", "registers"):
        two.add_argument(f"--{name}")
    three = kinds.add_parser("typo", help="typographic characters of files")
    three.add_argument("targets", nargs="+")
    three.add_argument("--fix", action="store_true")
    three.add_argument("--lang")
    three.add_argument("--profile", help="the profile to go by")
    three.add_argument("--profile-name", default=reports.PROFILE_NAME, help="the name of the files that are looked for above the target")
    return top


def run(arguments: list[str], spark: SparkSession | None = None, say=print, complain=lambda text: print(text, file=sys.stderr)) -> int:
    try:
        options = parser().parse_args(arguments)
    except SystemExit as stop:
        return 1 if stop.code else 0
    spark = spark or SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return getattr(commands, options.command)(spark, options, say, complain)


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
