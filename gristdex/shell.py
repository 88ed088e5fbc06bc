"""Command line: ``python -m gristdex.shell [--catalog FILE] [-c SCRIPT]``; without ``-c`` it reads standard input."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from gristdex.engine import Engine
from gristdex.functions.keywords import KeywordRules
from gristdex.sources.catalog import load_catalog
from gristdex.sources.export import error_line
from gristdex.sources.tables import open_index

HISTORY = "~/.gristdex_history"


def interactive(engine: Engine) -> None:
    """Reads statements line by line with history; a statement may span lines."""
    try:
        import readline
    except ImportError:
        readline = None
    history = os.path.expanduser(HISTORY)
    if readline and os.path.exists(history):
        readline.read_history_file(history)
    held = ""
    while True:
        try:
            held += input("... " if held else "> ") + "\n"
        except (EOFError, KeyboardInterrupt):
            break
        if held.rstrip().endswith(";"):
            for line in engine.run(held):
                print(line)
            held = ""
    if readline:
        readline.write_history_file(history)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gristdex")
    parser.add_argument("--catalog", default="catalog.tsv")
    parser.add_argument("--keywords", help="YAML file of ephemeral and timestamped keywords")
    parser.add_argument("--parallel", type=int, help="accepted; the cluster decides")
    parser.add_argument("-c", dest="script")
    args = parser.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("gristdex").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rules = KeywordRules.parse(Path(args.keywords).read_text()) if args.keywords and Path(args.keywords).exists() else KeywordRules()
    try:
        engine = Engine(open_index(spark, load_catalog(spark, args.catalog), rules))
    except Exception as e:  # noqa: BLE001 - shown as a result
        print(error_line(e))
        return 1
    if args.script is not None:
        script = args.script if args.script.rstrip().endswith(";") else args.script + ";"
        for line in engine.run(script):
            print(line)
    elif sys.stdin.isatty():
        interactive(engine)
    else:
        for line in engine.run(sys.stdin.read()):
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
