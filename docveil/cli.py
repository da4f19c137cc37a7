"""Command line: run PATH..., start, config get filesdir, config set filesdir FOLDER."""

from __future__ import annotations

import argparse
import json
import os
import sys

CONFIG = os.path.expanduser("~/.docveil.json")
KEYS = ("filesdir",)


def settings(path: str = CONFIG) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def set_setting(key: str, value: str, path: str = CONFIG) -> bool:
    """Writes the one setting, with environment variables expanded, in place of the whole file; unknown keys change nothing."""
    if key not in KEYS:
        return False
    with open(path, "w", encoding="utf-8") as f:
        json.dump({key: os.path.expandvars(value)}, f)
    return True


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("docveil").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docveil")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("run").add_argument("paths", nargs="+")
    commands.add_parser("start").add_argument("--checkpoint", default=os.path.expanduser("~/.docveil-checkpoint"))
    config = commands.add_parser("config").add_subparsers(dest="action", required=True)
    config.add_parser("get").add_argument("key")
    setter = config.add_parser("set")
    setter.add_argument("key")
    setter.add_argument("value")
    args = parser.parse_args(argv)
    if args.command == "config":
        if args.action == "get":
            if args.key in KEYS:
                print(settings().get(args.key, ""))
        else:
            set_setting(args.key, args.value)
        return 0
    if args.command == "run":
        from docveil.plans.pipeline import run

        missing = [p for p in args.paths if not os.path.exists(p)]
        if missing:
            parser.error(f"no such file or folder: {', '.join(missing)}")
        print(json.dumps(run(session(), args.paths)))
        return 0
    from docveil.streaming.watch import start

    query = start(session(), settings().get("filesdir"), args.checkpoint)
    if query is not None:
        query.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
