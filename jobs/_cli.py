"""What the command lines share: a JSON config whose entries can be overridden by options, a session, logging."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from codeatlas import session

FORMAT = "%(asctime)s %(levelname)s %(name)s %(message)s"


def main(name: str, description: str, run: Callable[..., dict], options: dict[str, type], argv: list[str] | None = None) -> dict:
    """Reads the config, starts a session, runs, stops it. options: names of run's arguments and their types; None in the config counts as not given."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=description)
    parser.add_argument("--config", help=f"JSON file, such as jobs/{name}.json")
    for option, kind in options.items():
        parser.add_argument(f"--{option.replace('_', '-')}", type=kind)
    given = vars(parser.parse_args(argv))
    path = given.pop("config")
    config = {}
    if path:
        with open(path) as f:
            config = json.load(f)
    unknown = set(config) - set(options)
    if unknown:
        parser.error(f"unknown entries in {path}: {', '.join(sorted(unknown))}")
    config = {k: v for k, v in (config | {k: v for k, v in given.items() if v is not None}).items() if v is not None}
    logging.basicConfig(level=logging.INFO, format=FORMAT)
    spark = session.builder(f"codeatlas-{name}").getOrCreate()
    try:
        return run(spark, **config)
    finally:
        spark.stop()
