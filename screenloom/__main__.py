"""Command line: ``python -m screenloom process|prep CONFIG.yaml key=value...``; the other commands take tables and are functions of plans.runs."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from screenloom.plans import config, runs

COMMANDS = {"process": (config.Process, runs.run_process), "prep": (config.Prep, runs.run_prep)}


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in COMMANDS:
        print(__doc__)
        return 2
    kind, run = COMMANDS[args[0]]
    cfg = config.strict(kind, config.compose(config.read_yaml(args[1]), (), args[2:]))
    print(run(SparkSession.builder.getOrCreate(), cfg))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
