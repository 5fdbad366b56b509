"""python -m cueforge dub FILE | batch GLOB [--output FOLDER] [--lang CODE] [--backend auto|say|piper|tone] [--model FILE]"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from cueforge.operators.synthesize import Say, backend
from cueforge.plans.run import run_files
from cueforge.sources import sinks, voices


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cueforge", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("dub", "one subtitle file"), ("batch", "all files of a glob")):
        own = commands.add_parser(name, help=what)
        own.add_argument("path")
        own.add_argument("--output", default="." if name == "batch" else None)
        own.add_argument("--lang", default="")
        own.add_argument("--backend", default="auto", choices=("auto", "say", "piper", "tone"))
        own.add_argument("--model", default=os.environ.get("PIPER_MODEL", ""))
    options = parser.parse_args(argv)
    spark = SparkSession.builder.appName("cueforge").getOrCreate()
    try:
        by = backend(options.backend, options.model)
        # only say speaks with a voice of its own for each language
        catalogue = voices.installed(spark) if options.lang and isinstance(by, Say) else None
        run = run_files(spark, options.path, by, options.lang, catalogue)
        if options.output:
            run.write(options.output)
        if options.command == "batch":
            for row in run.summary().toLocalIterator():
                print(f"{row.file_id}: {row.segments} segment(s)")
        elif not options.output:
            for row in sinks.console(run.plan()).orderBy("ord").toLocalIterator():
                print(row.line)
    except Exception as error:  # one line for the user, whatever failed
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
