"""Interactive shell, scripts and single statements: python -m quillon.cli [-d FOLDER] [-c SQL] [-f FILE]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from quillon.api import Engine
from quillon.errors import EngineError, mapped
from quillon.session import build_session

HELP = r"""\d, \dt, .tables   tables          \d NAME, .schema NAME   columns
\i FILE            run a file      \q                      quit"""


@mapped
def render(df: DataFrame, rows: int = 1000) -> str:
    """A header, rows with bars between, NULL for nulls, and the number of rows; the first `rows` are shown."""
    got = [["NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r] for r in df.limit(rows).collect()]
    lines = [" | ".join(df.columns), "-+-".join("-" * len(c) for c in df.columns), *(" | ".join(r) for r in got)]
    return "\n".join([*lines, f"({len(got)} row{'s' * (len(got) != 1)})"])


def run(engine: Engine, text: str) -> str:
    """What one line of input prints."""
    text = text.strip()
    if not text or text.startswith("--"):
        return ""
    words = text.rstrip(";").split()
    if words[0] in (r"\d", r"\d+", ".schema") and len(words) == 2:
        df, key = engine.table(words[1])
        return "\n".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields), f"sort key: {', '.join(key) or 'none'}"])
    if words[0] in (r"\d", r"\dt", ".tables"):
        return "\n".join(engine.table_names())
    if words[0] == r"\i" and len(words) == 2:
        with open(words[1]) as f:
            return "\n".join(filter(None, (run(engine, line) for line in f)))
    if words[0] in (r"\h", r"\?", "help"):
        return HELP
    out = engine.execute(text)
    return "OK" if out is None else render(out)


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="quillon")
    args.add_argument("-d", "--data", default="./quillon-data")
    args.add_argument("-c", "--command")
    args.add_argument("-f", "--file")
    given = args.parse_args(argv)
    engine = Engine(build_session(), given.data)
    once = given.command or (rf"\i {given.file}" if given.file else None)
    while True:
        try:
            line = once or input("quillon> ")
            if line.strip() in (r"\q", "quit", "exit"):
                return 0
            if text := run(engine, line):
                print(text)
        except EOFError:
            return 0
        except (EngineError, OSError) as e:
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
            if once:
                return 1
        if once:
            return 0


if __name__ == "__main__":
    sys.exit(main())
