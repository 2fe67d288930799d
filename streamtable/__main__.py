"""A prompt for SQL: python -m streamtable PATH [--create]. \\q ends it, \\h helps."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

import streamtable


#: Rows of a result that the prompt shows.
SHOWN = 1000


def main(args: list[str]) -> int:
    if not args or args[0] in ("-h", "--help"):
        print(__doc__)
        return 0
    spark = SparkSession.builder.appName("streamtable").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with streamtable.open(spark, args[0], create="--create" in args) as ds:
        lines: list[str] = []
        while True:
            try:
                line = input("... " if lines else "sql> ")
            except EOFError:
                return 0
            if not lines and line.strip() == "\\q":
                return 0
            if not lines and line.strip() == "\\h":
                print("Statements end with a semicolon. \\q ends the session.")
                continue
            lines.append(line)
            if line.rstrip().endswith(";"):
                try:
                    shown = ds.query("\n".join(lines)).limit(SHOWN + 1).execute()
                    print(shown.pretty(SHOWN).replace("... 1 more rows", f"... only the first {SHOWN} rows are shown"))
                except Exception as e:
                    print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
                lines = []


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
