"""Command line: runs statements and prints their results.

python -m tidemark [--file F] [--catalog JSON] [--output F] [--format table|csv|json] [SQL]"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.engine import Engine
from tidemark.errors import SqlError
from tidemark.sources.events import catalog_from_json


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("sql", nargs="?")
    parser.add_argument("--file", type=Path, help="a script")
    parser.add_argument("--catalog", type=Path, help="streams as JSON: name to columns")
    parser.add_argument("--output", type=Path, help="a folder for the last result, else it is printed")
    parser.add_argument("--format", choices=["table", "csv", "json"], default="table")
    given = parser.parse_args(args)
    script = given.file.read_text() if given.file else given.sql
    if not script:
        parser.error("SQL or --file is needed")
    engine = Engine(SparkSession.builder.appName("tidemark").getOrCreate())
    try:
        if given.catalog:
            for name, columns in catalog_from_json(given.catalog.read_text()).items():
                engine.execute(f"CREATE STREAM {name} ({', '.join(f'{c} DOUBLE' for c in columns)})")
        result = engine.script(script)[-1]
    except SqlError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if result is None:
        return 0
    if given.output:
        result.write.format("parquet" if given.format == "table" else given.format).save(str(given.output))
    elif given.format == "table":
        result.show(1000, truncate=False)
    else:
        for line in result.toJSON().collect() if given.format == "json" else [",".join(map(str, r)) for r in result.collect()]:
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
