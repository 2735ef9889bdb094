"""python -m tessera FOLDER STATEMENTS: run SQL on a folder of Parquet tables and print rows as TSV."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.plans.syntax import statements
from tessera.session import Session


def shown(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def main(args: list[str]) -> int:
    if len(args) != 2:
        print(__doc__, file=sys.stderr)
        return 2
    session = Session(SparkSession.builder.getOrCreate())
    for path in sorted(Path(args[0]).glob("*.parquet")):
        session.register(path.stem, session.spark.read.parquet(str(path)))
    for statement in statements(args[1]):
        df = session.sql(statement)
        print("\t".join(df.columns))
        for row in df.toLocalIterator(prefetchPartitions=True):
            print("\t".join(map(shown, row)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
