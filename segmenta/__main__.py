"""python -m segmenta QUERY FOLDER [OUT]: runs a core query on a folder of tables and shows it, or writes it as Parquet to OUT;
python -m segmenta --list names the queries."""

from __future__ import annotations

import argparse


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="segmenta", description=__doc__)
    parser.add_argument("query", nargs="?")
    parser.add_argument("folder", nargs="?")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--list", action="store_true")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    given = parser.parse_args(arguments)
    from segmenta.plans import catalogue

    queries = catalogue.queries()
    if given.list or given.query is None:
        print("\n".join(sorted(queries)))
        return 0
    if given.query not in queries or given.folder is None:
        parser.print_usage()
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = queries[given.query](spark, given.folder)
    if given.out:
        rows.write.mode("errorifexists").parquet(given.out)
    else:
        rows.show(given.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
