"""python -m credlens FILE [--scenario S] [--indicators A,B] [--html OUT | --reports FOLDER]: analyses a file and prints JSON.
--reports puts the report in a folder, under a name made from the file's."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.scalars import safe_filename_part
from .plans.analysis import analyze_file
from .plans.report import to_html, to_json


def report_path(folder: str, file: str) -> Path:
    return Path(folder) / f"{safe_filename_part(file.rstrip('/').rsplit('/', 1)[-1])}.html"


def main() -> None:
    parser = argparse.ArgumentParser(prog="credlens", description=__doc__)
    parser.add_argument("file")
    parser.add_argument("--scenario", default="auto")
    parser.add_argument("--indicators")
    parser.add_argument("--html")
    parser.add_argument("--reports")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("credlens").getOrCreate()
    found = analyze_file(spark, args.file, args.scenario, args.indicators)
    where = args.html or (args.reports and report_path(args.reports, args.file))
    if where:
        Path(where).write_text(to_html(found), encoding="utf-8")
    print(to_json(found))


if __name__ == "__main__":
    main()
