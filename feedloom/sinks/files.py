"""Sinks: JSON Lines, one pretty JSON array, report text, a workbook, and a listing of what was written. All overwrite."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """A folder of JSON Lines with null fields kept; sorted over the files if ``order`` is given. Works at any size."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str, order: list[Column], drop: list[str] | None = None) -> int:
    """One file with a JSON array indented by two, rows in ``order``; gives the number of rows.

    Rows come to the driver one partition at a time and are written as they come. For results that people read.
    """
    rows = df.orderBy(*order).drop(*(drop or [])).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in rows.toLocalIterator():
            body = json.dumps(json.loads(row.j), ensure_ascii=False, indent=2).replace("\n", "\n  ")
            f.write(("," if n else "") + "\n  " + body)
            n += 1
        f.write("\n]" if n else "]")
    return n


def write_report(lines: DataFrame, path: str) -> None:
    """One text file of report lines (section, line, text) in order, a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        for i, row in enumerate(lines.orderBy("section", "line").toLocalIterator()):
            f.write(("\n" if i else "") + row.text)


def write_workbook(sheets: dict[str, DataFrame], path: str, most_rows: int = 1_048_575) -> None:
    """A workbook with a sheet per frame, empty ones left out; without the optional library an ImportError.

    A sheet of the format holds ``most_rows`` rows; a larger frame is refused before anything comes to the driver, not cut.
    """
    import openpyxl  # noqa: F401
    import pandas as pd

    for name, df in sheets.items():
        if (n := df.count()) > most_rows:
            raise ValueError(f"a sheet holds {most_rows} rows at most, {name} has {n}")
    frames = {name: df.toPandas() for name, df in sheets.items()}
    with pd.ExcelWriter(path, engine="openpyxl") as writer:
        for name, frame in frames.items():
            if len(frame):
                frame.to_excel(writer, sheet_name=name, index=False)


def listing(folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files in a local folder, by name."""
    return sorted((p.name, p.stat().st_size) for p in Path(folder).iterdir() if p.is_file())


def listing_frame(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the files under any path Spark reads; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
