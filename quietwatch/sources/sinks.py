"""Report and bundle sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report_csv(rows: DataFrame, path: str) -> None:
    """A report of a few dozen metric rows as one CSV file with a header."""
    (
        rows.coalesce(1)
        .write.mode("overwrite")
        .option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
