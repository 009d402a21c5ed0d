"""CSV exports: every field quoted, quotes doubled, arrays joined, flags as words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_field(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    value = F.array_join(column, "; ") if kind.startswith("array") else F.when(F.col(column), "Yes").otherwise("No") if kind == "boolean" else F.col(column).cast("string")
    return F.coalesce(value, F.lit(""))


def export_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One text column with the CSV line of each row."""
    quoted = [F.concat(F.lit('"'), F.replace(export_field(df, c), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return df.select(F.concat_ws(",", *quoted).alias("line"))


def contact_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """The other form of export: a line for each row, every field quoted and its quotes doubled, to go under an unquoted header."""
    return export_lines(df, columns)


def header_line(columns: list[str]) -> str:
    """The unquoted header of that form."""
    return ",".join(columns)


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """The same as files with a header."""
    df.select(*[export_field(df, c).alias(c) for c in columns]).write.option("quoteAll", True).option("escape", '"').csv(path, header=True)


def appended_json(df: DataFrame, rows: DataFrame, path: str) -> None:
    """A table and its new rows as JSON lines at a new path."""
    df.unionByName(rows, allowMissingColumns=True).write.json(path)
