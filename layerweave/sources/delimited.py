"""Delimited text: tables, arrays in one field, coordinate lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what separates the members of an array in one text field.
ARRAY_MARK = "|"


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """CSV with a header; a separator that does not split the header falls back to the comma.

    Spark reads a wrong separator as one wide column, so the header line decides.
    """
    def load(mark: str) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", mark)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return reader.csv(path)

    if sep != ",":
        first = spark.read.text(path).limit(1).collect()
        if first and sep not in first[0]["value"] and "," in first[0]["value"]:
            sep = ","
    return load(sep)


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite", sep: str = ",") -> str:
    """CSV with a header; one file per partition unless a single file is asked for."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).option("sep", sep).csv(path)
    return path


def write_sorted_csv(df: DataFrame, path: str, order: Sequence[str], single_file: bool = False) -> str:
    """Rows in total order: range-partitioned files, or one file on request."""
    if single_file:
        ordered = df.repartition(1).sortWithinPartitions(*order)
    else:
        ordered = df.orderBy(*order)
    ordered.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_lines_without_header(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Text lines split into named text columns; every line equal to the first one is dropped."""
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    kept = lines.filter(F.col("value") != F.lit(first[0]["value"])) if first else lines
    fields = F.split("value", sep.replace("|", r"\|"))
    return kept.select(*[F.get(fields, n).alias(c) for n, c in enumerate(columns)])


def array_to_text(column: Column, mark: str = ARRAY_MARK) -> Column:
    return F.array_join(column, mark)


def text_to_array(column: Column, mark: str = ARRAY_MARK) -> Column:
    return F.split(column, "\\" + mark).cast("array<string>")


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``i j k value`` separated by one blank."""
    return spark.read.csv(path, sep=" ", schema="i long, j long, k long, value double")


def write_coordinates(cells: DataFrame, path: str) -> str:
    cells.select("i", "j", "k", "value").write.mode("overwrite").csv(path, sep=" ")
    return path


def write_factor(rows: DataFrame, path: str, columns: Sequence[str]) -> str:
    """Factor rows as text in index order: ``idx f0 f1 ..``."""
    rows.orderBy("idx").select("idx", *columns).write.mode("overwrite").csv(path, sep=" ")
    return path
