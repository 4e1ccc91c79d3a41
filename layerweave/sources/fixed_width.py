"""Fixed-width text: a layout table names the fields, their places and types."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerweave.functions.cleaning import SEX_CODES, SEX_UNKNOWN, answer_time, code_map


@dataclass(frozen=True)
class Field:
    """One field: 1-based first and last character, and the type it is cast to."""

    name: str
    start: int
    end: int
    kind: str

    @property
    def length(self) -> int:
        return self.end - self.start + 1


def questionnaire_layout(items: int = 120, key_width: int = 6) -> list[Field]:
    """The layout of the raw answer file: five head fields, then one character per item.

    ``key_width`` is the width of the case number; files with more people than six digits can name have a wider one.
    """
    # Head fields of the answer file, whose case number has six characters.
    head = [
        Field("case", 1, 6, "integer" if key_width <= 9 else "long"),
        Field("sex", 7, 7, "string"),
        Field("age", 8, 9, "integer"),
        Field("date", 10, 22, "timestamp"),
        Field("country", 23, 31, "string"),
    ]
    more = key_width - 6
    fields = head + [Field(f"i{n}", 31 + n, 31 + n, "float") for n in range(1, items + 1)]
    return [replace(f, start=f.start + more * (f.start > 1), end=f.end + more) for f in fields]


def read_layout(spark: SparkSession, path: str) -> list[Field]:
    """Layout from a CSV ``Variable,Start,End,Schema``; one row per field, so it is collected."""
    rows = spark.read.csv(path, header=True, schema="Variable string, Start int, End int, Schema string").collect()
    return [Field(r["Variable"].strip().lower(), r["Start"], r["End"], r["Schema"].strip().lower()) for r in rows]


def slice_field(line: Column, field: Field) -> Column:
    return F.substring(line, field.start, field.length)


def parse_lines(lines: DataFrame, layout: Sequence[Field], column: str = "value", strict: bool = False) -> DataFrame:
    """Text lines → typed columns in one projection; a value that does not fit its type is NULL.

    The fields ``date`` and ``sex`` are decoded as the answer file writes them.
    """
    line = F.col(column)
    out = []
    for field in layout:
        text = slice_field(line, field)
        if field.name == "date" and field.kind == "timestamp":
            value = answer_time(text, strict)
        elif field.name == "sex":
            value = code_map(text, SEX_CODES, SEX_UNKNOWN)
        elif field.kind == "string":
            value = F.trim(text)
        else:
            value = F.trim(text).try_cast(field.kind)
        out.append(value.alias(field.name))
    return lines.select(*out)


def read_fixed_width(spark: SparkSession, path: str, layout: Sequence[Field], strict: bool = False) -> DataFrame:
    return parse_lines(spark.read.text(path), layout, strict=strict)
