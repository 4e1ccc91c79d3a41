"""Column functions of parsing and cleaning."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave.operators.skew import HotKeys, spread_join
from layerweave.session import cut_lineage

# Code of an unknown country; names that only an override resolves.
UNKNOWN_COUNTRY = "ZZZ"
COUNTRY_OVERRIDES = {"south kor": "KOR", "st lucia": "LCA"}
# Sex codes and the text for any other code.
SEX_CODES = {"1": "M", "2": "F"}
SEX_UNKNOWN = "None"


def code_map(column: Column, codes: Mapping[str, str], default: str | None) -> Column:
    """Translate codes; anything else, NULL included, becomes the default."""
    chain = None
    for code, text in codes.items():
        chain = F.when(column == code, F.lit(text)) if chain is None else chain.when(column == code, F.lit(text))
    return chain.otherwise(F.lit(default)) if chain is not None else F.lit(default)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often the body refers to it.

    A plain column would be copied into every reference when the optimizer pushes a filter below it.
    """
    return F.get(F.transform(F.array(value), use), 0)


def answer_time(text: Column, strict: bool = False) -> Column:
    """13 characters ``ssmmhhddMMyyy`` (year 1900 + yyy) → timestamp, with one repair.

    The first part out of range, in the order month, day, hour, minute, second, decides the repair:

    ======  =====================================================
    month   1 January
    day     first day of the next month; December has none → NULL
    hour    hour modulo 24; ``strict`` → NULL
    minute  minute modulo 59
    second  1900-01-01 00:00:00
    ======  =====================================================

    A second bad part after the repair, or a part that is no number, gives NULL.
    """
    # First character and length of each part.
    places = {"second": (1, 2), "minute": (3, 2), "hour": (5, 2), "day": (7, 2), "month": (9, 2), "year": (11, 3)}
    zero, one = F.lit(0), F.lit(1)

    def checked(p: Column) -> Column:
        month_ok = p["month"].between(1, 12)
        month_start = F.try_make_timestamp(p["year"] + 1900, F.when(month_ok, p["month"]), one, zero, zero, zero)
        return F.struct(
            p.alias("p"), month_ok.alias("month_ok"),
            (month_ok & p["day"].between(1, F.dayofmonth(F.last_day(month_start)))).alias("date_ok"),
            p["hour"].between(0, 23).alias("hour_ok"), p["minute"].between(0, 59).alias("minute_ok"),
            p["second"].between(0, 59).alias("second_ok"),
        )

    def repaired(c: Column) -> Column:
        p, date_ok, hour_ok, minute_ok = c["p"], c["date_ok"], c["hour_ok"], c["minute_ok"]
        late = date_ok & ~hour_ok & F.lit(not strict)
        return F.struct(
            (p["year"] + 1900).alias("year"),
            F.when(date_ok, p["month"]).when(c["month_ok"], p["month"] + 1).otherwise(one).alias("month"),
            F.when(date_ok, p["day"]).otherwise(one).alias("day"),
            F.when(late, p["hour"] % 24).otherwise(p["hour"]).alias("hour"),
            F.when(date_ok & hour_ok & ~minute_ok, p["minute"] % 59).otherwise(p["minute"]).alias("minute"),
            p["second"].alias("second"),
            (date_ok & hour_ok & minute_ok & ~c["second_ok"]).alias("only_second_bad"),
        )

    def built(r: Column) -> Column:
        valid = r["month"].between(1, 12) & r["hour"].between(0, 23) & r["minute"].between(0, 59) & r["second"].between(0, 59)
        stamp = F.try_make_timestamp(r["year"], r["month"], r["day"], r["hour"], r["minute"], r["second"])
        epoch = F.to_timestamp(F.lit("1900-01-01 00:00:00"))
        return F.when(r["year"].isNull(), F.lit(None).cast("timestamp")).when(r["only_second_bad"], epoch).otherwise(F.when(valid, stamp))

    parts = F.struct(*[F.substring(text, start, n).try_cast("int").alias(p) for p, (start, n) in places.items()])
    return once(parts, lambda p: once(checked(p), lambda c: once(repaired(c), built)))


def birth_year(taken: Column, age: Column) -> Column:
    return F.year(taken) - age


def key_part(column: Column) -> Column:
    """The part of a key before its first underscore."""
    return F.substring_index(column, "_", 1)


def geo_key(state: Column, county: Column) -> Column:
    return F.concat(key_part(state), key_part(county))


def tidy_text(column: Column) -> Column:
    """Drop list numbers such as ``12. `` anywhere, fold white space, trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(column, r"\d+\. ", ""), r"\s+", " "))


def with_country_code(df: DataFrame, column: str, countries: DataFrame, code: str = "country_code") -> DataFrame:
    """Add the code of a free-text country name; ``countries`` holds ``name, code``.

    Tried in turn: the whole name, the text as a part of one name (earliest place first, then
    lowest code), the overrides, and ``ZZZ``.  All parts of the listed names are spelled out, a
    table bounded by the country list, so the search is an equi-join and never a pairing of every
    text with every country.
    """
    names = countries.select(F.trim(F.lower("name")).alias("_name"), F.col("code").alias("_code"))
    starts = F.explode(F.sequence(F.lit(1), F.length("_name"))).alias("_start")
    parts = names.select("_name", "_code", starts).select(
        "_name", "_code", "_start", F.explode(F.sequence(F.lit(1), F.length("_name") - F.col("_start") + 1)).alias("_length")
    )
    whole = (F.col("_start") == 1) & (F.col("_length") == F.length("_name"))
    best = F.min_by("_code", F.struct((~whole).alias("partial"), F.col("_start"), F.col("_code")))
    lookup = cut_lineage(
        parts.withColumn("_text", F.substring(F.col("_name"), F.col("_start"), F.col("_length")))
        .groupBy("_text").agg(best.alias("_found"))
    )
    size = lookup.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("text")).first()
    spoken = df.withColumn("_text", F.trim(F.lower(F.col(column))))
    others = [F.col(c) for c in df.columns if c != column] or [F.col(column)]
    found = spread_join(
        spoken, lookup, ["_text"], others, HotKeys(spoken, ["_text"]), size["rows"], "left", size["text"]
    )
    override = code_map(F.col("_text"), COUNTRY_OVERRIDES, UNKNOWN_COUNTRY)
    return found.withColumn(code, F.coalesce("_found", override)).select(*df.columns, code)


def clean_item_key(keys: DataFrame, number: str, sign: str) -> DataFrame:
    """Questionnaire key rows that carry an item number; the sign is the first character of its field."""
    kept = keys.filter(F.length(F.trim(F.col(number).cast("string"))) > 0)
    return kept.withColumn(number, F.col(number).try_cast("int")).withColumns(
        {sign: F.substring(F.col(sign), 1, 1), "adjusted": F.lit("True")}
    )


def with_person_id(df: DataFrame, case_column: str = "case", name: str = "uuid") -> DataFrame:
    """The case number becomes the id; a table with neither gets a dense index over all its columns."""
    lower = {c.lower(): c for c in df.columns}
    if case_column.lower() in lower:
        return df.withColumnRenamed(lower[case_column.lower()], name)
    if name.lower() in lower:
        return df
    from layerweave.operators.ordering import dense_index

    indexed = dense_index(df, [F.col(c) for c in df.columns], name, ties=True)
    return indexed.select(name, *df.columns)


def valid_records(df: DataFrame, flag: str = "ipc") -> DataFrame:
    """Keep rows whose validity flag is 1, when the table has one."""
    found = next((c for c in df.columns if c.lower() == flag.lower()), None)
    return df.filter(F.col(found) == 1) if found else df
