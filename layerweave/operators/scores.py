"""Factor scores, z-scores and quintiles of a questionnaire."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave.operators.ordering import exact_quantiles

# The five factors, in the order in which layers are stacked.
FACTORS = ("OPN", "CSN", "EXT", "AGR", "NEU")
# The shares that cut the people into five ranks.
QUINTILE_SHARES = (0.2, 0.4, 0.6, 0.8)


def items_by_factor(scorecard: DataFrame, factors: Sequence[str] = FACTORS) -> dict[str, list[str]]:
    """Item columns of each factor: the scorecard rows whose ``key`` starts with the factor.

    The scorecard is a layout table with one row per item column, never larger than a schema.
    """
    chosen = scorecard.select(
        "id", *[F.col("key").startswith(f).alias(f) for f in factors]
    ).collect()
    return {f: [row["id"] for row in chosen if row[f]] for f in factors}


def factor_sums(answers: DataFrame, items: Mapping[str, Sequence[str]], keep_items: bool = False) -> DataFrame:
    """One column per factor: the sum of its items, NULL when any item is NULL."""
    sums = [reduce(Column.__add__, [F.col(c) for c in columns]).alias(f) for f, columns in items.items()]
    dropped = set() if keep_items else {c for columns in items.values() for c in columns}
    kept = [c for c in answers.columns if c not in dropped]
    return answers.select(*kept, *sums)


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and sample standard deviation of all columns in one pass; one row reaches the driver."""
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in columns],
        *[F.stddev(F.col(c).cast("double")).alias(f"{c}_sd") for c in columns],
    ).first()
    return {c: (row[f"{c}_mean"], row[f"{c}_sd"]) for c in columns}


def z_score(column: Column, mean: float | None, sd: float | None, digits: int = 3) -> Column:
    """Half-even rounded z-score; NULL when the spread is unknown or zero."""
    if mean is None or not sd:
        return F.lit(None).cast("double")
    return F.bround((column.cast("double") - F.lit(mean)) / F.lit(sd), digits)


def with_z_scores(df: DataFrame, columns: Sequence[str], suffix: str = "_Z") -> DataFrame:
    stats = moments(df, columns)
    return df.withColumns({f"{c}{suffix}": z_score(F.col(c), *stats[c]) for c in columns})


def quantile_cuts(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float] = QUINTILE_SHARES, accuracy: int | None = None
) -> dict[str, list[float]]:
    """Cut values of every column; ``accuracy`` switches to the mergeable approximate sketch.

    The exact form counts equal values first, then sorts the distinct values range-partitioned.
    Only one row per column and share reaches the driver.
    """
    if accuracy:
        row = df.agg(
            *[F.percentile_approx(F.col(c).cast("double"), list(shares), accuracy).alias(c) for c in columns]
        ).first()
        return {c: list(row[c] or []) for c in columns}
    long = unpivot(df, [], columns, "factor", "value")
    cuts = exact_quantiles(long, "value", shares, ["factor"]).collect()
    found = {c: {} for c in columns}
    for row in cuts:
        found[row["factor"]][row["probability"]] = row["cut"]
    return {c: [by_share[s] for s in shares if s in by_share] for c, by_share in found.items()}


def rank_by_cuts(column: Column, cuts: Sequence[float]) -> Column:
    """1 + number of cuts at or below the value truncated toward zero; a value on a cut goes up."""
    whole = column.cast("double").cast("long")
    return reduce(Column.__add__, [(whole >= F.lit(float(c))).cast("int") for c in cuts], F.lit(1))


def with_quintiles(
    df: DataFrame,
    columns: Sequence[str],
    suffix: str = "_Q",
    shares: Sequence[float] = QUINTILE_SHARES,
    accuracy: int | None = None,
) -> DataFrame:
    cuts = quantile_cuts(df, columns, shares, accuracy)
    return df.withColumns({f"{c}{suffix}": rank_by_cuts(F.col(c), cuts[c]) for c in columns})


def score_people(
    answers: DataFrame,
    scorecard: DataFrame,
    drop: Sequence[str] = (),
    keep_items: bool = False,
    factors: Sequence[str] = FACTORS,
    accuracy: int | None = None,
) -> DataFrame:
    """Answers → factor sums, z-scores and quintiles: two aggregates, then projections only."""
    sums = factor_sums(answers.drop(*drop), items_by_factor(scorecard, factors), keep_items)
    return with_quintiles(with_z_scores(sums, factors), factors, accuracy=accuracy)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide factor columns → one row per (id, factor); a narrow projection, no shuffle."""
    return df.unpivot(list(ids), [F.col(c).cast("double").alias(c) for c in columns], name, value)


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "", drop: Sequence[str] = ()) -> list[str]:
    """Column names chosen by prefix and suffix, minus an explicit list."""
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and c not in drop]
