"""Total order without a single task: dense indexes, running totals and exact quantiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerweave.session import cut_lineage, keep_table


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    weight: Column | None = None,
    within: Sequence[str] = (),
    name: str = "total_before",
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows of the order (per ``within`` group).

    Rows are range-partitioned and sorted once and kept in reliable storage, which fixes the
    partition of every row.  Each partition numbers its own rows; the totals of the partitions
    (one row per partition and group) are then added up and joined back.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    keys = [F.col(c) for c in within] + list(order)
    sorted_rows = cut_lineage(
        df.withColumn("_weight", weight)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright(F.col("_at"), 33))
    )
    groups = ["_part", *within]
    sums = sorted_rows.groupBy(*groups).agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*groups, F.coalesce(F.sum("_sum").over(before), F.col("_sum") * 0).alias("_offset"))
    inside = Window.partitionBy(*groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sorted_rows.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.col("_weight") * 0))
        .join(offsets, groups)
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_weight", "_at", "_part", "_inside", "_offset")
    )


def laid_out(df: DataFrame, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rows sorted once and kept as a table, with their place: ``_part`` of the sort and ``_at`` in the whole order.

    Rows that share these columns, or rows that are given them later, can be read by ``running`` again and again without
    being sorted by their keys anew.
    """
    keys = [*within, *order]
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at)
    return keep_table(rows.withColumn("_part", F.shiftright("_at", 33)))


def running(
    rows: DataFrame, within: Sequence[str], columns: Mapping[str, tuple[Callable[[Column], Column], Column]], earlier: bool = False,
    backwards: bool = False, one_task: bool = False,
) -> DataFrame:
    """Add aggregates over all rows up to the current one in the order of ``laid_out``, per ``within`` group.

    ``columns`` maps a name to ``F.sum``, ``F.max`` or ``F.min`` and a column.  ``earlier`` leaves the current row out;
    ``backwards`` reads from the end.  Each partition of the sort is aggregated for itself; what lies before it is one row
    per partition and group.  With ``one_task``, for tables known to be small, a group is read in one piece.  A value
    over no rows is NULL.
    """
    turned = (lambda c: F.col(c).desc()) if backwards else F.col
    last = -1 if earlier else 0
    if one_task:
        inside = Window.partitionBy(*within).orderBy(turned("_at")).rowsBetween(Window.unboundedPreceding, last)
        return rows.withColumns({n: f(c).over(inside) for n, (f, c) in columns.items()})
    combine = {F.sum: lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), F.max: F.greatest, F.min: F.least}
    groups = [*within, "_part"]
    parts = rows.groupBy(*groups).agg(*[f(c).alias(f"_sum_{n}") for n, (f, c) in columns.items()])
    before = Window.partitionBy(*within).orderBy(turned("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*groups, *[f(f"_sum_{n}").over(before).alias(f"_before_{n}") for n, (f, _) in columns.items()])
    inside = Window.partitionBy(*groups).orderBy(turned("_at")).rowsBetween(Window.unboundedPreceding, last)
    # One row per partition of the sort and group: small whatever the number of rows.
    whole = rows.withColumns({f"_in_{n}": f(c).over(inside) for n, (f, c) in columns.items()}).join(F.broadcast(offsets), groups)
    made = {n: combine[f](F.col(f"_in_{n}"), F.col(f"_before_{n}")) for n, (f, _) in columns.items()}
    return whole.withColumns(made).drop(*[f"{kind}{n}" for n in columns for kind in ("_in_", "_before_")])


def dense_index(df: DataFrame, order: Sequence[Column], name: str = "idx", ties: bool = False) -> DataFrame:
    """Add ``name`` = 0..N-1 in the given total order.

    ``ties`` says that rows may be equal in the order; the place in the input then separates them,
    so that many equal rows still spread over several tasks.
    """
    keys = list(order)
    if ties:
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        return dense_index(df, [*keys, F.col("_tie")], name).drop("_tie")
    sorted_rows = cut_lineage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("_at"), 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort, a number the session sets: the window and the broadcast
    # do not grow with the data.
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    local = F.col("_at") - F.shiftleft(part, 33)
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, local + F.col("_offset"))
        .drop("_at", "_part", "_offset")
    )


def exact_quantiles(values: DataFrame, value: str, probabilities: Sequence[float], within: Sequence[str]) -> DataFrame:
    """Smallest value whose cumulative share reaches each probability, per group.

    Equal values are counted before the sort, so a value that a third of all rows share is one row.
    Returns ``within..., probability, cut``.
    """
    if not within:
        return exact_quantiles(values.withColumn("_all_rows", F.lit(0)), value, probabilities, ["_all_rows"]).drop("_all_rows")
    counts = values.filter(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, [F.col(value)], F.col("_n"), within, "_before")
    totals = counts.groupBy(*within).agg(F.sum("_n").alias("_all"))
    targets = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    wanted = totals.select(*within, "_all", targets).withColumn(
        "_target", F.greatest(F.col("probability") * F.col("_all") - F.lit(1e-9), F.lit(0.0))
    )
    hit = (F.col("_before") < F.greatest(F.col("_target"), F.lit(0.5))) & (F.col("_target") <= F.col("_before") + F.col("_n"))
    return ranked.join(wanted, list(within)).filter(hit).select(*within, "probability", F.col(value).alias("cut"))
