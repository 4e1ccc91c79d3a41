"""Mixing sources to target weights by exponential keys (Efraimidis and Spirakis).

Every source gets a budget of words by water-filling its weight under a cap.  Whole epochs of a source come first; the
rest of its budget goes to the documents with the smallest exponential keys -ln(u) / quality weight, by a running total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerweave.functions.hashing import md5_uniform
from layerweave.llm.common import WORD, digest
from layerweave.operators.ordering import running_total
from layerweave.operators.skew import HotKeys, spread_join
from layerweave.session import keep_table

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def source_key(source: Column) -> Column:
    """A key that is never null, so that documents without a source are a source of their own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``_source, source_size, target`` from ``_source, source, source_size``, one row per source.

    Sources in code-point order, null last, take the weights in turn and share the total of all sizes.  A source that
    would pass ``most_epochs`` times its size stops there; the level of the others follows from running totals over the
    sources sorted by cap per weight, which is where repeated resharing ends.  The windows see one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    filled = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most_epochs)))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_source")
    before, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left_over = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    levels = filled.withColumn("_level", left_over / weight_left)
    # The first source below its cap sets the level; the values behind it are lower and mean nothing.
    level = F.max(F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.col("_level"))).over(whole)
    return levels.select(
        "_source", "source_size", F.coalesce(F.least(F.col("_cap"), level * F.col("_w")), F.col("_cap")).alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``doc_id, _digest, _source, copies, size, source_size, target, taken``, one row per different document.

    ``taken`` counts words: whole epochs of the document and, for one document at the edge of the budget, a part of it.
    Rows equal in id, text and source are one document with ``copies`` rows that share evenly.  A null text has size 0
    and is never taken; a null source is a source; an empty table gives an empty table.  Keys depend on the rows only,
    so reruns agree.  Columns of ``docs`` other than doc_id, text and source are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    units = keep_table(
        docs.select("doc_id", digest("text").alias("_digest"), "source", size.alias("size"), symbols.alias("_symbols"))
        .groupBy("doc_id", "_digest", "source").agg(F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("_symbols").alias("_symbols"))
        .withColumn("_source", source_key(F.col("source")))
        .withColumn("_quality", F.lit(1.0) / (F.lit(1.0) + F.col("_symbols") / F.greatest(F.col("size"), F.lit(1))))
        .withColumn("_key", -F.log(md5_uniform(F.lit("mix"), F.col("doc_id"), F.col("_digest"))) / F.col("_quality"))
        .drop("_symbols", "_quality")
    )
    sizes = units.groupBy("_source", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = keep_table(source_targets(sizes, weights, most_epochs))
    known = targets.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("_source")), F.lit(0)).alias("chars")).first()
    placed = running_total(
        units.drop("source"), [F.col("_key"), F.col("doc_id"), F.col("_digest")], F.col("size") * F.col("copies"), ["_source"], "_before"
    )
    joined = spread_join(placed, targets, ["_source"], [F.col("_digest")], HotKeys(units, ["_source"]), known["n"], text_bytes=4 * known["chars"])
    epochs = F.coalesce(F.floor(F.col("target") / F.expr("nullif(source_size, 0)")), F.lit(0)).cast("long")
    part = F.floor(F.col("target")).cast("long") - F.col("_epochs") * F.col("source_size")
    share = F.greatest(F.lit(0).cast("long"), F.least(part - F.col("_before"), F.col("size") * F.col("copies")))
    return joined.withColumn("_epochs", epochs).select(
        "doc_id", "_digest", "_source", "copies", "size", "source_size", "target",
        (F.col("_epochs") * F.col("size") + F.floor(share / F.col("copies")).cast("long")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, one row per row of ``docs``."""
    return mix(docs, **options).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row per epoch, and the last part of a budget cut after its last word.

    All columns stay; only ``text`` of a partly taken row changes.  Documents of which nothing is taken go.
    """
    plan = mix(docs, **options).filter(F.col("taken") > 0).select(
        F.col("doc_id").alias("_id"), F.col("_digest").alias("_d"), F.col("_source").alias("_s"), F.col("size").alias("_size"), F.col("taken").alias("_taken")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, "doc_id", digest("text").alias("_digest"), source_key(F.col("source")).alias("_source"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d")) & (F.col("_source") == F.col("_s"))
    rows = keyed.join(plan.hint("merge"), same).select(
        "_row", "_size", F.explode(F.expr("transform(sequence(1L, CAST(ceil(_taken / _size) AS BIGINT)), k -> least(_size, _taken - (k - 1) * _size))")).alias("_words")
    )
    text = F.col("_row.text")
    head = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    pieces = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.concat(head, F.array_join(F.slice(pieces, F.lit(1), F.col("_words").cast("int")), ""))
    kept = F.when(F.col("_words") < F.col("_size"), cut).otherwise(text)
    return rows.select(*[kept.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
