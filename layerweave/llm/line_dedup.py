"""Line dedup by winnowing over line hashes.

A gram is the shortest stretch of lines from a line on that holds ``gram_words`` words.  In every window of grams that
start within ``window_words`` words, the gram with the smallest hash is a fingerprint, so a repeated run of whole lines with
``gram_words + window_words`` words always shares one; a passage that begins or ends inside a line may have none.
Fingerprints meet their first position, the match is extended line by line both ways, and the later run is deleted.  Lines
without a word do not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerweave.llm.common import WORD, digest
from layerweave.session import keep_table

GRAM_WORDS = 25
WINDOW_WORDS = 25

_DOC = ["doc_id", "_digest"]


def fingerprints(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, _digest, pos, key`` of the selected grams, with the line hashes around them.

    ``ahead`` begins with the gram's own lines, ``behind`` ends before it; ``ahead_at`` and ``behind_at`` are their places.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select("doc_id", F.unhex(digest("text")).alias("_digest"), F.posexplode(F.split(text, "\n")).alias("pos", "_line"))
    lines = cut.select(
        *_DOC, "pos", F.unhex(F.md5(F.trim(F.col("_line")))).alias("_hash"), F.regexp_count(F.col("_line"), F.lit(WORD)).cast("long").alias("_words")
    ).filter(F.col("_words") > 0)
    # Rows that repeat id and text are one document; partial aggregation merges them before they meet.
    single = lines.groupBy(*_DOC, "pos").agg(F.first("_hash").alias("_hash"), F.first("_words").alias("_words"))
    in_order = Window.partitionBy(*_DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Words before a line: strictly rising, so that windows of words are ranges of this value.
    placed = single.withColumn("_from", F.sum("_words").over(in_order) - F.col("_words"))
    by_words = Window.partitionBy(*_DOC).orderBy("_from")
    reach = gram_words + window_words
    gram, ahead, behind = by_words.rangeBetween(0, gram_words - 1), by_words.rangeBetween(0, reach - 1), by_words.rangeBetween(-reach, -1)
    short = F.xxhash64("_hash")
    grams = placed.withColumns({
        "_lines": F.collect_list("_hash").over(gram), "_held": F.sum("_words").over(gram),
        "ahead": F.collect_list(short).over(ahead), "ahead_at": F.collect_list("pos").over(ahead),
        "behind": F.collect_list(short).over(behind), "behind_at": F.collect_list("pos").over(behind),
    })
    key = F.md5(F.array_join(F.transform("_lines", lambda line: F.lower(F.hex(line))), ""))
    keyed = grams.withColumn("key", F.when(F.col("_held") >= gram_words, key)).withColumn("_own", F.when(F.col("key").isNotNull(), F.struct("key", "pos")))
    least = keyed.withColumn("_least", F.min("_own").over(by_words.rangeBetween(0, window_words - 1)))
    chosen = least.withColumn("_chosen", F.collect_list("_least.pos").over(by_words.rangeBetween(1 - window_words, 0)))
    return chosen.filter(F.array_contains("_chosen", F.col("pos")) & F.col("key").isNotNull()).select(
        *_DOC, "pos", F.unhex("key").alias("key"), "ahead", "ahead_at", "behind", "behind_at"
    )


def repeated_runs(found: DataFrame) -> DataFrame:
    """``doc_id, _digest, runs``: per document the stretches of lines (first, last) that occur earlier.

    Earlier means a smaller id (null last), then a smaller digest, then a smaller place.  Only the first position of a
    fingerprint is matched with the others, so a passage in very many documents costs one row each.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_digest").alias("digest"), F.col("pos").alias("pos"))
    first = found.groupBy("key").agg(F.min(F.struct(place.alias("place"), "ahead", "behind")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    later = found.withColumn("_place", place).join(first.filter(F.col("_n") > 1).drop("_n"), "key").filter(F.col("_place") != F.col("_first.place"))

    def common(own, other):
        differs = F.array_position(F.zip_with(own, other, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(differs > 0, differs - 1).otherwise(F.size(own)).cast("int")

    right = common(F.col("ahead"), F.col("_first.ahead"))
    left = common(F.reverse("behind"), F.reverse(F.col("_first.behind")))
    runs = later.withColumns({"_right": right, "_left": left}).select(*_DOC, F.struct(
        F.when(F.col("_left") > 0, F.element_at("behind_at", -F.col("_left"))).otherwise(F.col("pos")).alias("first"),
        F.element_at("ahead_at", F.col("_right")).alias("last"),
    ).alias("_run"))
    return runs.groupBy(*_DOC).agg(F.collect_set("_run").alias("runs"))


def dedup_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS, count: bool = False) -> DataFrame:
    """``docs`` with later repeated runs of lines taken out of ``text``; all rows and columns stay.

    With ``count`` only ``doc_id, n_lines, n_deleted, text`` come back.  Texts without a repeat, null and empty ones stay
    as they are.  Rows equal in id and text are one document and change alike.  Blank lines inside a run go with it.  A
    null id is later than all others.  An empty table gives an empty table.
    """
    runs = repeated_runs(keep_table(fingerprints(docs, gram_words, window_words))).select(
        F.col("doc_id").alias("_id"), F.col("_digest").alias("_d"), F.col("runs").alias("_runs")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, "doc_id", F.unhex(digest("text")).alias("_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d"))
    joined = keyed.join(runs.hint("merge"), same, "left").select("_row", "_runs", F.split(F.coalesce(F.col("_row.text"), F.lit("")), "\n").alias("_all"))
    kept = F.filter("_all", lambda line, at: ~F.exists("_runs", lambda run: at.between(run["first"], run["last"])))
    cut = joined.withColumn("_kept", F.when(F.col("_runs").isNotNull(), kept))
    text = F.when(F.col("_kept").isNull(), F.col("_row.text")).otherwise(F.array_join("_kept", "\n"))
    if count:
        lines = F.size("_all").cast("long")
        gone = F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(F.size("_all") - F.size("_kept")).cast("long")
        return cut.select(F.col("_row.doc_id").alias("doc_id"), lines.alias("n_lines"), gone.alias("n_deleted"), text.alias("text"))
    return cut.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
