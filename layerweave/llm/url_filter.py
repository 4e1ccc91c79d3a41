"""URL filter: allow and block rules by host and path, and boosted trees on lexical features for all other URLs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave.llm.common import bounded_sample, map_arrow, texts_of
from layerweave.llm.trees import BoostedTrees, boosted_column, fit_boosted
from layerweave.operators.skew import HotKeys, spread_join
from layerweave.session import keep_table

#: The fit sees at most so many different labelled URLs, chosen by a hash of the URL; suffix statistics cover all labelled rows.
SAMPLE_ROWS = 20_000
# Weight of the overall block share in the share of a suffix.
PRIOR_ROWS = 20.0

Rules = Sequence[tuple[str, str]]
LEXICAL = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels")
FEATURES = (*LEXICAL, "suffix_share")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) between the first :// and the next of / ? #, and the path up to ? or #; else both empty."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"://([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one.

    A rule names a host and the beginning of a path; it fits that host and all its subdomains.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        of_host, slash, of_path = text.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(url: bytes, host: bytes, path: bytes) -> list[float]:
    size = len(url)
    counts = np.bincount(np.frombuffer(url, np.uint8), minlength=256)
    share = counts[counts > 0] / max(size, 1)
    query = url.partition(b"?")[2].partition(b"#")[0]
    return [
        size, len(host), len(path), sum(1 for part in path.split(b"/") if part), counts[48:58].sum() / max(size, 1), float(-(share * np.log2(share)).sum()),
        sum(1 for part in query.split(b"&") if part), url.count(b"-"), host.count(b".") + 1 if host else 0,
    ]


def with_lexical(urls: DataFrame) -> DataFrame:
    """``_row, _url, _host, _path, _rule, _says`` with the lexical features."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [texts_of(batch, c) for c in ("_url", "_host", "_path")]
        values = np.array([lexical(*row) for row in zip(*columns)], float)
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v) for v in values.T]], names=[*batch.schema.names, *LEXICAL])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return map_arrow(urls, run, f"{fields}, {', '.join(f'{f} double' for f in LEXICAL)}")


def judge(pages: DataFrame, rules: Rules, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` per row; the trees decide where no rule fits.

    URLs on which a rule fits are the labelled ones.  A null URL has an empty host and path and goes to the trees;
    repeated rows are judged alike; a table in which no rule fits gives even odds, which allow; an empty table gives an
    empty table; columns other than page_id and url are not read.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id"), F.col("url").alias("_url"), host.alias("_host"), path.alias("_path"))
    rule, says = matching_rule(F.col("_host"), F.col("_path"), rules)
    named = parsed.withColumns({"_rule": rule, "_says": says, "_suffix": F.substring_index("_host", ".", -2)})
    table = keep_table(with_lexical(named))
    labelled = table.filter(F.col("_says").isNotNull()).withColumn("_block", (F.col("_says") == "block").cast("double"))
    known = labelled.agg(F.coalesce(F.avg("_block"), F.lit(0.5)).alias("share")).first()["share"]
    shares = keep_table(
        labelled.groupBy("_suffix").agg(((F.sum("_block") + F.lit(PRIOR_ROWS * known)) / (F.count(F.lit(1)) + F.lit(PRIOR_ROWS))).alias("_share"))
    )
    size = shares.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("_suffix")), F.lit(0)).alias("chars")).first()

    def with_share(df: DataFrame) -> DataFrame:
        joined = spread_join(df, shares, ["_suffix"], [F.col("_url")], HotKeys(df, ["_suffix"]), size["n"], "left", 4 * size["chars"])
        return joined.withColumn("suffix_share", F.coalesce("_share", F.lit(float(known))))

    # The rules give equal URLs equal labels; each counts once in the fit, however many rows hold it.
    different = keep_table(labelled.select("_url", "_suffix", "_block", *LEXICAL).dropDuplicates(["_url"]))
    rows = with_share(bounded_sample(different, ["_url"], sample_rows)).select("_url", "_block", *FEATURES).orderBy("_url", "_block").collect()
    x = np.array([[row[f] for f in FEATURES] for row in rows], float).reshape(len(rows), len(FEATURES))
    model: BoostedTrees = fit_boosted(x, np.array([row["_block"] for row in rows]))
    score = boosted_column(model, [F.col(f) for f in FEATURES])
    return with_share(table).withColumn("block_score", score).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.coalesce("_says", F.when(F.col("block_score") > 0.5, "block").otherwise("allow")).alias("verdict"), "block_score",
    )
