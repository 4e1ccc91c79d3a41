"""Search of country names that are written with accents, as a subdivision, or with a letter wrong."""

from __future__ import annotations

from unicodedata import combining, normalize

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave.functions.cleaning import UNKNOWN_COUNTRY, with_country_code
from layerweave.operators.skew import HotKeys, fits_broadcast, spread_join
from layerweave.session import cut_lineage, keep_table

# Every Latin letter that is one plain letter with marks, and that letter.
_MARKED = [(chr(c), d[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := normalize("NFD", chr(c))) > 1 and all(map(combining, d[1:]))]
# Letters that may be wrong in a text of at least so many letters, most first.
TYPOS = ((8, 2), (4, 1))


def folded(text: Column) -> Column:
    """Lower case without accents and outer blanks."""
    plain = F.translate(text, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))
    return F.trim(F.lower(F.regexp_replace(plain, "[̀-ͯ]", "")))


def _allowed(text: Column) -> Column:
    chain = F.lit(0)
    for letters, typos in reversed(TYPOS):
        chain = F.when(F.length(text) >= letters, typos).otherwise(chain)
    return chain


def _shortened(texts: Column) -> Column:
    """Every text of an array with each one of its letters left out."""
    return F.flatten(F.transform(texts, lambda t: F.when(F.length(t) > 0, F.transform(
        F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))
    )).otherwise(F.array().cast("array<string>"))))


def _variants(df: DataFrame, text: str, typos: Column) -> DataFrame:
    """One row per form of a text with at most ``typos`` letters left out, in ``_variant``."""
    none = F.array().cast("array<string>")
    rows = df.withColumn("_one", F.when(typos >= 1, F.array_distinct(_shortened(F.array(text)))).otherwise(none))
    rows = rows.withColumn("_two", F.when(typos >= 2, _shortened(F.col("_one"))).otherwise(none))
    every = F.array_distinct(F.concat(F.array(text), "_one", "_two"))
    return rows.withColumn("_variant", F.explode(every)).drop("_one", "_two")


def find_countries(
    df: DataFrame, column: str, countries: DataFrame, subdivisions: DataFrame | None = None, code: str = "country_code"
) -> DataFrame:
    """Add the code of a free-text country; ``countries`` and ``subdivisions`` hold ``name, code``.

    Letters are compared without case and accents.  Tried in turn: what ``with_country_code`` finds, the whole name of a
    subdivision, and the name of either list with the fewest wrong letters (``TYPOS`` says how many may be, by the length
    of the text; then countries before subdivisions, then name and code).  A NULL or empty text is unknown.

    Different texts are searched once each.  Two words that differ by at most two letters have a common form with at most
    two letters left out of either, so candidates come from an equi-join on such forms, and only they are compared.
    """
    texts = keep_table(df.select(F.col(column).alias("_raw")).distinct().withColumn("_text", folded(F.col("_raw"))))
    words = texts.select("_text").filter(F.length("_text") > 0).distinct()
    listed = countries.select(folded(F.col("name")).alias("name"), "code")
    whole = listed.withColumn("_second", F.lit(False))
    if subdivisions is not None:
        whole = whole.unionByName(subdivisions.select(folded(F.col("name")).alias("name"), "code", F.lit(True).alias("_second")))
    whole = cut_lineage(whole.filter(F.length("name") > 0).distinct())
    known = keep_table(with_country_code(words, "_text", listed, "_code"))
    longest = whole.agg(F.max(F.length("name"))).first()[0] or 0
    open_words = known.filter((F.col("_code") == UNKNOWN_COUNTRY) & (F.length("_text") <= longest + TYPOS[0][1])).select("_text")
    names = cut_lineage(_variants(whole, "name", F.lit(TYPOS[0][1])))  # bounded by the lists
    asked = keep_table(_variants(open_words, "_text", _allowed(F.col("_text"))))
    size = names.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("_variant") + F.octet_length("name") + F.octet_length("code")), F.lit(0)).alias("text")).first()
    side = F.broadcast(names) if fits_broadcast(size["rows"], len(names.columns), size["text"]) else names.hint("merge")
    wrong = F.levenshtein("_text", "name")
    close = asked.join(side, "_variant").select("_text", "name", "code", "_second", wrong.alias("_wrong")).filter(F.col("_wrong") <= _allowed(F.col("_text")))
    order = F.struct((F.col("_wrong") > 0).alias("a"), "_wrong", "_second", "name", "code")
    best = close.groupBy("_text").agg(F.min_by("code", order).alias("_near"))
    answers = known.join(best.hint("merge"), "_text", "left").select("_text", F.coalesce("_near", "_code").alias("_found"))
    per_text = texts.join(answers.hint("merge"), "_text", "left").filter(F.col("_raw").isNotNull()).select(F.col("_raw").alias(column), F.coalesce("_found", F.lit(UNKNOWN_COUNTRY)).alias(code))
    per_text = keep_table(per_text)
    count = per_text.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("text")).first()
    others = [F.col(c) for c in df.columns if c != column] or [F.col(column)]
    found = spread_join(df, per_text, [column], others, HotKeys(df, [column]), count["rows"], "left", count["text"])
    return found.withColumn(code, F.coalesce(code, F.lit(UNKNOWN_COUNTRY))).select(*df.columns, code)
