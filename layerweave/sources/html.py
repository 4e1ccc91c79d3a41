"""Items under headings in HTML pages."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave.functions.cleaning import tidy_text

_MARK = "\x01"
# Elements whose start or end also ends an open paragraph.
BLOCKS = (
    "address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|html|"
    "li|main|nav|ol|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
# All named characters of the HTML standard, from Python's own table; a no-break space counts as a space.
NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")} | {"nbsp": " "}
_REFERENCE = "^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def resolve_characters(text: Column) -> Column:
    """Named and numeric character references as characters; unknown names stay as they are written."""
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def piece_text(piece: Column) -> Column:
        name = F.regexp_extract(piece, _REFERENCE, 1)
        rest = F.substring(piece, F.length(name) + 3, F.length(piece))
        digits = F.lower(F.substring(name, 2, 8))
        code = F.when(digits.startswith("x"), F.conv(F.substring(digits, 2, 7), 16, 10)).otherwise(digits).try_cast("long")
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        known = F.when(name.startswith("#"), number).otherwise(F.try_element_at(named, name))
        return F.when((name == "") | known.isNull(), piece).otherwise(F.concat(known, rest))

    pieces = F.split(text, "(?=&)")
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, piece_text), "")).otherwise(text)


def _plain(column: Column) -> Column:
    """Text of a fragment: tags dropped, character references resolved."""
    return resolve_characters(F.regexp_replace(column, r"<[^>]*>", ""))


def html_items(pages: DataFrame, id_column: str, html_column: str, heading: str = "h2", item: str = "p") -> DataFrame:
    """``id, topic, place, goal``: every item element with the lower-cased heading above it.

    A page is cut at its headings and each section at its items, inside the row: no window, no
    shuffle.  Items before the first heading have an empty topic; an open item ends at the next
    item, block element or heading.
    """
    html = F.regexp_replace(F.col(html_column), r"(?is)<!--.*?-->", "")
    html = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>", "")
    sections = F.split(F.regexp_replace(html, rf"(?i)<{heading}(\s[^>]*)?>", _MARK), _MARK)

    def section(part: Column, place: Column) -> Column:
        title = F.regexp_extract(part, rf"(?is)^(.*?)</{heading}\s*>", 1)
        topic = F.when(place == 0, F.lit("")).otherwise(F.lower(_plain(title)))
        marked = F.regexp_replace(part, rf"(?i)<{item}(\s[^>]*)?>", _MARK + "+")
        marked = F.regexp_replace(marked, rf"(?i)</?({BLOCKS}|{item})(\s[^>]*)?/?>", _MARK)
        opened = F.filter(F.split(marked, _MARK), lambda piece: piece.startswith("+"))
        return F.transform(
            opened,
            lambda piece: F.struct(topic.alias("topic"), tidy_text(_plain(F.substring(piece, 2, 2**30))).alias("goal")),
        )

    items = F.posexplode(F.flatten(F.transform(sections, section))).alias("place", "_item")
    return pages.select(id_column, items).select(id_column, "_item.topic", "place", "_item.goal")


def goals_as_json(goals: DataFrame) -> DataFrame:
    """One JSON record ``{topic, goal}`` per item."""
    return goals.select(F.to_json(F.struct("topic", "goal")).alias("value"))
