"""Merkle trees over the sections and paragraphs of a text: fingerprints that tell equality, likeness and the place of an edit.

A text is cut into leaves, every one inside a sentence and of bounded length; leaves up to a line break are a paragraph.
A paragraph whose digest falls into a fixed share ends a section, so that an insertion moves no later boundary.  A node's
digest is the SHA-256 of its children's; the root stands for the whole text.  The fingerprint is the root with the tree
below it, every leaf by 24 bits, so that two texts are compared without being read again: equal branches count whole and
are not entered, differing ones are followed down to the leaves.
"""

from __future__ import annotations

import re
from base64 import b64encode
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerweave.llm.common import bounded_sample, map_arrow
from layerweave.session import keep_table

# Code points of a leaf before its closing marks.  Paragraphs whose digest begins so (one in eight) end a section.
LEAF_CHARS = 32
SECTION_ENDS = ("0", "1")
LEAF = rf"[^.!?\n]{{1,{LEAF_CHARS}}}[.!?]*\n*|[.!?]+\n*|\n+"
# Characters of a leaf in a fingerprint: base64 of three bytes.
DIGITS = 4

_leaves = re.compile(LEAF).findall


def _digest(level: str, content: str) -> str:
    return sha256((level + content).encode()).hexdigest()


class TextTree:
    """The tree of one text: ``sections`` of paragraphs of leaf digests, and the ``root``."""

    def __init__(self, text: str):
        self.leaves = _leaves(text)
        self.sections: list[list[list[str]]] = []
        paragraph: list[str] = []
        section: list[list[str]] = []
        names: list[str] = []
        tops: list[str] = []

        def close_paragraph() -> str:
            name = _digest("1", "".join(paragraph))
            section.append(paragraph)
            names.append(name)
            return name

        def close_section() -> None:
            self.sections.append(section)
            tops.append(_digest("2", "".join(names)))

        for leaf in self.leaves:
            paragraph.append(_digest("0", leaf))
            if leaf[-1] == "\n":
                ends = close_paragraph().startswith(SECTION_ENDS)
                paragraph = []
                if ends:
                    close_section()
                    section, names = [], []
        if paragraph:
            close_paragraph()
        if section:
            close_section()
        self.root = _digest("3", "".join(tops))

    def fingerprint(self) -> str:
        """``root:`` and the sections by ``;``, their paragraphs by ``,``, leaves as four characters each."""

        def spelled(paragraph: list[str]) -> str:
            return b64encode(bytes.fromhex("".join([leaf[:6] for leaf in paragraph]))).decode()

        return f"{self.root}:" + ";".join(",".join(map(spelled, section)) for section in self.sections)


def _size(branch: str) -> int:
    return (len(branch) - branch.count(",")) // DIGITS


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common, twice the common ones by all of both: 1 for equal texts.

    Sections in both are counted whole, then paragraphs of the others, then leaves; repeats pair off one by one.  The
    empty text is like itself only.
    """
    if a == b:
        return 1.0
    left, right = ([x for x in f.partition(":")[2].split(";") if x] for f in (a, b))
    total = sum(map(_size, left)) + sum(map(_size, right))
    if not left or not right:
        return 0.0
    shared = 0
    for cut in (lambda x: x.split(","), lambda x: [x[i:i + DIGITS] for i in range(0, len(x), DIGITS)], None):
        xs, ys = Counter(left), Counter(right)
        both = xs & ys
        shared += sum(_size(branch) * n for branch, n in both.items())
        if cut:
            left, right = ([part for branch in (side - both).elements() for part in cut(branch)] for side in (xs, ys))
    return 2.0 * shared / total


def edited_spans(old: TextTree, new: TextTree) -> list[tuple[int, int, int, int]]:
    """``old_start, old_end, new_start, new_end`` in code points of every place where the trees differ.

    Equal children at both ends of a pair of nodes are left aside; what is between is followed further down where it is
    one node on either side, and is one edit otherwise.
    """
    if old.root == new.root:
        return []
    starts = [list(accumulate(map(len, t.leaves), initial=0)) for t in (old, new)]

    def leaves(node) -> int:
        return 1 if isinstance(node, str) else sum(map(leaves, node))

    def walk(a: list, b: list, at: int, to: int) -> list[tuple[int, int, int, int]]:
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            at, to, head = at + leaves(a[head]), to + leaves(b[head]), head + 1
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        a, b = a[head:len(a) - tail], b[head:len(b) - tail]
        if not a and not b:
            return []
        if len(a) == len(b) and not isinstance(a[0], str):
            found = []
            for x, y in zip(a, b):
                found += walk(x, y, at, to)
                at, to = at + leaves(x), to + leaves(y)
            return found
        return [(starts[0][at], starts[0][at + leaves(a)], starts[1][to], starts[1][to + leaves(b)])]

    return walk(old.sections, new.sections, 0, 0)


SPANS = "array<struct<old_start:long, old_end:long, new_start:long, new_end:long>>"


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, root, fingerprint`` of every row; a null text counts as the empty one, a null id is kept."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        trees = [TextTree(t) for t in texts]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_chars": pa.array(map(len, texts), pa.int64()),
            "root": pa.array([t.root for t in trees], pa.string()), "fingerprint": pa.array([t.fingerprint() for t in trees], pa.string()),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_chars long, root string, fingerprint string")


def located_edits(pairs: DataFrame) -> DataFrame:
    """``key, likeness, edits`` for rows ``key, old, new`` of two texts; null texts count as empty ones."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        alike, spans = [], []
        for old, new in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist()):
            a, b = TextTree(old or ""), TextTree(new or "")
            alike.append(likeness(a.fingerprint(), b.fingerprint()))
            spans.append([dict(zip(("old_start", "old_end", "new_start", "new_end"), s)) for s in edited_spans(a, b)])
        place = pa.struct([(n, pa.int64()) for n in ("old_start", "old_end", "new_start", "new_end")])
        return pa.RecordBatch.from_pydict({"key": batch.column("key"), "likeness": pa.array(alike, pa.float64()), "edits": pa.array(spans, pa.list_(place))})

    kind = pairs.schema["key"].dataType.simpleString()
    return map_arrow(pairs.select("key", "old", "new"), run, f"key {kind}, likeness double, edits {SPANS}")


COMPARED = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
# Ranges of ids per shuffle partition, and rows looked at per range to choose where they begin.
RANGES = 4
SAMPLED = 16


def _compared(doc_id: int | None, text: str, own: str, after: str, after_own: str) -> tuple:
    edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
    made = TextTree(edited).fingerprint()
    return doc_id, len(text), sha256(edited.encode()).hexdigest(), own, made, likeness(own, made), likeness(own, after_own)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _schema(fields: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{name} {names[kind]}" for name, kind in fields)


Key = tuple[bool, int, int]
# Rows follow each other by id, missing ids last, then by a hash of the text.
ORDER = ("no_id", "known", "digest")
# Repeated rows that one task writes.
REPEATS = 50_000


def _range_starts(keys: DataFrame, ranges: int) -> tuple[list[Key], list[Key]]:
    """The first key of every range of the order, and those keys that fill a range with repeated rows.

    They come from a sample of at most ``SAMPLED`` rows a range, chosen by hash and counted by key; its size is set by the
    number of ranges.  The very first key of the table is one of them.
    """
    lowest = keys.agg(F.min(F.struct(*ORDER)).alias("k")).first()["k"]
    if lowest is None:
        return [], []
    sample = sorted(tuple(r) for r in bounded_sample(keys.withColumn("_row", F.monotonically_increasing_id()), [*ORDER, "_row"], ranges * SAMPLED).select(*ORDER).collect())
    chosen = Counter(sample[SAMPLED - 1::SAMPLED])
    return sorted({tuple(lowest), *chosen}), [key for key, n in chosen.items() if n > 1]


def _range_of(starts: list[Key]):
    """A function of key columns that gives the number of a row's range."""
    ids = np.array([s[1] for s in starts if not s[0]], np.int64)

    def find(no_id: pd.Series, known: pd.Series, digest: pd.Series) -> pd.Series:
        low, high = np.searchsorted(ids, known, "left"), np.searchsorted(ids, known, "right")
        at = low.astype(np.int64) - 1
        # Ids that some range begins with, and missing ids, are compared as a whole.
        for n in np.flatnonzero((high > low) | no_id.to_numpy()):
            at[n] = bisect_right(starts, (bool(no_id[n]), int(known[n]), int(digest[n]))) - 1
        return pd.Series(at)

    return F.pandas_udf(find, "long")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Every text beside its edited form, whose last half is the beginning of the next document, and beside that document.

    Columns as in ``COMPARED``.  The next document is the next row by ascending ``doc_id``; rows of equal id follow each
    other by a hash of the text, repeated rows count one by one, rows without an id come last, and after the last row
    comes the first.  A null text counts as empty; a table of one row is its own next; an empty one gives no rows; other
    columns are not read.

    Texts are shuffled once, into ranges of ids.  A copy of the first row of each range ends the range before, so that a
    task reads its rows in order, holds two of them, and needs no other task.  A row that is repeated so often that it
    fills a range is counted instead and goes through once; its repetitions follow themselves.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.coalesce("text", F.lit("")))]
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[c.alias(n) for c, n in zip(order, ORDER)])
    starts, crowded = _range_starts(placed.select(*ORDER), RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not starts:
        return spark.createDataFrame([], _schema(COMPARED))
    # As many rows as there are ranges.
    marks = spark.createDataFrame([(*key, n, key in set(crowded)) for n, key in enumerate(starts)], "no_id boolean, known long, digest long, number long, crowded boolean")
    tagged = placed.join(F.broadcast(marks), list(ORDER), "left")
    heads = tagged.filter(F.col("number").isNotNull()).groupBy(*ORDER, "number", "crowded").agg(
        F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    plain = tagged.filter(~F.coalesce("crowded", F.lit(False))).select("doc_id", "text", *ORDER)
    guests = heads.select("doc_id", "text", *ORDER, F.pmod(F.col("number") - 1, F.lit(len(starts))).alias("range"), F.lit(1).alias("guest"))
    own = plain.withColumn("range", _range_of(starts)(*ORDER)).withColumn("guest", F.lit(0))
    if crowded:
        heads = keep_table(heads.filter("crowded"))
        own = own.unionByName(heads.select("doc_id", "text", *ORDER, F.col("number").alias("range"), F.lit(0).alias("guest")))
    rows = own.unionByName(guests).repartition("range").sortWithinPartitions("range", "guest", *ORDER).select("doc_id", "text", "guest", "range")

    def follow(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, here = None, None
        for batch in source:
            made = []
            columns = [batch.column(c) for c in ("doc_id", "text", "guest", "range")]
            for doc_id, text, guest, place in zip(columns[0].to_pylist(), columns[1], *[c.to_pylist() for c in columns[2:]]):
                if before is not None and place != here:
                    raise RuntimeError("a range of documents has no end: the input changed between two reads")
                text = text.as_py()
                now = doc_id, text, TextTree(text).fingerprint()
                if before is not None:
                    made.append(_compared(*before, *now[1:]))
                before, here = None if guest else now, place
            yield _batch(made, COMPARED)
        if before is not None:
            raise RuntimeError("a range of documents has no end: the input changed between two reads")

    found = rows.mapInArrow(follow, _schema(COMPARED))
    if not crowded:
        return found
    rest = F.sequence(F.lit(1).cast("long"), F.col("copies") - 1, F.lit(REPEATS).cast("long"))
    parts = heads.filter("copies > 1").select("doc_id", "text", "copies", F.explode(rest).alias("first")).repartition("doc_id", "first")

    def alone(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for doc_id, text, copies, first in zip(*(c.to_pylist() for c in batch.columns)):
            own = TextTree(text).fingerprint()
            made.append((*_compared(doc_id, text, own, text, own), min(REPEATS, copies - first)))
        return _batch(made, [*COMPARED, ("times", pa.int64())])

    again = map_arrow(parts, alone, _schema([*COMPARED, ("times", pa.int64())]))
    again = again.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*[name for name, _ in COMPARED])
    return found.unionByName(again)
