"""N-gram Jaccard join: groups of texts whose shingle sets are similar, by signature trees.

Two sets that reach the threshold share a token among their first ones in any common order of all tokens (the prefix).
Tokens that very many documents hold come last in the order.  Documents meet at prefix tokens; there a tree over their
signatures, whose nodes hold OR-combined bitmaps and size ranges, is traversed against itself and drops every pair of
nodes that cannot reach the threshold.  What is left is compared exactly, over whole texts.

Merging rounds come first: every document proposes one of another group for each band of least hashes of its whole
set, so that dense groups of copies are joined by a linear number of comparisons a round.  The trees then look at
pairs that are still in different groups only.  Bitmaps of whole sets bound how much of one the other lacks: the search over
the trees tests them before it names a pair, and once more, at full width, before two texts are fetched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave.llm.common import digest, largest_counts, map_arrow, texts_of
from layerweave.operators.graph import connected_components
from layerweave.operators.skew import HotKeys, for_each_salt, hot_keys, spread_join, with_salt
from layerweave.session import forget_table, keep_table

#: At most so many tokens are put last in the order.  The order changes the cost only, never the result.
FREQUENT_TOKENS = 500_000
# A token counts as seen often in one task from so many documents on.
OFTEN = 4
BITS = 1024
FANOUT = 16
# Rows of a token that meet in one cell; a larger group becomes a grid of cells.  Cells share tasks of some BUCKET_ROWS;
# the tokens of a first holder that has more rows are dealt over several tasks.
CELL_ROWS = 1024
BUCKET_ROWS = 30_000
# Node pairs looked at in one step, different pairs held before they are sent on, and bytes of text spelled in one step;
# all bound the memory of a task.
STEP_PAIRS = 16_384
HELD_PAIRS = 1_000_000
CHUNK_BYTES = 4_000_000
SEGMENT_BYTES = 1_000_000
# Rows with two texts that are worked off at a time, and bytes of shingles that a task remembers.
PAIR_ROWS = 64
REMEMBERED_BYTES = 16_000_000
# Rows of one node or token that a task joins; those of a hotter one are spread over several.
HOT_ROWS = 50_000
# Bands of a set, and least hashes in one.  A band that two sets share proposes them to each other; both change the cost only.
BANDS = 6
BAND_HASHES = 2
# Bytes of a whole set's bitmap that go into the search over the trees; a wider one is folded.
BRIEF = 1024
#: Partners of a node that a search over the trees names first; when some are left out, it is repeated with WIDER times as
#: many once those found are joined, until none is left out.  Both change the cost only.
NEAREST = 32
WIDER = 4
#: A merging round is followed by another while it finds this share of the links of the first; changes the cost only.
WORTH = 0.1

_GAP = re.compile(rb"[ \t\n\v\f\r]")
_SIEVE = np.uint64((1 << 23) - 1)
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


_WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256).astype(np.uint64)
_ORDERS = np.random.default_rng(21).integers(0, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2^64


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    return made[0], made[1]


def _hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and their 64-bit hashes.

    A word's polynomial is the difference of two running sums over the text, moved to the word's beginning.
    """
    codes = np.frombuffer(text, np.uint8)
    white = _WHITE[codes]
    begins = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    ends = np.flatnonzero(~white & np.concatenate([white[1:], [True]]))
    up, down = _powers(max(SEGMENT_BYTES * 2, len(codes)))
    terms = _BYTES[codes] * up[:len(codes)]
    sums = np.cumsum(terms)
    hashes = (sums[ends] - sums[begins] + terms[begins]) * down[begins]
    hashes ^= (ends - begins).astype(np.uint64) << np.uint64(48)
    hashes ^= hashes >> np.uint64(31)
    hashes *= _MIX[0]
    return begins, hashes ^ (hashes >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row (A-Z lower-cased), and how many each text has."""
    joined = b"\n".join(texts).lower()
    offsets = np.cumsum([0, *(len(text) + 1 for text in texts)])
    places, hashes, begin = [], [], 0
    while begin < len(joined):
        end = begin + SEGMENT_BYTES  # cut between words; a longer word stays whole
        cut = _GAP.search(joined, end)
        end = cut.end() if cut and end < len(joined) else len(joined)
        found, values = _hash_words(joined[begin:end])
        places.append(found + begin)
        hashes.append(values)
        begin = end
    if not places:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(places), offsets))


def spell(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of whole texts in a row, as 64-bit hashes, and how many each text has.

    A text with fewer words is one shingle, a blank one has none.
    """
    hashes, lengths = word_hashes(texts)
    counts = np.where(lengths >= words, lengths - words + 1, np.minimum(lengths, 1))
    out = np.zeros(int(counts.sum()), np.uint64)
    last = len(hashes) - words + 1
    if last > 0:
        mixed = np.zeros(last, np.uint64)
        for place in range(words):
            mixed ^= hashes[place:place + last]
            mixed *= _MIX[place % len(_MIX)]
            mixed ^= mixed >> np.uint64(29)
        # A shingle must not reach into the next text.
        inside = np.arange(last) + words <= np.repeat(np.cumsum(lengths), lengths)[:last]
        out[np.repeat(lengths >= words, counts)] = mixed[inside]
    starts, first = np.cumsum(counts) - counts, np.cumsum(lengths) - lengths
    for at in np.flatnonzero((lengths > 0) & (lengths < words)):
        own = hashes[first[at]:first[at] + lengths[at]].tobytes()
        out[starts[at]] = xxhash.xxh64_intdigest(own, seed=words)
    return out, counts


def _distinct(tokens: np.ndarray) -> np.ndarray:
    tokens = np.sort(tokens)
    return tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if len(tokens) else tokens


def shingles(text: bytes, words: int) -> np.ndarray:
    """The different shingles of one whole text, sorted."""
    return _distinct(spell([text], words)[0])


def chunks(texts: list[bytes]):
    """Slices of the texts of about CHUNK_BYTES each."""
    begin, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_BYTES or at == len(texts) - 1:
            yield texts[begin:at + 1]
            begin, size = at + 1, 0


def prefix_size(n: np.ndarray | int, percent: int):
    """How many first tokens of a set of ``n`` must hold one that a similar set holds among its own."""
    return n - -(-percent * n // 100) + 1


def bitmap(tokens: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[tokens % np.uint64(BITS)] = 1
    return np.packbits(bits).tobytes()


def sketch(tokens: np.ndarray) -> bytes:
    """A bitmap of a whole set, with four to eight bits a token."""
    width = 1 << max(9, int(4 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[tokens & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(wide: bytes, width: int) -> np.ndarray:
    """A sketch at ``width`` bytes, which it has at least."""
    return np.bitwise_or.reduce(np.frombuffer(wide, np.uint64).reshape(-1, width // 8), axis=0)


def bands(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS keys of every text from its shingles in ``flat``: equal where the least hashes of a band are; zero without shingles."""
    keys = np.zeros((len(counts), BANDS), np.uint64)
    some = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[some]
    for band in range(BANDS if len(some) else 0):
        mixed = np.full(len(some), band + 1, np.uint64)
        for order in range(BAND_HASHES):
            mixed = (mixed ^ np.minimum.reduceat(flat * _ORDERS[band * BAND_HASHES + order], starts)) * _MIX[order % len(_MIX)]
            mixed ^= mixed >> np.uint64(29)
        keys[some, band] = mixed
    return keys


def may_be_similar(a: bytes, b: bytes, n_a: int, n_b: int, percent: int) -> bool:
    """Whether sets with these sketches can reach the threshold.

    A bit that only one of the sets has is a token that the other lacks.  The wider sketch is folded to the other's width.
    """
    least = -(-percent * (n_a + n_b) // (100 + percent))
    if least > min(n_a, n_b):
        return False
    width = min(len(a), len(b))
    x, y = (fold(side, width) for side in (a, b))
    return int(np.bitwise_count(x & ~y).sum()) <= n_a - least and int(np.bitwise_count(y & ~x).sum()) <= n_b - least


@lru_cache(maxsize=2)
def _frequent(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequent tokens in ascending order of hash, the place of each in the order of all tokens, and a sieve."""
    by_place = np.frombuffer(packed, np.uint64)
    order = np.argsort(by_place, kind="stable")
    maybe = np.zeros(int(_SIEVE) + 1, bool)
    maybe[by_place & _SIEVE] = True
    return by_place[order], order, maybe


def in_order(tokens: np.ndarray, frequent: bytes) -> np.ndarray:
    """Tokens by hash, the frequent ones after all others."""
    known, place, maybe = _frequent(frequent)
    suspects = np.flatnonzero(maybe[tokens & _SIEVE])
    if not len(suspects) or not len(known):
        return tokens
    at = np.minimum(np.searchsorted(known, tokens[suspects]), len(known) - 1)
    found = known[at] == tokens[suspects]
    late = suspects[found]
    return np.concatenate([np.delete(tokens, late), tokens[late][np.argsort(place[at[found]], kind="stable")]])


def frequent_tokens(docs: DataFrame, words: int, most: int = FREQUENT_TOKENS) -> bytes:
    """The tokens that tasks meet most often, rarer ones first.  All documents are counted."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for texts in chunks(texts_of(batch)):
            tokens, _ = spell(texts, words)
            cells = (tokens >> np.uint64(42)).astype(np.int64)
            often = np.bincount(cells, minlength=1 << 22)[cells] >= OFTEN
            tokens, count = np.unique(tokens[often], return_counts=True)
            kept.append((tokens[count >= OFTEN], count[count >= OFTEN]))
        return pa.RecordBatch.from_pydict({
            "token": np.concatenate([t for t, _ in kept]).view(np.int64), "n": np.concatenate([n for _, n in kept]).astype(np.int64),
        })

    counts = map_arrow(docs.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = largest_counts(keep_table(counts), "token", "n", most)
    return rows.column("token").to_numpy()[::-1].astype(np.int64).view(np.uint64).tobytes()


def row_key() -> Column:
    """One key for id and text together; rows equal in both are one document."""
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(name, F.lit(":"), digest("text"))))


def sets_of(docs: DataFrame, words: int, percent: int, frequent: bytes) -> DataFrame:
    """``doc_id, row_key, n, digest, bits, sketch, bands, prefix`` per row; equal sets have equal digests."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digests, bits, sketches, keys, prefixes = [], [], [], [], [], []
        for texts in chunks(texts_of(batch)):
            flat, counts = spell(texts, words)
            keys += [own.tobytes() for own in bands(flat, counts)]
            for part in np.split(flat, np.cumsum(counts)[:-1]):
                tokens = _distinct(part)
                first = in_order(tokens, shared.value)[:prefix_size(len(tokens), percent)]
                n.append(len(tokens))
                digests.append(hashlib.md5(tokens.tobytes()).digest())
                bits.append(bitmap(first))
                sketches.append(sketch(tokens))
                prefixes.append(first.tobytes())
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "n": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()),
            "bits": pa.array(bits, pa.binary()), "sketch": pa.array(sketches, pa.binary()), "bands": pa.array(keys, pa.binary()),
            "prefix": pa.array(prefixes, pa.binary()),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key().alias("row_key"), "text")
    return map_arrow(rows, run, f"doc_id {kind}, row_key binary, n long, digest binary, bits binary, sketch binary, bands binary, prefix binary")


class SignatureTree:
    """Records under nodes of FANOUT children; a node ORs the bitmaps and spans the sizes below it.

    Records lie in the order of the cell in which they meet, then of their size; a node also spans cells and groups, so
    one tree serves many cells.
    """

    def __init__(self, bits: np.ndarray, n: np.ndarray, group: np.ndarray, percent: int, cell: np.ndarray | None = None, block: np.ndarray | None = None):
        cell = np.zeros(len(n), np.int64) if cell is None else cell
        #: Records of one block of a cell of two blocks do not meet there; -1 stands for a cell of one block.
        self.block = np.full(len(n), -1) if block is None else block
        rest = n - prefix_size(n, percent)
        spare = prefix_size(n, percent) - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        level = (bits, n, n, rest, spare, group, group, cell, cell)
        joins = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.maximum, np.minimum, np.maximum, np.minimum, np.maximum)
        self.levels = [level]
        while len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), FANOUT)
            level = tuple(join.reduceat(column, starts, axis=0) for join, column in zip(joins, level))
            self.levels.append(level)

    def may_match(self, level: int, a: np.ndarray, b: np.ndarray, percent: int, other: SignatureTree | None = None) -> np.ndarray:
        """Which node pairs may still hold a pair of records of different groups that reaches the threshold.

        Common prefix tokens are at most the common bits and the tokens that share a bit with another; all other common
        tokens lie behind one of the two prefixes.
        """
        bits, least, most, rest, spare, low, high, first, last = self.levels[level]
        bits2, least2, most2, rest2, spare2, low2, high2, first2, last2 = (other or self).levels[level]
        meet = (first[a] <= last2[b]) & (first2[b] <= last[a])
        meet &= (100 * most[a] >= percent * least2[b]) & (100 * most2[b] >= percent * least[a])
        meet &= ~((low[a] == high[a]) & (low2[b] == high2[b]) & (low[a] == low2[b]))
        held = np.flatnonzero(meet)
        a, b = a[held], b[held]
        common = np.bitwise_count(bits[a] & bits2[b]).sum(axis=1, dtype=np.int64) + np.minimum(spare[a], spare2[b])
        meet[held] = (100 + percent) * (common + np.maximum(rest[a], rest2[b])) >= percent * (least[a] + least2[b])
        return meet

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of records that no bound can exclude."""
        found = [(np.empty(0, np.int64),) * 2, *self.steps(percent)]
        return tuple(np.concatenate(side) for side in zip(*found))

    def steps(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs in pieces, by traversing the tree against itself.

        A lower level goes first once it has a whole step, so that few node pairs wait, whatever the number of pairs.
        """
        width = STEP_PAIRS // FANOUT
        waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.levels]
        waiting[-1].append((np.zeros(1, np.int64),) * 2)
        size = [sum(len(a) for a, _ in level) for level in waiting]
        while any(size):
            level = next((k for k, n in enumerate(size) if n >= width), max(k for k, n in enumerate(size) if n))
            a, b = (np.concatenate(side) for side in zip(*waiting[level]))
            waiting[level], size[level] = [(a[width:], b[width:])], max(0, len(a) - width)
            a, b = a[:width], b[:width]
            held = self.may_match(level, a, b, percent)
            a, b = a[held], b[held]
            if not level:
                yield a, b
            elif len(a):
                below = self._children(a, b, len(self.levels[level - 1][0]), level - 1)
                waiting[level - 1].append(below)
                size[level - 1] += len(below[0])

    def _children(self, a: np.ndarray, b: np.ndarray, below: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children of the node pairs that meet in a cell, each pair once."""
        steps = np.arange(FANOUT)
        shape = (len(a), FANOUT, FANOUT)
        left = np.broadcast_to((a[:, None] * FANOUT + steps)[:, :, None], shape).ravel()
        right = np.broadcast_to((b[:, None] * FANOUT + steps)[:, None, :], shape).ravel()
        real = (left < below) & (right < below) & (left <= right if level else left < right)
        left, right = left[real], right[real]
        first, last = self.levels[level][7:]
        meet = (first[left] <= last[right]) & (first[right] <= last[left])
        if not level:
            meet &= (self.block[left] != self.block[right]) | (self.block[left] < 0)
        return left[meet], right[meet]


def _nearest(pairs: np.ndarray, bits: np.ndarray, best: int) -> np.ndarray:
    """Those of ``pairs`` (place of the first times all plus place of the second) that are among the ``best`` of either
    record by the share of common bits."""
    a, b = np.divmod(pairs, len(bits))
    share = np.empty(len(pairs))
    for begin in range(0, len(pairs), STEP_PAIRS):
        x, y = bits[a[begin:begin + STEP_PAIRS]], bits[b[begin:begin + STEP_PAIRS]]
        both, either = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (x & y, x | y))
        share[begin:begin + STEP_PAIRS] = both / np.maximum(either, 1)
    own = np.concatenate([a, b])
    order = np.lexsort((np.tile(-share, 2), own))
    own = own[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    return pairs[np.unique(order[place < best] % len(pairs))] if len(pairs) else pairs


def _by_sketch(pairs: np.ndarray, sketches: list[bytes], n: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``pairs`` (see ``_nearest``) that ``may_be_similar`` cannot exclude."""
    a, b = np.divmod(pairs, len(n))
    least = -(-percent * (n[a] + n[b]) // (100 + percent))
    widths = np.array([len(s) for s in sketches])
    width, keep = np.minimum(widths[a], widths[b]), least <= np.minimum(n[a], n[b])
    for w in np.unique(width[keep]):
        at = np.flatnonzero(keep & (width == w))
        own = np.unique(np.concatenate([a[at], b[at]]))
        folded, place = np.stack([fold(sketches[k], w) for k in own]), np.zeros(len(n), np.int64)
        place[own] = np.arange(len(own))
        step = max(1, STEP_PAIRS * BITS // 8 // int(w))
        for some in (at[begin:begin + step] for begin in range(0, len(at), step)):
            x, y = folded[place[a[some]]], folded[place[b[some]]]
            lacks, other = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (x & ~y, y & ~x))
            keep[some] = (lacks <= n[a[some]] - least[some]) & (other <= n[b[some]] - least[some])
    return pairs[keep]


def candidates(table: pa.Table, percent: int, best: int | None = None, sketches: list[bytes] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Node ids of the pairs of records that meet in a cell and that neither the tree nor ``sketches`` (of whole sets, in the
    order of the nodes) can exclude.

    A pair that meets in many cells is named once in HELD_PAIRS different ones.  With ``best`` only pairs among the nearest
    of either record are named; if any is left out, the last pair is -1, -1.
    """
    cell, block, node, n, group = (table.column(c).to_numpy() for c in ("cell", "block", "node", "n", "component"))
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)
    order = np.lexsort((node, n, cell))
    names, first, place = np.unique(node[order], return_index=True, return_inverse=True)
    own_bits, own_n = bits[order[first]], n[order[first]]
    known, fresh, size, cut = np.empty(0, np.int64), [], 0, False  # a pair is one number: place of the first times all plus place of the second

    def sifted(pairs: np.ndarray) -> tuple[np.ndarray, bool]:
        if sketches is not None:
            pairs = _by_sketch(pairs, sketches, own_n, percent)
        chosen = pairs if best is None else _nearest(pairs, own_bits, best)
        return chosen, len(chosen) < len(pairs)

    for a, b in SignatureTree(bits[order], n[order], group[order], percent, cell[order], block[order]).steps(percent):
        a, b = place[a], place[b]
        fresh.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
        size += len(a)
        if size >= max(STEP_PAIRS, len(known)):
            known, fresh, size = np.unique(np.concatenate([known, *fresh])), [], 0
            if len(known) >= HELD_PAIRS:
                known, fewer = sifted(known)
                cut |= fewer
                if len(known) >= HELD_PAIRS // 2:
                    yield tuple(names[side] for side in np.divmod(known, len(names)))
                    known = known[:0]
    known = np.unique(np.concatenate([known, *fresh]))
    chosen, fewer = sifted(known)
    yield tuple(names[side] for side in np.divmod(chosen, max(1, len(names))))
    if cut or fewer:
        yield np.array([-1]), np.array([-1])


class _Remembered(dict):
    """The shingles of the texts met last, at most REMEMBERED_BYTES of them."""

    def __init__(self, words: int):
        self.words, self.size = words, 0

    def __missing__(self, text: bytes) -> np.ndarray:
        made = shingles(text, self.words)
        cost = len(text) + made.nbytes
        if cost <= REMEMBERED_BYTES:
            if self.size + cost > REMEMBERED_BYTES:
                self.clear()
                self.size = 0
            self[text], self.size = made, self.size + cost
        return made


def attach(rows: DataFrame, key: str, spread: str, facts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows`` with the one row of ``facts`` of their key; the rows of a ``hot`` key (``key, splits``) lie in several tasks."""
    if hot is None:
        return rows.join(facts.hint("merge"), key)
    return with_salt(rows, [key], [F.col(spread)], hot).join(for_each_salt(facts, [key], hot).hint("merge"), [key, "_salt"]).drop("_salt")


def hot_tokens(held: DataFrame) -> DataFrame | None:
    """``token, splits`` of the tokens with more than HOT_ROWS ``holders``, at most 200,000 of them; None without such."""
    held = held.filter(F.col("holders") > HOT_ROWS).select("token", "holders").distinct()
    total = held.agg(F.sum("holders")).first()[0]
    if not total:
        return None
    limit = max(HOT_ROWS, total // 200_000)
    return held.filter(F.col("holders") > limit).select("token", F.ceil(F.col("holders") / F.lit(limit)).cast("int").alias("splits"))


def by_sketch(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sketches leave them a chance.  A node of very many pairs is spread over tasks."""
    known = keep_table(pairs)
    both, rows = known, known.count()
    for side, other in ("ab", "ba"):
        own = sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        both = attach(both, side, other, own, hot_keys(known, [side], rows, HOT_ROWS))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for begin in range(0, batch.num_rows, STEP_PAIRS):
            part = batch.slice(begin, STEP_PAIRS)
            columns = [part.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b")]
            keep += [may_be_similar(*row, percent) for row in zip(*columns)]
        chosen = batch.select(["a", "b"]).filter(pa.array(keep))
        return pa.RecordBatch.from_pydict({"a": chosen.column("a"), "b": chosen.column("b")})

    left = keep_table(map_arrow(both, run, "a long, b long"))
    forget_table(known)
    return left


def similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int, repeated: bool) -> DataFrame:
    """The pairs of the stored table ``a, b`` whose whole texts reach the threshold, as ``src, dst``.

    ``repeated`` says that some rows of ``docs`` are equal in id and text, of which one is taken.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "row_key"), "node")
    wanted = keep_table(wanted)
    rows = docs.select(row_key().alias("row_key"), "text")
    found = spread_join(rows, wanted, ["row_key"], [F.col("text")], HotKeys(rows, ["row_key"]), wanted.count(), text_bytes=0)
    if repeated:  # equal in text, so any of them stands for its node
        found = found.groupBy("node").agg(F.first("text").alias("text"))
    texts = keep_table(found.select("node", "text"))
    both, count = pairs, pairs.count()
    for side, other in ("ab", "ba"):
        own = texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
        both = attach(both, side, other, own, hot_keys(pairs, [side], count, HOT_ROWS))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, remembered = [], _Remembered(words)  # heads and rows come again and again
        for begin in range(0, batch.num_rows, PAIR_ROWS):
            part = batch.slice(begin, PAIR_ROWS)
            for x, y in zip(texts_of(part, "text_a"), texts_of(part, "text_b")):
                tokens, other = remembered[x], remembered[y]
                common = len(np.intersect1d(tokens, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(tokens) + len(other) - common))
        chosen = batch.select(["a", "b"]).filter(pa.array(keep))
        return pa.RecordBatch.from_pydict({"src": chosen.column("a"), "dst": chosen.column("b")})

    links = keep_table(map_arrow(both, run, "src long, dst long"))
    for used in (pairs, wanted, texts):
        forget_table(used)
    return links


def meetings(told: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``cell, block, node, component, task``, and the ``facts`` of the node, of every row of a token whose holders are in
    different components.

    ``told`` has ``token, node, holders, head, component``.  Tokens with the same first holder mostly have the same
    holders: one task sees a pair's tokens and names it once.  A first holder whose tokens bring more than BUCKET_ROWS rows
    has its tokens dealt over several tasks by their hash; a pair is then named once in each.
    """
    mixed = told.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.first("head").alias("head"), F.first("holders").alias("holders")
    ).filter(F.col("low") != F.col("high"))
    # At most two blocks of a token meet in one task, whatever the number of its holders.
    rows = F.sum(F.least(F.col("holders"), F.lit(2 * CELL_ROWS)))
    dealt = mixed.groupBy("head").agg(F.ceil(rows / F.lit(BUCKET_ROWS)).alias("salts"))
    salted = mixed.select("token", "head").join(dealt.hint("merge"), "head").select("token", F.pmod(F.xxhash64("token"), F.col("salts")).alias("salt"))
    open_rows = told.join(salted.hint("merge"), "token")
    if facts is not None:
        open_rows = open_rows.join(facts.hint("merge"), "node")
    cells = F.ceil(F.col("holders") / F.lit(CELL_ROWS)).cast("int")
    placed = open_rows.withColumn("cells", cells).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    return placed.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select(
        F.xxhash64("token", F.least("_own", "_k"), F.greatest("_own", "_k")).alias("cell"),
        # In a cell of two blocks only rows of different blocks meet; a chance clash of cells adds pairs, which are compared later.
        F.when(F.col("_own") == F.col("_k"), F.lit(-1)).otherwise(F.col("_own")).alias("block"), "node", "component",
        *([] if facts is None else [c for c in facts.columns if c != "node"]),
        F.xxhash64("head", "salt", F.least("_own", "_k"), F.greatest("_own", "_k")).alias("task"),
    )


def prepared(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, bool]:
    """Different sets by ``node``, the rows of ``docs`` with their node, and whether rows are repeated."""
    rows = keep_table(sets_of(docs, words, percent, frequent_tokens(docs, words)))
    alike = rows.filter(F.col("n") > 0).groupBy("digest").agg(
        F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch"),
        F.first("bands").alias("bands"), F.first("prefix").alias("prefix"),
    )
    whole = keep_table(alike.withColumn("node", F.monotonically_increasing_id()))  # written once, so the numbers stay
    member = keep_table(rows.select("doc_id", "row_key", "n", "digest").join(whole.select("digest", "node").hint("merge"), "digest", "left").drop("digest"))
    forget_table(rows)
    repeated = not member.groupBy("row_key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1).isEmpty()
    return whole, member, repeated


def postings(sets: DataFrame, column: str, groups: DataFrame | None = None) -> DataFrame:
    """``token, node, holders, head, component`` of the tokens in ``column`` whose holders are in different components.

    ``groups`` has ``node, component`` of the nodes that are not alone.
    """
    rows = sets.select("node", column)
    if groups is not None:
        rows = spread_join(rows, groups, ["node"], [F.col("node")], HotKeys(rows, ["node"], 0), groups.count(), "left")
    rows = rows.select("node", (F.col("node") if groups is None else F.coalesce("component", "node")).alias("component"), column)

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [np.frombuffer(p, np.int64) for p in batch.column(column).to_pylist()]
        size = [len(t) for t in tokens]
        node, component = (np.repeat(batch.column(c).to_numpy(), size) for c in ("node", "component"))
        return pa.RecordBatch.from_pydict({"token": np.concatenate(tokens), "node": node, "component": component})

    every = keep_table(map_arrow(rows, spread, "token long, node long, component long"))
    # A token with one holder links nothing, nor does one whose holders are joined already.
    held = every.groupBy("token").agg(
        F.count(F.lit(1)).alias("holders"), F.min("node").alias("head"), F.min("component").alias("_low"), F.max("component").alias("_high")
    ).filter(F.col("_low") != F.col("_high")).drop("_low", "_high")
    held = keep_table(held)
    live = keep_table(attach(every, "token", "node", held, hot_tokens(held)))
    forget_table(every)
    forget_table(held)
    return live


def tree_links(
    told: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int, repeated: bool, best: int | None = None, tried: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, bool]:
    """``src, dst``: the similar nodes of different components that share a token of ``told`` (see ``meetings``); the pairs
    ``a, b`` that were looked at; whether others were left out, which happens only with ``best`` (see ``candidates``).

    Pairs ``tried`` before are left out.
    """
    placed = keep_table(meetings(told))
    buckets = max(1, -(-placed.count() // BUCKET_ROWS))

    def brief(batch: pa.RecordBatch) -> pa.RecordBatch:
        sketches = [own if len(own) <= BRIEF else fold(own, BRIEF).tobytes() for own in batch.column("sketch").to_pylist()]
        return batch.set_column(batch.schema.get_field_index("sketch"), "sketch", pa.array(sketches, pa.binary()))

    # The facts of a node go once into each task, as a row without a cell, not with each of its tokens.
    dealt = placed.select("cell", "block", "node", "component", F.pmod("task", F.lit(buckets)).alias("_bucket"))
    facts = map_arrow(sets.select("node", "n", "bits", "sketch"), brief, "node long, n long, bits binary, sketch binary")
    known = dealt.select("_bucket", "node").distinct().join(facts.hint("merge"), "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        own = table.filter(pc.is_null(table.column("cell"))).sort_by("node")
        rows = table.filter(pc.is_valid(table.column("cell"))).select(["cell", "block", "node", "component"])
        at = pa.array(np.searchsorted(own.column("node").to_numpy(), rows.column("node").to_numpy()))
        for column in ("n", "bits"):
            rows = rows.append_column(column, own.column(column).take(at))
        for a, b in candidates(rows, percent, best, own.column("sketch").to_pylist()):
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    named = dealt.unionByName(known, allowMissingColumns=True).groupBy("_bucket").applyInArrow(search, "a long, b long").distinct()
    near = keep_table(named if tried is None else named.join(tried.hint("merge"), ["a", "b"], "left_anti"))
    forget_table(placed)
    pairs = near.filter(F.col("a") >= 0)
    links = similar(by_sketch(pairs, sets, percent), sets, docs, words, percent, repeated)
    return links, pairs, not near.filter(F.col("a") < 0).isEmpty()


def all_links(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Every link, those inside a component too.

    The first table has ``doc_id, row_key, n_shingles, node`` per row of ``docs``; rows of one node have equal sets and are
    all linked, rows without a word have no node.  The second has every pair ``src, dst`` of different nodes that reach the
    threshold, once; it is as large as the answer, which inside a dense group is the square of its different sets.
    """
    sets, member, repeated = prepared(docs, words, percent)
    return member.withColumnRenamed("n", "n_shingles"), tree_links(postings(sets, "prefix"), sets, docs, words, percent, repeated)[0]


def link_counts(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, row_key, n_shingles, n_links``: to how many other documents every row of ``docs`` is linked.

    Rows equal in id and text are one document.
    """
    member, links = all_links(docs, words, percent)
    heads = keep_table(member.filter(F.col("node").isNotNull()).select("node", "row_key").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("alike")))
    ways = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    other = ways.join(heads.withColumnRenamed("node", "dst").hint("merge"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("alike").alias("others"))
    counts = heads.join(other.hint("merge"), "node", "left").select("node", (F.col("alike") - F.lit(1) + F.coalesce("others", F.lit(0))).alias("_links"))
    return member.join(counts.hint("merge"), "node", "left").select("doc_id", "row_key", "n_shingles", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))


def linked(links: DataFrame) -> DataFrame:
    """``node, component`` of the nodes with a link; all others stand alone."""
    nodes = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return connected_components(nodes, links, by=()).select(F.col("id").alias("node"), "component")


def proposals(told: DataFrame, tried: DataFrame | None, turn: int, hot: DataFrame | None = None) -> DataFrame:
    """``a, b`` (the smaller first): for every node of ``token, node, component`` at most one node of another component a token.

    Of a token's holders one is proposed to all in other components, so the choice is linear in the holders: any one in the
    first ``turn``, later one of the smallest component, which a large group mostly is; the others of that group then have
    nothing to propose.  Pairs ``tried`` before are left out.
    """
    any_of = F.xxhash64("token", "node", F.lit(turn))
    ends = told.groupBy("token").agg(
        F.min(F.struct((F.col("component") if turn else F.lit(0)).alias("group"), any_of.alias("draw"), "component", "node")).alias("first"),
        F.min("component").alias("low"), F.max("component").alias("high"),
    ).filter(F.col("low") != F.col("high")).select("token", F.col("first.component").alias("_group"), F.col("first.node").alias("_hub"))
    open_rows = attach(told.select("token", "node", "component"), "token", "node", ends, hot).filter(F.col("component") != F.col("_group"))
    pairs = open_rows.select(F.least("node", "_hub").alias("a"), F.greatest("node", "_hub").alias("b")).distinct()
    return pairs if tried is None else pairs.join(tried.hint("merge"), ["a", "b"], "left_anti")


def in_components(live: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``live`` with the component that ``links`` give their node."""
    joined = live.drop("component").join(linked(links).hint("merge"), "node", "left")
    return keep_table(joined.withColumn("component", F.coalesce("component", "node")))


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, row_key, n_shingles, component_id, first``: one row per row of ``docs``.

    Two rows are linked when 100 * common shingles >= ``percent`` * all their shingles; ``component_id`` is the smallest
    id reachable by links, ``first`` the key of a row that stands for the component (the smallest id, then key).  Texts
    without a word (null, empty, blank) have no shingles and stand alone.  Equal sets are one node whatever their number.
    Null ids never become a component's id unless no other is there.  An empty table gives an empty table; columns other
    than doc_id and text are not read.
    """
    sets, member, repeated = prepared(docs, words, percent)
    live = told = postings(sets, "bands")
    hot = hot_tokens(live)
    links = tried = None
    most = found = turn = 0
    while links is None or found > WORTH * most:
        asked = keep_table(proposals(told, tried, turn, hot))
        made = similar(by_sketch(asked, sets, percent), sets, docs, words, percent, repeated)
        found = made.count()
        most, turn = max(most, found), turn + 1
        tried = asked if tried is None else tried.unionByName(asked)
        links = made if links is None else links.unionByName(made)
        if found > WORTH * most:
            told = in_components(live, links)

    # Tokens whose holders are still in different groups.  In a dense group the nearest join it, and few pairs are left.
    groups = keep_table(linked(links))
    live = told = postings(sets, "prefix", groups)
    best, open_pairs = NEAREST, True
    while open_pairs:
        more, looked_at, open_pairs = tree_links(told, sets, docs, words, percent, repeated, best, tried)
        links = links.unionByName(more)
        if open_pairs:
            told, best = in_components(live, links), best * WIDER
            tried = tried.unionByName(looked_at)
    groups = linked(links)
    member = member.join(groups.hint("merge"), "node", "left")
    member = keep_table(member.withColumn("component", F.coalesce("component", "node")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
    heads = member.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(order).alias("_head"))
    return member.join(heads.hint("merge"), "component", "left").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"),
        F.when(F.col("_head").isNull(), F.col("doc_id")).otherwise(F.col("_head.id")).alias("component_id"),
        F.coalesce(F.col("_head.key"), F.col("row_key")).alias("first"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns; rows without a word stay."""
    kept = components(docs, words, percent).filter((F.col("row_key") == F.col("first")) | (F.col("n_shingles") == 0))
    kept = kept.select(F.col("row_key").alias("_kept")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, row_key().alias("_key"), "text", "doc_id").join(kept.hint("merge"), F.col("_key") == F.col("_kept"), "left_semi")
    # Rows equal in id and text are copies of one document, of which one stays unless it has no words.
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    tie = F.when(blank, F.monotonically_increasing_id())
    single = rows.withColumn("_tie", tie).groupBy("_key", "_tie").agg(F.min("_row").alias("_row"))
    return single.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
