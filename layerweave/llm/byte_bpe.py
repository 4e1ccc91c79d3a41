"""Byte-level BPE by backtracking over longest matches.

The bytes of a piece become Latin-1 characters, so that an Aho-Corasick automaton finds every token inside it in one
pass.  A piece is encoded from the left with the longest token that fits; two neighbours fit when the merges would leave
them side by side, which is remembered per pair.  A place from which no token fits is marked once and never tried again,
so the work is linear in the piece, and the tokens are those that the merges give.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from layerweave.llm.common import map_arrow

# Entries after which a worker forgets the pieces and pairs that it remembers; results do not depend on it.
REMEMBERED = 400_000
NONE = -1


class ByteBPE:
    """Encoder and decoder of one rank file (base64 token, rank) and one pattern that cuts texts into pieces."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.rank = {base64.b64decode(token).decode("latin-1"): int(number) for token, number in pairs}
        if any(chr(byte) not in self.rank for byte in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.cut = regex.compile(pattern).findall
        self.token = dict(sorted((number, token) for token, number in self.rank.items()))
        self.matcher = ahocorasick.Automaton()
        for token, number in self.rank.items():
            self.matcher.add_word(token, (number, len(token)))
        self.matcher.make_automaton()
        self.shorter = {number: self._longest_start(token) for number, token in self.token.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        for number, token in self.token.items():
            self._learn_merge(number, token)
        self.pairs.clear()  # some were asked for before all merges were known
        self.packed: dict[str, bytes] = {}
        self.width = np.zeros(max(self.token) + 1, np.int64)
        for number, token in self.token.items():
            self.width[number] = len(token)
        self.start = np.cumsum(self.width) - self.width
        self.bytes = np.zeros(int(self.width.sum()), np.uint8)
        for number, token in self.token.items():
            self.bytes[self.start[number]:self.start[number] + len(token)] = np.frombuffer(token.encode("latin-1"), np.uint8)

    def _longest_start(self, token: str) -> int:
        """The longest other token with which this one starts."""
        return next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), NONE)

    def _learn_merge(self, number: int, token: str) -> None:
        """The pair of earlier tokens from which the merges make this one."""
        left = self.shorter[number]
        while left != NONE:
            right = self.rank.get(token[len(self.token[left]):], NONE)
            if NONE < right < number and left < number and self._side_by_side(left, right):
                self.halves[number] = (left, right)
                self.merged[left, right] = number
                return
            left = self.shorter[left]

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether the merges leave these tokens as neighbours.

        The merges next to the border are undone, the latest first.  If the tokens then at the border would have merged
        before the merge that was undone last, the border would not exist; ties go to the merge further left.
        """
        before = len(self.width) if hasattr(self, "width") else len(self.rank) + 1
        halves = self.halves
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            left_first = left > right
            if left_first and left not in halves or not left_first and right not in halves:
                left_first = not left_first  # a single byte cannot be undone; the other side is next
                if left_first and left not in halves or not left_first and right not in halves:
                    return True
            if left_first:
                before, left = left, halves[left][1]
            else:
                before, right = right + 1, halves[right][0]

    def fits(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self._side_by_side(left, right)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one piece, whose bytes are given as Latin-1 characters."""
        if piece in self.rank:
            return [self.rank[piece]]
        longest = [NONE] * len(piece)
        for last, (number, length) in self.matcher.iter(piece):
            longest[last + 1 - length] = number  # matches that end later are longer
        hopeless = bytearray(len(piece) + 1)
        ids: list[int] = []
        place, number = 0, longest[0]
        while True:
            after = place + len(self.token[number])
            if not hopeless[after] and (not ids or self.fits(ids[-1], number)):
                ids.append(number)
                if after == len(piece):
                    return ids
                place, number = after, longest[after]
                continue
            number = self.shorter[number]
            while number == NONE:
                hopeless[place] = 1
                number = ids.pop()
                place -= len(self.token[number])
                number = self.shorter[number]

    def _pack(self, piece: str) -> bytes:
        if len(self.packed) >= REMEMBERED:
            self.packed.clear()
        ids = np.array(self.encode_piece(piece.encode("utf-8").decode("latin-1")), "<u4").tobytes()
        if len(piece) <= 64:
            self.packed[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        known = self.packed.get
        return b"".join([known(piece) or self._pack(piece) for piece in self.cut(text)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids."""
        numbers = np.frombuffer(ids, "<u4")
        if not len(numbers):
            return b""
        width = self.width[numbers]
        ends = np.cumsum(width)
        places = np.arange(ends[-1]) + np.repeat(self.start[numbers] - (ends - width), width)
        return self.bytes[places].tobytes()


@lru_cache(maxsize=2)
def tokenizer(ranks: bytes, pattern: str) -> ByteBPE:
    """One tokenizer per worker process, kept between tasks."""
    return ByteBPE(ranks, pattern)


def read_ranks(path: str) -> bytes:
    """The rank file; its size is that of a fixed vocabulary, so it can travel with every task."""
    with open(path, "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row, and the ids themselves as ``ids`` when asked for.

    Whole texts, no special tokens.  A null text counts as empty (no tokens); rows that repeat are encoded alike; the id
    may be null; other columns are not read; an empty table gives an empty table.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(ranks.value, pattern)
        counts, hashes, decoded, lists = [], [], [], []
        for text in batch.column("text").to_pylist():
            packed = bpe.encode(text or "")
            counts.append(len(packed) // 4)
            hashes.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            if ids:
                lists.append(np.frombuffer(packed, "<u4").astype(np.int32))
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes), "decoded_sha256": pa.array(decoded)}
        if ids:
            columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that are no valid UTF-8 become replacement characters."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(ranks.value, pattern)
        texts = [bpe.decode(array("I", numbers or []).tobytes()).decode("utf-8", "replace") for numbers in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
