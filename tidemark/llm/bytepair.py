"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved down to blocks; a block is split by the pre-token pattern and each match (a piece) is encoded. Two levels
of one tree join neighbours, and both re-encode a window around the seam that grows until what lies outside is provably
what a single pass over the whole would give:

* **Pieces** (``Splitter.join``). The pattern never looks back, so the matches from a place on depend on the text from that
  place on alone. A match is settled if the pattern could not have seen the end of its block: it needs at most two
  characters after its first one (contractions) and one after its last (the white-space lookahead). The window holds the
  left side's unsettled matches and the first k matches of the right side; as soon as a settled match of the window ends
  where a match of the right side starts, all later matches agree. Else k doubles.
* **Tokens** of one piece (``Codec.join``). Merges never cross the seams of a token sequence if and only if each two
  neighbours encode to just themselves: up to the first merge across a seam, the merges inside two neighbours are made in
  the same order in the whole and in the pair alone, so the pair alone would make that merge too. The window holds i
  tokens left and j right of the seam, and is whole once both its outer neighbours are compatible with its ends; else i
  or j doubles.

Decoding a concatenation is the concatenation of the decodings, so ``decode`` looks up all tokens of a batch at once.

Ranks decide merges: least rank first, leftmost of equals; a piece that is itself in the vocabulary is one token, as in the
public library for such rank files. No special tokens: their strings are ordinary text.

Bounds: the rank table (some 50,000 entries, half a megabyte of file) is broadcast; a worker keeps the tokens of at most
``PIECES`` distinct pieces, lately met ones longer, which costs time alone. A text is one row of one task.

Defined results: NULL and empty texts have no tokens and decode to no bytes; repeated rows are each returned; a NULL doc_id
is returned as NULL; other columns are ignored; empty tables give empty results. Decoding an id outside the vocabulary
is an error; a NULL list of ids decodes to no bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

BLOCK = 16_384  # characters of a leaf of the text's tree
LEAF = 16  # bytes of a leaf of a piece's tree
PIECES = 400_000
BATCH = 1 << 18  # tokens decoded at once


class Splitter:
    """Pieces of a text by a pattern that tries its alternatives at each place in turn and never looks back."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall

    def split(self, text: str) -> list[str]:
        n = len(text)
        if n <= BLOCK:
            return self.find(text)
        half = BLOCK
        while half * 2 < n:
            half *= 2
        return self.join(self.split(text[:half]), self.split(text[half:]))

    def join(self, left: list[str], right: list[str]) -> list[str]:
        open_, k = self._unsettled(left), 1
        while True:
            k = min(k, len(right))
            tail = left[len(left) - open_ :]
            again = self.find("".join(tail) + "".join(right[:k]))
            if k == len(right):
                return left[: len(left) - open_] + again
            seam, ends = sum(map(len, tail)), {}
            at = seam
            for i, piece in enumerate(right[:k]):
                at += len(piece)
                ends[at] = i + 1
            settled, at = len(again) - self._unsettled(again), 0
            for i, piece in enumerate(again[:settled]):
                at += len(piece)
                if at in ends:
                    return left[: len(left) - open_] + again[: i + 1] + right[ends[at] :]
            k *= 2

    @staticmethod
    def _unsettled(pieces: list[str]) -> int:
        """How many last pieces the pattern may split otherwise once more text follows."""
        behind, n = 0, 0
        for piece in reversed(pieces):
            if behind >= 1 and behind + len(piece) >= 3:
                break
            behind += len(piece)
            n += 1
        return n


class Pieces(dict):
    """Tokens of the pieces met, in two generations of half of ``PIECES``: when the younger one is full it becomes the elder,
    whose pieces come back as they are met again."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        super().__init__()
        self.encode, self.elder = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.elder.get(piece)
        if ids is None:
            ids = np.array(self.encode(piece.encode()), np.int32).tobytes()
        if len(self) >= PIECES // 2:
            self.elder = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.splitter = ranks, Splitter(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.known = Pieces(self.piece)
        self.fits: dict[tuple[int, int], bool] = {}

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.splitter.split(text))), np.int32)

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return self.tree(data) if whole is None else [whole]

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = LEAF
        while half * 2 < len(data):
            half *= 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            mid = self.merge(b"".join([self.tokens[t] for t in left[len(left) - i :] + right[:j]]))
            before = i == len(left) or self.fit(left[-i - 1], mid[0])
            after = j == len(right) or self.fit(mid[-1], right[j])
            if before and after:
                return left[: len(left) - i] + mid + right[j:]
            i, j = i if before else 2 * i, j if after else 2 * j

    def fit(self, a: int, b: int) -> bool:
        """Whether the two tokens next to each other encode to themselves."""
        out = self.fits.get((a, b))
        if out is None:
            if len(self.fits) >= PIECES:
                self.fits.clear()
            out = self.fits[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return out

    def merge(self, data: bytes) -> list[int]:
        """The merges of a short run of bytes, least rank first, leftmost of equals."""
        ranks = self.ranks
        if len(data) > 4 * LEAF:
            return self._merge_many(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2]) for i in range(len(data) - 1)]
        while True:
            low, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _merge_many(self, data: bytes) -> list[int]:
        """As ``merge``, by a heap over the pairs of a linked list; entries of pairs that are gone are skipped."""
        ranks, n = self.ranks, len(data)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                rank = ranks.get(data[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if end[i] != j or end[j] != stop:
                continue
            end[i], end[j] = stop, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = after[i]
        return out

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all tokens, stop of each token in them)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("token id outside the vocabulary")
        out, stops, done = [], np.zeros(len(ids), np.int64), 0
        for at in range(0, len(ids), BATCH):
            part = ids[at : at + BATCH]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            out.append(self.blob[np.repeat(self.starts[part] - ends + lengths, lengths) + np.arange(int(lengths.sum()))].tobytes())
            stops[at : at + BATCH] = ends + done
            done += len(out[-1])
        return b"".join(out), stops


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Rank files hold a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


@lru_cache(maxsize=2)
def codec(content: bytes, pattern: str) -> Codec:
    """One codec per worker process; later tasks find its pieces encoded."""
    return Codec(parse_ranks(content), pattern)


def encoded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of ``docs`` by the rank file at path ``ranks``, which the driver reads."""
    shared = docs.sparkSession.sparkContext.broadcast(open(ranks, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for at in slices(batch.column("text")):
                part = batch.slice(*at)
                ids = [own.encode(text) for text in part.column("text").to_pylist()]
                stops = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(stops), pa.array(flat))], names=["doc_id", "ids"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def slices(texts: pa.Array, most: int = 1 << 22) -> Iterable[tuple[int, int]]:
    """(offset, length) of consecutive rows of at most ``most`` characters, one row at least."""
    first, held = 0, 0
    for i, n in enumerate(pc.utf8_length(texts).to_pylist()):
        if i > first and held + (n or 0) > most:
            yield first, i - first
            first, held = i, 0
        held += n or 0
    if len(texts) > first:
        yield first, len(texts) - first


def decoded(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids, data) of ``tokens`` (doc_id, ids): data holds the decoded bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(open(ranks, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            data, stops = own.decode(np.asarray(lists.flatten()))
            cuts = np.concatenate([[0], np.concatenate([[0], stops])[np.cumsum(sizes)]])
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, column.cast(pa.binary())], names=["doc_id", "ids", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")
