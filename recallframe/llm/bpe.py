"""Byte-level BPE encoding and decoding as a tree reduction.

A text is cut into matches of the pre-tokenisation pattern and every match is
encoded for itself. Both levels are trees over halves:

* *Text level.* A text is halved again and again, always between a character that is
  no white space and one that is. A match of the pattern holds white space only
  at its start, and its one look-ahead reads the character behind white space,
  so no match crosses such a place and the halves' matches simply concatenate.
* *Match level.* The bytes of a long match are halved recursively. Two encoded
  neighbours are joined by encoding a window of tokens around the seam anew and
  growing it until both of the window's seams are stable: the token outside and
  the window's outermost token encode to just these two. A sequence of tokens is
  the BPE encoding of its bytes exactly if each pair of neighbours is stable (the
  first merge to cross a boundary would cross it in the pair alone, too), so the
  tokens outside need not be looked at again.

Decoding concatenates the bytes of tokens, again by halves.

Nothing is shuffled: a document is encoded in the task that reads it.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallframe.llm.text import Memo
from recallframe.session import without

#: Characters of a leaf of the text tree and bytes of a leaf of the match tree.
TEXT_LEAF, MATCH_LEAF = 1 << 14, 64
#: Entries that a Python worker keeps of matches and of pairs; with the longest key kept, that bounds its memory.
MATCHES_KEPT, PAIRS_KEPT = 150_000, 50_000


class Codec:
    """Encodes and decodes by a rank table; one per Python worker and table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.match = Memo(self._match, MATCHES_KEPT)
        self.stable = Memo(self._stable, PAIRS_KEPT)
        self.gap = regex.compile(r"(?<=\S)(?=\s)")
        self.last_gap = regex.compile(r"(?r)(?<=\S)(?=\s)")

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short span: again and again the leftmost pair of lowest rank."""
        if len(data) > 4 * MATCH_LEAF:
            return self._merge_heap(data)
        ranks, get = self.ranks, self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        none = 1 << 60
        costs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while costs and (low := min(costs)) < none:
            i = costs.index(low)
            parts[i] += parts.pop(i + 1)
            costs.pop(i)
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_heap(self, data: bytes) -> list[int]:
        """The same merges for long spans, with a heap of (rank, place)."""
        get, n = self.ranks.get, len(data)
        end = list(range(1, n + 1))  # end of the part that begins here; 0: no part begins here
        before = list(range(-1, n - 1))  # beginning of the part before
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if end[i] != middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if i and (r := get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], i, stop))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return ids

    def _stable(self, pair: tuple[int, int]) -> bool:
        a, b = pair
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both sides together."""
        if not left or not right:
            return left + right
        size = 1
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.stable[left[i - 1], window[0]]) and (j == len(right) or self.stable[window[-1], right[j]]):
                return left[:i] + window + right[j:]
            size *= 2

    def span(self, data: bytes) -> list[int]:
        """The match tree: leaves are merged plainly, inner nodes are joins."""
        if len(data) <= MATCH_LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.span(data[:half]), self.span(data[half:]))

    def _match(self, match: str) -> bytes:
        data = match.encode()
        whole = self.ranks.get(data)
        ids = self.span(data) if whole is None else [whole]
        return struct.pack(f"<{len(ids)}i", *ids)

    def leaves(self, text: str) -> Iterator[str]:
        """The leaves of the text tree from left to right."""
        waiting = [text]
        while waiting:
            text = waiting.pop()
            place = None
            if len(text) > TEXT_LEAF:
                half = len(text) // 2
                place = self.gap.search(text, half) or self.last_gap.search(text, 0, half + 1)
            if not place or place.start() in (0, len(text)):
                yield text  # short, or nowhere to cut: one leaf, still linear
            else:
                waiting += [text[place.start() :], text[: place.start()]]

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian int32."""
        known = self.match.__getitem__
        return b"".join([b"".join(map(known, self.find(leaf))) for leaf in self.leaves(text)])

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """This worker's codec for a rank file; read once per process."""
    if (ranks_path, pattern) not in _codecs:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _codecs[ranks_path, pattern] = Codec(ranks, pattern)
    return _codecs[ranks_path, pattern]


def _texts(column) -> list[str]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [(b or b"").decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _packed_lists(packed: list[bytes]) -> pa.ListArray:
    offsets, at = [0], 0
    for p in packed:
        at += len(p) // 4
        offsets.append(at)
    flat = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The lists of a list column, null as empty, without a Python object per Arrow value."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    for n in lengths.tolist():
        yield flat[at : at + n].tolist()
        at += n


#: Rows of an Arrow batch that are worked on at once.
SLICE = 512


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def encode(df: DataFrame, text: str, ranks_path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with an ``array<int>`` column of the token ids of its ``text`` column.

    Null and empty texts have no ids. An input column named like ``ids`` is
    replaced; all others stay. Repeated rows stay repeated.
    """
    kept = without(df, ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    names = schema.names

    def work(batches):
        own = codec(ranks_path, pattern)
        for part in _slices(batches):
            coded = _packed_lists([own.encode(t) for t in _texts(part.column(text))])
            yield pa.RecordBatch.from_arrays([*part.columns, coded], names)

    return kept.mapInArrow(work, schema)


def decode(df: DataFrame, ids: str, ranks_path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """``df`` with a binary column of the bytes that ``ids`` stand for.

    A null list decodes to no bytes; an id outside the table raises KeyError.
    An input column named like ``out`` is replaced.
    """
    kept = without(df, out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())])
    names = schema.names

    def work(batches):
        own = codec(ranks_path, pattern)
        for part in _slices(batches):
            decoded = pa.array([own.decode(x) for x in _lists(part.column(ids))], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, decoded], names)

    return kept.mapInArrow(work, schema)


def count_tokens(df: DataFrame, text: str, ranks_path: str, pattern: str, out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of its texts instead of the texts."""
    kept = without(df, out)
    fields = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(out, T.LongType())])
    names = schema.names

    def work(batches):
        own = codec(ranks_path, pattern)
        for part in _slices(batches):
            counts = pa.array([len(own.encode(t)) // 4 for t in _texts(part.column(text))], pa.int64())
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], counts], names)

    return kept.mapInArrow(work, schema)


def digests(encoded: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """doc_id, token count and digests of ids and decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
