"""Token ids in binary files, by canonical length-limited Huffman coding.

The files of a folder are three tables that Spark writes, so a lost executor costs a
task and a folder without all three isn't readable:

* ``code``: (id, length), the length in bits of each id's codeword, of ids that occur.
  Codewords are canonical: they count up in the order of (length, id), so the lengths
  are all that a reader needs. Lengths come from the counts of all ids, by the
  package-merge algorithm, and have a largest value.
* ``blocks``: documents in ascending order, a row for each block of up to ``BLOCK`` ids
  of one document: (part, doc, first, block, n, marks, bits). ``part`` numbers the
  ranges of documents, ``first`` the document's first id within its part. ``bits`` are
  the codewords, highest bit first; a block starts at a byte of its own and needs no
  other. ``marks`` are checkpoints: the bit offset of every ``EVERY``-th id but the
  first, as little-endian 32-bit numbers.
* ``parts``: (part, base, n): the ids of all parts before, and of the part.

Decoding looks codewords up in one table of all bit patterns of the largest length.
All stretches between checkpoints go forward in step, a codeword at a time, as arrays.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallframe.session import scratch, stored

#: Ids of a block, ids from one checkpoint to the next, bits of the longest codeword (more where a vocabulary needs them).
BLOCK, EVERY, LIMIT = 1 << 15, 256, 16
#: Bytes of texts encoded at once, and ids coded at once.
TEXTS, MANY = 8 << 20, 1 << 19
#: Bytes of known pieces that a worker keeps, and characters of the longest one.
MEMO, LONG = 64 << 20, 256
#: Before a blank and something that isn't white space, every text may be cut: no token reaches across.
CUT = re.compile(r"(?= \S)")
#: Blanks that no word follows, with all white space of Python, for Arrow.
ODD = r" (?:[\s\x0b\x1c-\x1f\x85\p{Z}]|\z)"
#: Letters of which every run is one pre-token; such a run up to the end or an ASCII character that ends it, one that may
#: begin a line, and one with all that follows it.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
STOP = r"[\x00-@\[-`{-\x7f]"
WORD = re.compile(rf"[{LETTERS}]+(?={STOP}|\Z)")
LINE = re.compile(rf"((?:[!-/:-@\[-`{{-~]*\n)?)({WORD.pattern})")
HEAD = rf"(?s)\A(?P<word>[{LETTERS}]+)(?P<tail>(?:{STOP}.*)?)\z"


class Pieces(dict):
    """What ``make`` makes of pieces of text, made once while it is remembered.

    Two generations hold ``MEMO`` bytes at most: where the younger one has half of
    that, it becomes the older one, of which only what is asked for again stays.
    """

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older, self.held = make, {}, 0

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= LONG:
            self[piece] = found
            self.held += len(piece) + len(found) + 220
        return found

    def settle(self) -> None:
        """Call it between uses."""
        if self.held > MEMO // 2:
            self.older, self.held = dict(self), 0
            self.clear()


def _strings(texts: pa.Array) -> list[str]:
    """``to_pylist``, several times as fast."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """The tokenizers library over texts; the strings of special tokens are ordinary text.

    Texts are cut at blanks, and each different piece of many texts is looked up once,
    wherever it was seen before. A word of plain letters behind a blank is one pre-token
    and goes to the library's model at once; so do the words before an ASCII mark, digit
    or line end and at the start of a line. All else goes through the library as a whole.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.code = Tokenizer.from_file(path), np.dtype(dtype).char
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {ord(c): spell(c)[0][0] for c in " " + LETTERS}
        #: Pieces behind a blank that isn't part of the key, and pieces as they are.
        self.after, self.plain = Pieces(self._after_blank), Pieces(self._as_is)

    def _whole(self, piece: str) -> bytes:
        return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _after_blank(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self._word(self.spelling[32] + piece)
        m = WORD.match(piece)
        if m is None:
            return self._whole(" " + piece)
        if m.end() < len(piece):
            return self.after[m[0]] + self.plain[piece[m.end() :]]
        return self._word(self.spelling[32] + piece.translate(self.spelling))

    def _as_is(self, piece: str) -> bytes:
        m = LINE.match(piece)
        if m is None:
            return self._whole(piece)
        if m.end() == len(piece):
            return self.plain[m[1]] + self.plain[m[2]] if m[1] else self._word(piece.translate(self.spelling))
        out, at = [], 0
        while m:
            out.append(self.plain[m[0]])
            at = m.end()
            m = LINE.match(piece, at)
        return b"".join(out) + self.plain[piece[at:]]

    def _word(self, spelled: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _each(self, pieces: pa.Array, known: Pieces) -> pa.Array:
        """What ``known`` has for each of ``pieces``, asked for once for equal ones."""
        own = pieces.dictionary_encode()
        return pa.array([*map(known.__getitem__, _strings(own.dictionary))], pa.large_binary()).take(own.indices)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text, as numbers of ``dtype`` one after another."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        cuts = pc.split_pattern(texts, " ")
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False))
        if len(odd):
            own = [[p if i == 0 else p[1:] for i, p in enumerate(CUT.split(t))] for t in _strings(texts.take(odd))]
            place = np.arange(len(texts))
            place[odd] = len(texts) + np.arange(len(odd))
            cuts = pa.concat_arrays([cuts, pa.array(own, cuts.type)]).take(place)
        pieces, counts = cuts.flatten(), cuts.value_lengths().to_numpy().astype(np.int64)
        ends = np.cumsum(counts)
        firsts, behind = ends - counts, np.ones(len(pieces), bool)
        behind[firsts] = False  # a text's first piece has no blank before it
        rest = pieces.filter(pa.array(behind)).dictionary_encode()
        # a word and what is behind it are looked up by themselves
        words, tails = pc.extract_regex(rest.dictionary, HEAD).flatten()
        words, tails = self._each(pc.coalesce(words, rest.dictionary), self.after), self._each(tails.fill_null(""), self.plain)
        found = pc.binary_join_element_wise(words, tails, pa.scalar(b"", pa.large_binary()))
        which = np.empty(len(pieces), np.int64)
        which[behind] = rest.indices.to_numpy()
        which[firsts] = len(found) + np.arange(len(firsts))
        known = pa.concat_arrays([found, self._each(pieces.take(firsts), self.plain)])
        coded = known.take(which)
        _, offsets, flat = coded.buffers()
        at = np.frombuffer(offsets, np.int64, len(coded) + 1)[np.concatenate(([0], ends))].tolist()
        self.after.settle()
        self.plain.settle()
        return [flat[a:b].to_pybytes() for a, b in zip(at, at[1:], strict=False)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str) -> Encoder:
    """The worker's own encoder."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = Encoder(path, dtype)
    return _encoders[path, dtype]


def forget() -> None:
    """Frees the worker's encoders and the pieces they know; for the steps after encoding, which the same workers run."""
    if _encoders:
        _encoders.clear()
        gc.collect()  # an encoder and its pieces refer to each other


def encoded(docs: DataFrame, doc: str, text: str, tokenizer: str, end: int, dtype: str) -> DataFrame:
    """(doc, tie, row, block, ids, counts): the ids of each document's whole text and ``end`` behind them, in blocks of ``BLOCK`` at most.

    Each task's last row has ``counts`` only: how often each id from 0 on occurs in the task, as little-endian 64-bit numbers.
    """
    keys = [T.StructField("doc", docs.schema[doc].dataType), T.StructField("tie", T.LongType()), T.StructField("row", T.LongType())]
    schema = T.StructType([*keys, T.StructField("block", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, width = encoder(tokenizer, dtype), np.dtype(dtype).itemsize
        last, names, none = np.array([end], dtype).tobytes(), [f.name for f in schema], None
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in _slices(batch, pc.binary_length(batch.column("text")).fill_null(0).to_numpy(), TEXTS):
                coded = [x + last for x in own.encode(part.column("text").fill_null(""))]
                places = [(i, b) for i, x in enumerate(coded) for b in range(-(-len(x) // (BLOCK * width)))]
                rows = pa.array([i for i, _ in places], pa.int64())
                blocks = [coded[i][b * BLOCK * width : (b + 1) * BLOCK * width] for i, b in places]
                total = _summed(total, np.bincount(np.frombuffer(b"".join(coded), dtype)))
                keys = [part.column(c).take(rows) for c in names[:3]]
                none = [pa.nulls(1, c.type) for c in keys]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([b for _, b in places], pa.int32()), pa.array(blocks, pa.binary()), pa.nulls(len(rows), pa.binary())], names)
        if none:
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    told = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return told.mapInArrow(work, schema)


def _summed(total: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The sum of two counts by id; the shorter one has 0 for the rest."""
    short, out = sorted((total, own), key=len)
    out = out.astype(np.int64)
    out[: len(short)] += short
    return out


def count_ids(counts: DataFrame) -> DataFrame:
    """(id, n) over the ``counts`` of all tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(0, np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                total = _summed(total, np.frombuffer(own, "<i8"))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    return counts.select("counts").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """The lengths of the best prefix code for positive ``counts`` whose codewords have ``limit`` bits at most, by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} codewords don't fit {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = len(level) // 2 * 2
        both = np.concatenate((leaves, level[0:pairs:2] + level[1:pairs:2]))
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < n)
    lengths, wanted = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:wanted].sum())
        lengths[:chosen] += 1
        wanted = 2 * (wanted - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code from the lengths of its ids' codewords."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.limit = int(self.lengths.max(initial=1))
        # each codeword's share of all bit patterns of the largest length, one after another
        share = np.int64(1) << (self.limit - self.lengths)
        self.words = (np.cumsum(share) - share) >> (self.limit - self.lengths)
        size = int(self.ids.max(initial=0)) + 1
        self.word_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.word_of[self.ids], self.length_of[self.ids] = self.words.astype(np.uint64), self.lengths
        self.table_id, self.table_length = np.repeat(self.ids.astype(np.uint32), share), np.repeat(self.lengths, share)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """(bits, marks) of blocks of ``sizes`` ids that lie one after another in ``ids``."""
        length, word = self.length_of[ids], self.word_of[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        run = np.concatenate(([0], np.cumsum(length)))
        n_bytes = (run[ends] - run[starts] + 7) // 8
        at_byte = np.cumsum(n_bytes) - n_bytes
        inside = run[:-1] - np.repeat(run[starts], sizes)
        place = inside + np.repeat(8 * at_byte, sizes)
        cell, shift = place >> 6, 64 - (place & 63) - length
        out = np.zeros(int(n_bytes.sum()) // 8 + 2, np.uint64)
        if len(ids):
            high = word << (shift & 63).astype(np.uint64)
            over = np.flatnonzero(shift < 0)  # one codeword at most reaches from a cell into the next
            high[over] = word[over] >> (-shift[over]).astype(np.uint64)
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            out[cell[first]] = np.bitwise_or.reduceat(high, first)
            out[cell[over] + 1] |= word[over] << (64 + shift[over]).astype(np.uint64)
        flat = out.astype(">u8").tobytes()
        bits = [flat[a : a + n] for a, n in zip(at_byte.tolist(), n_bytes.tolist(), strict=True)]
        marks = [inside[a + EVERY : b : EVERY].astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return bits, marks

    def decode(self, bits: list[bytes], marks: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """The ids of blocks, one after another."""
        flat = np.frombuffer(b"".join(bits) + bytes(8), np.uint8).astype(np.uint32)
        # the 32 bits from each byte on
        window = flat[:-3] << np.uint32(24) | flat[1:-2] << np.uint32(16) | flat[2:-1] << np.uint32(8) | flat[3:]
        n_runs = -(-sizes // EVERY)
        block = np.repeat(np.arange(len(sizes)), n_runs)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
        place = np.zeros(len(block), np.int64)
        place[nth > 0] = np.frombuffer(b"".join(marks), "<u4")
        lengths = np.fromiter(map(len, bits), np.int64, len(bits))
        place += 8 * (np.cumsum(lengths) - lengths)[block]
        # each stretch's ids, and where they go
        left = np.minimum(sizes[block] - nth * EVERY, EVERY)
        goes = np.cumsum(left) - left
        order = np.argsort(-left, kind="stable")  # stretches that end first come last
        place, goes, left = place[order], goes[order], left[order]
        out = np.zeros(int(sizes.sum()), np.uint32)
        live = np.searchsorted(-left, -np.arange(EVERY), side="left")
        mask, top = np.uint32((1 << self.limit) - 1), np.uint32(32 - self.limit)
        for step in range(EVERY):
            n = live[step]
            if not n:
                break
            p = place[:n]
            pattern = window[p >> 3] >> (top - (p & 7).astype(np.uint32)) & mask
            out[goes[:n] + step] = self.table_id[pattern]
            p += self.table_length[pattern]
        return out


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int = MANY) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` ids or bytes; ``sizes`` are those of its rows."""
    nth = np.cumsum(sizes, dtype=np.int64) // most
    starts = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _coded(code: Code, dtype: str):
    """Task: blocks of ids to (..., n, marks, bits)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for part in _slices(batch, pc.binary_length(batch.column("ids")).to_numpy() // width):
                raw = part.column("ids").to_pylist()
                sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // width
                bits, marks = code.encode(np.frombuffer(b"".join(raw), dtype).astype(np.int64), sizes)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("doc", "tie", "row", "block")], pa.array(sizes, pa.int32()), pa.array(marks, pa.binary()), pa.array(bits, pa.binary())],
                    ["doc", "tie", "row", "block", "n", "marks", "bits"],
                )

    return work


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of a range with its number and each document's first id within it."""
    part, at, first = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        firsts = []
        for block, n in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if block == 0:
                first = at
            firsts.append(first)
            at += n
        own = [pa.array(np.full(batch.num_rows, part), pa.int32()), batch.column("doc"), pa.array(firsts, pa.int64())]
        yield pa.RecordBatch.from_arrays([*own, *[batch.column(c) for c in ("block", "n", "marks", "bits")]], ["part", "doc", "first", "block", "n", "marks", "bits"])


def write(docs: DataFrame, folder: str, tokenizer: str, doc: str = "doc_id", text: str = "text", end: int = 0) -> None:
    """Encodes all documents and writes the files of ``folder``.

    Documents go by ascending ``doc``, nulls first, equal ones by a hash of the text;
    repeated rows are documents of their own. A null text is empty and has the end
    id only. Extra columns are ignored. Without documents the tables are empty.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end + 1)
    dtype = "u2" if vocabulary <= 1 << 16 else "u4"
    limit = max(LIMIT, (vocabulary - 1).bit_length())
    with scratch(spark):
        with scratch(spark):
            blocks = stored(encoded(docs, doc, text, tokenizer, end, dtype), codec="zstd")
            # at most one row for each entry of the vocabulary
            counts = np.array([tuple(r) for r in count_ids(blocks.where("counts is not null")).orderBy("id").collect()], np.int64).reshape(-1, 2)
            lengths = code_lengths(counts[:, 1], limit)
            fields = [f for f in blocks.schema.fields if f.name not in ("ids", "counts")]
            schema = T.StructType([*fields, T.StructField("n", T.IntegerType()), T.StructField("marks", T.BinaryType()), T.StructField("bits", T.BinaryType())])
            coded = stored(blocks.where("ids is not null").drop("counts").mapInArrow(_coded(Code(counts[:, 0], lengths), dtype), schema), keep=True, codec="none")
        keys = ["doc", "tie", "row"]
        out = T.StructType([T.StructField("part", T.IntegerType()), fields[0], T.StructField("first", T.LongType()), T.StructField("block", T.IntegerType()), *schema.fields[-3:]])
        coded.repartitionByRange(*keys).sortWithinPartitions(*keys, "block").mapInArrow(_placed, out).write.option("compression", "none").parquet(f"{folder}/blocks")
    pairs = [(int(i), int(n)) for i, n in zip(counts[:, 0], lengths, strict=True)]
    spark.createDataFrame(pairs, "id long, length int").coalesce(1).write.parquet(f"{folder}/code")
    sums = spark.read.schema(out).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each range
    sums.select("part", F.coalesce(before, F.lit(0)).alias("base"), "n").coalesce(1).write.parquet(f"{folder}/parts")


def read_code(spark: SparkSession, folder: str) -> Code:
    rows = np.array([tuple(r) for r in spark.read.parquet(f"{folder}/code").collect()], np.int64).reshape(-1, 2)
    return Code(rows[:, 0], rows[:, 1])


def _decoded(code: Code, fields: list[T.StructField], name: str, of: Callable[[np.ndarray], pa.Array]):
    """Task: blocks to ``fields`` and ``name``, which ``of`` makes of all ids and the blocks' sizes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in _slices(batch, batch.column("n").to_numpy().astype(np.int64)):
                sizes = part.column("n").to_numpy().astype(np.int64)
                ids = code.decode(part.column("bits").to_pylist(), part.column("marks").to_pylist(), sizes)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], of(ids, sizes)], [*[f.name for f in fields], name])

    return work


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids.astype(np.int32)))


def _little_endian(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    flat, ends = ids.astype("<u4", copy=False).tobytes(), 4 * np.cumsum(sizes)
    return pa.array([flat[a:b] for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist(), strict=True)], pa.binary())


def _crc32s(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    flat, ends = memoryview(ids.astype("<u4", copy=False).tobytes()), 4 * np.cumsum(sizes)
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist(), strict=True)], pa.int64())


def _blocks(spark: SparkSession, folder: str, name: str, kind: T.DataType, of, where: str = "true") -> DataFrame:
    """(part, doc, first, block, n, ``name``) of the blocks ``where`` something holds."""
    blocks = spark.read.parquet(f"{folder}/blocks").where(where)
    fields = [f for f in blocks.schema.fields if f.name not in ("marks", "bits")]
    return blocks.mapInArrow(_decoded(read_code(spark, folder), fields, name, of), T.StructType([*fields, T.StructField(name, kind)]))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, start long, block int, ids array<int>) of every block; ``start`` is the number of ids of all documents before the block's."""
    blocks = _blocks(spark, folder, "ids", T.ArrayType(T.IntegerType()), _lists)
    return blocks.join(spark.read.parquet(f"{folder}/parts").select("part", "base"), "part").select("doc", (F.col("base") + F.col("first")).alias("start"), "block", "ids")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, start long, n_tokens long, ids_crc32 long) of every document, from the files."""
    key, alone = ["part", "doc", "first"], f"block = 0 and n < {BLOCK}"

    # a document of one block is digested where it is decoded, so its ids don't leave the task
    one = _blocks(spark, folder, "ids_crc32", T.LongType(), _crc32s, alone).select(*key, F.col("n").cast("long").alias("n_tokens"), "ids_crc32")
    # of longer documents, each one's blocks meet
    long = _blocks(spark, folder, "ids", T.BinaryType(), _little_endian, f"not ({alone})")
    many = long.groupBy(*key).agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("block", "ids"))).alias("b"))
    whole = F.aggregate("b.ids", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x))
    rows = one.unionByName(many.select(*key, "n_tokens", F.crc32(whole).alias("ids_crc32")))
    parts = spark.read.parquet(f"{folder}/parts").select("part", "base")
    return rows.join(parts, "part").select("doc", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
