"""Phrase collocations from FM-indexes of shards of words.

Documents of a language are cut into shards of a bounded number of words where they
are read. A shard is a sequence of word numbers with breaks between pieces, and its
n-grams are found by extending intervals in the Burrows-Wheeler transforms of the
sequence and of its reverse: a step to the left reads the words before an interval's
suffixes in one transform and gives the places of the longer phrase in both, a step to
the right does the same the other way round. Suffixes are sorted by as many words as
the longest phrase has, which is all that such intervals need.

Counts are summed across shards. A phrase that is frequent has only frequent parts, so
shards are walked for pairs of frequent words first, and then for longer phrases all of
whose neighbouring pairs are frequent; what isn't frequent turns into breaks before an
index is built. A shard only ever gets the frequent words and pairs that it has itself,
as lists of numbers. Frequent words have numbers of their own, so a phrase is a few numbers until
the best ones are spelled.

Before a walk all n-grams are counted by a hash in a fixed number of buckets. One whose
bucket stays below the least frequency can't be frequent and isn't handed on. The bit
for each bucket is all that is broadcast, and its size is fixed; the more n-grams there
are, the less it spares, but no count depends on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallframe.llm.shard import dense
from recallframe.session import scratch, stored

#: Least frequency, most words, phrases reported per language.
LEAST, MOST_WORDS, REPORTED = 100, 5, 2000
#: Bytes of text of a shard, and of all shards that a task holds open.
SHARD, HELD = 6 << 20, 24 << 20
#: Binary logarithms of the number of buckets and of those in a chunk.
BUCKETS, CHUNK = 22, 16
#: Rows of an Arrow batch of counts.
ROWS = 1 << 17
#: Parts that pairs are dealt into at least.
PARTS = 64
#: Rows of counts that a task adds up before it hands them on.
MERGED = 1 << 20
#: A-Z become a-z, tabs blanks, and what ends a piece a byte that UTF-8 doesn't have.
_ENDS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\xff" * len(_ENDS))
BREAK = b"\xff"


class Transform:
    """Burrows-Wheeler transform of a cyclic sequence of numbers, 0 being a break, its suffixes sorted by ``depth`` numbers at least."""

    def __init__(self, sequence: np.ndarray, depth: int):
        n = len(sequence)
        rank, width, order = sequence.astype(np.int64), 1, np.argsort(sequence, kind="stable")
        while width < depth:
            key = rank * (int(rank.max()) + 1) + np.concatenate((rank[width:], rank[:width]))
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
            width *= 2
        self.n, self.bwt = n, sequence[order - 1].astype(np.int64)
        self.n_symbols = int(sequence.max()) + 1
        #: Places of the symbols, symbol by symbol: what ranks are looked up in.
        self.places = np.sort(self.bwt * n + np.arange(n))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.bwt, minlength=self.n_symbols))))

    def step(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions of the intervals by a symbol before their suffixes but breaks.

        Returns (interval, symbol, count, low, before) of each: ``low`` is where the
        extension's own interval begins, ``before`` how many of the interval's
        suffixes have a smaller symbol before them.
        """
        size = high - low
        starts = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(low)), size)
        symbols = self.bwt[np.arange(len(owner)) + np.repeat(low - starts, size)]
        key, count = np.unique(owner * self.n_symbols + symbols, return_counts=True)
        owner, symbol = key // self.n_symbols, key % self.n_symbols
        before = np.cumsum(count) - count - starts[owner]
        word = symbol > 0
        owner, symbol, count, before = owner[word], symbol[word], count[word], before[word]
        return owner, symbol, count, np.searchsorted(self.places, symbol * self.n + low[owner]), before


def walk(sequence: np.ndarray, depth: int, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, counts) of all different n-grams of a sequence that begins and ends with a break, for n from 2 to ``depth``; to the left and to the right by turns.

    ``words`` has a row of n numbers for each n-gram; none holds a break. N-grams for
    which ``keep`` is false are left out, with all longer ones that would come of them.
    """
    if len(sequence) < 3:
        return
    forward = Transform(sequence, depth)
    backward = None
    low = other = forward.first[1:-1]
    count = forward.first[2:] - low
    words = np.arange(1, forward.n_symbols)[:, None]
    for size in range(2, depth + 1):
        leftwards = size % 2 == 0
        if not leftwards and backward is None:
            backward = Transform(sequence[::-1], depth)
        owner, symbol, new, at, before = (forward if leftwards else backward).step(*((low, low + count) if leftwards else (other, other + count)))
        low, other = (at, other[owner] + before) if leftwards else (low[owner] + before, at)
        count = new
        words = np.concatenate((symbol[:, None], words[owner]) if leftwards else (words[owner], symbol[:, None]), axis=1)
        if keep is not None:
            kept = keep(words)
            low, other, count, words = low[kept], other[kept], count[kept], words[kept]
        yield words, count
        if not len(count):
            return


def tokens_of(text: bytes | None) -> bytes:
    """A whole text folded, its words apart by blanks, with a break at each end of a piece."""
    return (text or b"").translate(FOLD).replace(BREAK, b" \xff ")


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), "<i4").astype(np.int64)


def _shard_row(shard: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
    coded = pa.array((b" \xff ".join([BREAK, *texts, BREAK])).split(), pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy()  # the break comes first, so its number is 0
    counts = np.bincount(ids)[1:]
    words = coded.dictionary[1:].cast(pa.string())
    one = pa.array([0, len(words)], pa.int32())
    lists = [pa.ListArray.from_arrays(one, x) for x in (words, pa.array(counts, pa.int64()))]
    row = [pa.array([shard], pa.int64()), pa.array([lang], pa.string()), pa.array([len(ids)], pa.int32()), pa.array([_packed(ids)], pa.binary())]
    return pa.RecordBatch.from_arrays([*row, *lists], ["shard", "lang", "n", "ids", "words", "counts"])


def shards(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(shard, lang, n, ids, words, counts): n packed word numbers with breaks, and the words of numbers 1, 2, ... with their counts.

    A shard holds ``SHARD`` bytes of text or a little more, or one longer text. A null language is ``und``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, 0
        texts: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = tokens_of(t)
                texts.setdefault(own, []).append(tokens)
                sizes[own] = sizes.get(own, 0) + len(tokens)
                held += len(tokens)
                if sizes[own] < SHARD:
                    if held < HELD:
                        continue
                    own = max(sizes, key=sizes.get)
                yield _shard_row(part << 32 | made, own, texts.pop(own))
                made += 1
                held -= sizes.pop(own)
        for own in list(texts):
            yield _shard_row(part << 32 | made, own, texts.pop(own))
            made += 1

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(work, "shard long, lang string, n int, ids binary, words array<string>, counts array<long>")


def _sequences(make: Callable[[np.ndarray, pa.Array], np.ndarray]):
    """Task: (shard, n, ids, kept) to the sequences that ``make`` makes of ids and kept, as (shard, n, ids)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sequence = make(_unpacked(batch.column("ids")[i].as_py(), batch.column("n")[i].as_py()), batch.column("kept")[i].values)
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), pa.array([len(sequence)], pa.int32()), pa.array([_packed(sequence)], pa.binary())], ["shard", "n", "ids"])

    return work


def _only_words(ids: np.ndarray, kept: pa.Array) -> np.ndarray:
    """The global numbers of kept words, id and gid in one number, and single breaks for what is between them."""
    new, both = np.zeros(int(ids.max()) + 1, np.int64), kept.to_numpy()
    new[both >> 32] = both & 0xFFFFFFFF
    sequence = new[ids]
    again = np.concatenate(([False], (sequence[1:] == 0) & (sequence[:-1] == 0)))
    return sequence[~again]


def _only_pairs(words: np.ndarray, kept: pa.Array) -> np.ndarray:
    """The runs of words whose neighbouring pairs are all kept, with single breaks around them."""
    pairs = np.sort(kept.to_numpy())
    here = words[:-1] << 32 | words[1:]
    return _runs(words, pairs[np.minimum(np.searchsorted(pairs, here), len(pairs) - 1)] == here)


def _runs(words: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The runs of words that are joined to the next one, with single breaks around them."""
    # a word stays if it is joined to a neighbour, with a break after it if that isn't the next one
    with_next, with_last = np.concatenate((joined, [False])), np.concatenate(([False], joined))
    both = np.stack((words, np.where(with_next, -1, 0)), axis=1)[with_next | with_last].ravel()
    return np.concatenate(([0], both[both >= 0]))


#: Odd multipliers of the hash of n-grams.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _bucket_of(words: np.ndarray) -> np.ndarray:
    """The buckets of n-grams, a row of numbers each."""
    h = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        h = h * _STEP + words[:, i].astype(np.uint64)
    return _bucket(h)


def _buckets_in(sequence: np.ndarray, least: int, most: int) -> np.ndarray:
    """The buckets of all n-grams at all places, n from ``least`` to ``most``."""
    values, out = sequence.astype(np.uint64), []
    h, whole = np.zeros(len(values), np.uint64), np.ones(len(values), bool)
    for n in range(1, min(most, len(values)) + 1):
        h, whole = h[: len(values) - n + 1] * _STEP + values[n - 1 :], whole[: len(values) - n + 1] & (values[n - 1 :] > 0)
        if n >= least:
            out.append(_bucket(h[whole]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def heavy_buckets(sequences: DataFrame, shortest: int, longest: int, least: int) -> np.ndarray:
    """Whether each bucket holds ``least`` n-grams or more over all ``sequences`` (n, ids)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                total += np.bincount(_buckets_in(_unpacked(data, n), shortest, longest), minlength=1 << BUCKETS)
        if total.any():
            total = np.minimum(total, least)  # more makes no difference
            for chunk in range(1 << (BUCKETS - CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([_packed(total[chunk << CHUNK : (chunk + 1) << CHUNK])], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + _unpacked(data, 1 << CHUNK)
        for chunk, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(own >= least).tobytes()], pa.binary())], ["chunk", "heavy"])

    n_chunks = 1 << (BUCKETS - CHUNK)
    parts = sequences.select("n", "ids").mapInArrow(count, "chunk int, counts binary").repartition(n_chunks, "chunk")
    out = np.zeros(1 << BUCKETS, bool)
    for chunk, bits in parts.mapInArrow(add, "chunk int, heavy binary").collect():  # a bit for each bucket
        out[chunk << CHUNK : (chunk + 1) << CHUNK] = np.unpackbits(np.frombuffer(bits, np.uint8))
    return out


def _summed(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of keys and a count, equal keys put together."""
    whole = np.concatenate(rows)
    whole = whole[np.lexsort(whole[:, :-1].T)]
    starts = np.flatnonzero(np.concatenate(([True], (whole[1:, :-1] != whole[:-1, :-1]).any(axis=1))))
    return np.concatenate((whole[starts, :-1], np.add.reduceat(whole[:, -1:], starts)), axis=1)


def counted(sequences: DataFrame, shortest: int, longest: int, least: int) -> DataFrame:
    """(k0, k1, ..., n): n-grams of ``sequences`` (n, ids) that may occur ``least`` times over all; two words to a key, 0 for none.

    Shards of one task are added up, as far as memory goes.
    """
    heavy, n_keys = np.packbits(heavy_buckets(sequences, shortest, longest, least)), -(-longest // 2)
    names = [*[f"k{i}" for i in range(n_keys)], "n"]

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[:, i])) for i in range(part.shape[1])], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_heavy = np.unpackbits(heavy).astype(bool)
        held = []
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                known, sequence = np.unique(_unpacked(data, n), return_inverse=True)

                def keep(words: np.ndarray, known: np.ndarray = known) -> np.ndarray:
                    return is_heavy[_bucket_of(known[words])] if words.shape[1] >= shortest else np.ones(len(words), bool)

                for words, count in walk(sequence, longest, keep):
                    if words.shape[1] >= shortest and len(count):
                        full = np.zeros((len(words), 2 * n_keys), np.int64)
                        full[:, : words.shape[1]] = known[words]
                        held.append(np.concatenate((full[:, ::2] << 32 | full[:, 1::2], count[:, None]), axis=1))
                if sum(map(len, held)) > MERGED:
                    held = [_summed(held)]
                    if len(held[0]) > MERGED // 2:
                        yield from out(held.pop())
        if held:
            yield from out(_summed(held))

    return sequences.select("n", "ids").mapInArrow(work, ", ".join(f"{c} long" for c in names))


def _lists(by: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The different values of ``by``, and of each column a list for each of them."""
    order = np.argsort(by, kind="stable")
    values, starts = np.unique(by[order], return_index=True)
    offsets = pa.array(np.append(starts, len(by)), pa.int32())
    return values, [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns]


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (gid, at) of words to (shard, kept), each place's id and gid in one number; a shard has a few rows a task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            shard, (kept,) = _lists(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(shard), kept], ["shard", "kept"])
        held.clear()

    for batch in batches:
        at = batch.column("at")
        places = at.flatten()
        gid = np.repeat(batch.column("gid").to_numpy(), at.value_lengths().to_numpy())
        held.append((places.field("shard").to_numpy(), places.field("id").to_numpy().astype(np.int64) << 32 | gid))
        if sum(len(x) for x, _ in held) > MERGED:
            yield from out()
    yield from out()


def frequent_pairs(sequences: DataFrame, heavy: bytes, n_chunks: int, least: int) -> DataFrame:
    """(shard, pairs, f): lists of the pairs that occur ``least`` times over all ``sequences`` (shard, n, ids).

    With their frequencies once, shard being null, and each shard's own pairs, f being
    null. Pairs are dealt by their hash into ``n_chunks`` parts; a shard has a row for
    each part, so the rows that are shuffled are as many as the lists, not the pairs.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_heavy = np.unpackbits(np.frombuffer(heavy, np.uint8)).astype(bool)
        for batch in batches:
            for shard, n, data in zip(*[batch.column(c).to_pylist() for c in ("shard", "n", "ids")], strict=True):
                known, sequence = np.unique(_unpacked(data, n), return_inverse=True)
                for words, counts in walk(sequence, 2, lambda words, known=known: is_heavy[_bucket_of(known[words])]):
                    both = known[words]
                    chunk, lists = _lists(_bucket_of(both) % n_chunks, both[:, 0] << 32 | both[:, 1], counts)
                    yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(np.full(len(chunk), shard)), *lists], ["chunk", "shard", "pairs", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                parts.setdefault(chunk, []).append(batch.slice(i, 1))
        for rows in parts.values():
            lists = [r.column("pairs") for r in rows]
            pairs = np.concatenate([x.flatten().to_numpy() for x in lists])
            shard = np.repeat([r.column("shard")[0].as_py() for r in rows], [len(x.flatten()) for x in lists])
            different, which = np.unique(pairs, return_inverse=True)
            f = np.zeros(len(different), np.int64)
            np.add.at(f, which, np.concatenate([r.column("counts").flatten().to_numpy() for r in rows]))
            enough = f >= least
            if enough.any():
                here = enough[which]
                own, (kept,) = _lists(shard[here], pairs[here])
                _, (found, often) = _lists(np.zeros(int(enough.sum()), np.int64), different[enough], f[enough])
                for columns in ([pa.array(own), kept, pa.nulls(len(own), often.type)], [pa.nulls(1, pa.int64()), found, often]):
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "pairs", "f"])

    dealt = sequences.select("shard", "n", "ids").mapInArrow(count, "chunk int, shard long, pairs array<long>, counts array<long>")
    return dealt.repartition("chunk").mapInArrow(add, "shard long, pairs array<long>, f array<long>")


def _maybe_pairs(heavy: bytes):
    """Task: sequences to the runs of words whose neighbouring pairs may be frequent."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_heavy = np.unpackbits(np.frombuffer(heavy, np.uint8)).astype(bool)
        for batch in batches:
            for i in range(batch.num_rows):
                words = _unpacked(batch.column("ids")[i].as_py(), batch.column("n")[i].as_py())
                pairs = np.stack((words[:-1], words[1:]), axis=1)
                sequence = _runs(words, is_heavy[_bucket_of(pairs)] & (pairs > 0).all(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), pa.array([len(sequence)], pa.int32()), pa.array([_packed(sequence)], pa.binary())], ["shard", "n", "ids"])

    return work


def _words_of(n_keys: int):
    """The numbers of the words in keys, as an array."""
    halves = [x for i in range(n_keys) for x in (F.shiftright(f"k{i}", 32), F.col(f"k{i}").bitwiseAND(F.lit(0xFFFFFFFF)))]
    return F.filter(F.array(*halves), lambda x: x > 0)


def frequencies(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words and phrases found ``least`` times or more: (p, f) with p the numbers of a phrase's words, (gid, lang, word) of these numbers, and (lang, n) with all word occurrences.

    Call it within ``scratch``. Words of different languages have different numbers.
    """
    held = stored(shards(docs, text, lang), codec="zstd")
    totals = stored(held.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")))
    each = held.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("shard", "lang", (F.col("place") + 1).alias("id"), "w.words", "w.counts")
    # a word has a place a shard at most, and is counted and numbered where its places meet
    by_word = each.repartition("lang", "words").groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f"), F.collect_list(F.struct("shard", "id")).alias("at"))
    numbered, total = dense(stored(by_word.where(F.col("f") >= least).withColumn("__place", F.monotonically_increasing_id())), "gid")
    if total >= 1 << 31:
        raise ValueError(f"{total} frequent words; two numbers don't fit a key")
    numbered = numbered.withColumn("gid", F.col("gid") + 1)
    shared = lambda lists: lists.groupBy("shard").agg(F.flatten(F.collect_list("kept")).alias("kept"))
    own = "shard long, n int, ids binary"
    beside = shared(numbered.select("gid", "at").mapInArrow(_by_shard, "shard long, kept array<long>"))
    words = stored(held.select("shard", "n", "ids").join(beside, "shard").mapInArrow(_sequences(_only_words), own))
    heavy = np.packbits(heavy_buckets(words, 2, 2, least)).tobytes()
    pairs = stored(frequent_pairs(words, heavy, PARTS + held.count() // 16, least))
    two = pairs.where("shard is null").select(F.explode(F.arrays_zip(F.col("pairs").alias("k0"), "f")).alias("x")).select("x.k0", "x.f")
    found = numbered.select(F.array("gid").alias("p"), "f").unionByName(two.select(_words_of(1).alias("p"), "f"))
    if most_words > 2:
        beside = shared(pairs.where("shard is not null").select("shard", F.col("pairs").alias("kept")))
        # most of a sequence goes before it is shuffled
        runs = stored(words.mapInArrow(_maybe_pairs(heavy), own).join(beside, "shard").mapInArrow(_sequences(_only_pairs), own))
        longer = counted(runs, 3, most_words, least)
        keys = [c for c in longer.columns if c != "n"]
        longer = longer.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        found = found.unionByName(longer.select(_words_of(len(keys)).alias("p"), "f"))
    return stored(found), numbered.select("gid", "lang", "word"), totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, reported: int = REPORTED) -> DataFrame:
    """(lang, rank int, phrase, a, l, r, n, score): each language's best collocations.

    Phrases of 2 to ``most_words`` words of one piece that occur ``least`` times or
    more, a. The cut with the lowest score, floor(1000 a n / (l r)), counts, ties going
    to the shortest first part; l and r are the frequencies of its two parts, n that of
    all words. A phrase is dropped if a longer one that holds it is as frequent: then
    one of one more word is, so only these are looked at. Best by score, a, and phrase
    in the order of UTF-8 bytes. Null and empty texts have no words; a null language
    is ``und``. Repeated rows count as often as they occur; extra columns are ignored.
    """
    with scratch(docs.sparkSession):
        found, spelling, totals = frequencies(docs, text, lang, least, most_words)
        sized = found.withColumn("size", F.size("p"))
        parts = F.array(F.slice("p", F.lit(1), F.col("size") - 1), F.slice("p", F.lit(2), F.col("size") - 1))
        longer = sized.where("size > 2").select(F.explode(parts).alias("p"), "f").groupBy("p").agg(F.max("f").alias("within"))
        kept = sized.where("size > 1").join(longer, "p", "left").where(F.coalesce("within", F.lit(0)) < F.col("f"))
        cuts = kept.select("p", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        halves = cuts.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("first"), F.slice("p", F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
        side = lambda name, f: found.select(F.col("p").alias(name), F.col("f").alias(f))
        both = halves.join(side("first", "l"), "first").join(side("rest", "r"), "rest").withColumn("gid", F.col("p")[0])
        scored = both.join(spelling.select("gid", "lang"), "gid").join(totals, "lang")
        wide = lambda c: F.col(c).cast("decimal(38,0)")
        scored = scored.withColumn("top", F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n")).withColumn("bottom", wide("l") * wide("r"))
        lowest = scored.withColumn("score", F.expr("top div bottom")).groupBy("lang", "p").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("c"))
        best = [F.desc("score"), F.desc("a")]
        # those that tie with the last one stay until they are spelled
        first = stored(lowest.select("lang", "p", "c.*").withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= reported))
        words = first.select("p", F.posexplode("p").alias("at", "gid")).join(spelling.select("gid", "word"), "gid").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
        spelled = first.join(words, "p").withColumn("phrase", F.array_join("w.word", " "))
        ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase"))).where(F.col("rank") <= reported)
        return stored(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), keep=True)


#: The same over view documents in DuckDB SQL.
ORACLE = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM pieces, (SELECT unnest(range(1, {MOST_WORDS + 1})) AS size) WHERE len(w) >= size
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang
), found AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}
), kept AS (
  SELECT p.* FROM found p WHERE size > 1 AND NOT EXISTS (SELECT 1 FROM found q WHERE q.lang = p.lang AND q.size > p.size AND q.f >= p.f AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN found x ON x.lang = c.lang AND x.phrase = c.first JOIN found y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS INT) AS rank, phrase, a, l, r, n, score FROM least QUALIFY rank <= {REPORTED}"""
