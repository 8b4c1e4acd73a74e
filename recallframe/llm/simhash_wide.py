"""The SimHash operator at a wider radius: near copies of a similarity of 0.8 or more.

Two texts of Jaccard similarity 0.8 on shingles differ in a seventh of their
fingerprint's bits, far more than a ball of radius 2 holds. So fingerprints are
longer (``Layout``), in segments with a table each. The ball that is enumerated
around a segment is small and goes where differences are: all flips of the bits
whose votes were closest. Pairs come from the table entries in three rounds, and
none that shares an entry is left out:

* Each entry answers with its smallest and its largest fingerprint, two rows per
  member. That is all of an entry of one or two fingerprints, and ties a group of
  any size together.
* In the other entries all pairs follow whose members aren't connected by then,
  as long as that is at most ``BUCKET`` comparisons for each member of the entry.
  Pairs of one component can't change the groups, so a large group costs nothing.
* The members of fuller entries go an exact way round: two sets of a similarity
  of 0.8 share one of the rarest fifth of each one's shingles, so they meet there.

So a group of copies costs little, however hot an entry is. What isn't linear are
texts that share many shingles and yet less than asked for: of those that meet in
full entries, all that share one of their rarest shingles are compared. The more rows
there are, the more entries are full by chance, and the more go that exact way.

Fingerprints only find candidates. Near copies are those of the candidates whose
exact sets of shingles have a Jaccard similarity of 0.8 or more. The sets are made
anew from the texts of candidates, so none are kept for the other rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallframe.llm.components import components
from recallframe.session import cut, few, scratch, stored, without


@dataclass(frozen=True)
class Layout:
    """Bits of a fingerprint (a multiple of 64), bits of a segment (of 8), flipped bits of a ball."""

    bits: int
    segment: int
    flips: int

    @property
    def words(self) -> int:
        return self.bits // 64

    @property
    def segments(self) -> int:
        return self.bits // self.segment

    @property
    def distance(self) -> int:
        """Most bits that candidates differ in: the expected number at a similarity of 0.8, and five deviations more."""
        return int(0.1515 * self.bits + 5 * (0.1515 * 0.8485 * self.bits) ** 0.5)


#: The layout of every table, whatever its size: pairs of similarity 0.8 share an entry with probability 0.95, and a row has 168 probes.
LAYOUT = Layout(512, 24, 3)
#: Comparisons per member of an entry, beyond which its members go the exact way.
BUCKET = 64
#: Least Jaccard similarity of near copies' sets of shingles, as a fraction.
SIMILAR = (4, 5)
SLICE, BLOCK = 512, 255 * 64


def _hashes(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent 64-bit hashes of each hash."""
    out = np.empty((len(h), words), np.uint64)
    for j in range(words):
        x = h + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, j] = x ^ (x >> np.uint64(31))
    return out


def shingles_of(text: bytes, width: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles; a text of fewer words is one shingle, without words none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths[:-1])))
    ends = (starts + lengths - 1)[width - 1 :].tolist() or [len(joined)]
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(ends)].tolist(), ends, strict=True)], np.uint64))


def fingerprint_of_set(shingles: np.ndarray, layout: Layout) -> tuple[bytes, bytes]:
    """(fingerprint, places of the closest votes by segment), each shingle with one vote; of no shingles zeros."""
    if not len(shingles):
        return bytes(layout.bits // 8), bytes(layout.segments * layout.flips)
    ones = np.zeros(layout.bits, np.int64)
    for at in range(0, len(shingles), BLOCK):
        h = shingles[at : at + BLOCK]
        bits = np.unpackbits(_hashes(h, layout.words).view(np.uint8).reshape(len(h), layout.bits // 8), axis=1, bitorder="little")
        whole = len(h) // 255 * 255
        # 255 rows at most add up within a byte
        ones += bits[:whole].reshape(-1, 255, layout.bits).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    votes = 2 * ones - len(shingles)
    parted = np.abs(votes)[: layout.segments * layout.segment].reshape(layout.segments, layout.segment)
    low = np.argsort(parted, axis=1, kind="stable")[:, : layout.flips].astype(np.uint8)
    return np.packbits(votes > 0, bitorder="little").tobytes(), low.tobytes()


def _sets(column, width: int) -> list[np.ndarray]:
    return [shingles_of(t or b"", width) for t in column.cast(pa.binary()).to_pylist()]


def fingerprints(df: DataFrame, text: str, width: int, layout: Layout) -> DataFrame:
    """``df`` with ``wide``, ``low`` (binary) and ``fid``, a hash of the set of shingles, instead of its whole ``text``; null is as empty."""
    kept = without(df, "wide", "low", "fid")
    fields = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField("wide", T.BinaryType()), T.StructField("low", T.BinaryType()), T.StructField("fid", T.LongType())])

    def work(batches):
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = _sets(part.column(text), width)
                pairs = [fingerprint_of_set(s, layout) for s in sets]
                columns = [pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)]
                columns.append(pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], *columns], schema.names)

    return kept.mapInArrow(work, schema)


def shingle_sets(df: DataFrame, text: str, width: int) -> DataFrame:
    """(fid, shingles) of the rows of ``df`` (fid, ``text``)."""

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = _sets(part.column(text), width)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("fid"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], ["fid", "shingles"])

    return df.select("fid", text).mapInArrow(work, "fid long, shingles array<long>")


def _probes(layout: Layout):
    """(key, fid, own) rows: each segment's ball, its first value being the segment itself."""
    segments, flips, width = layout.segments, layout.flips, layout.segment // 8

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n = part.num_rows
                wide = np.frombuffer(b"".join(part.column("wide").to_pylist()), np.uint8).reshape(n, layout.bits // 8)
                wide = wide[:, : segments * width].reshape(n, segments, width).astype(np.int64)
                value = sum(wide[:, :, i] << (8 * i) for i in range(width))
                low = np.frombuffer(b"".join(part.column("low").to_pylist()), np.uint8).reshape(n, segments, flips).astype(np.int64)
                flipped = np.zeros((n, segments, 1 << flips), np.int64)
                for s in range(1, 1 << flips):
                    for b in range(flips):
                        if s >> b & 1:
                            flipped[:, :, s] |= np.int64(1) << low[:, :, b]
                keys = (value[:, :, None] ^ flipped) | (np.arange(segments, dtype=np.int64) << 40)[None, :, None]
                own = np.zeros(flipped.shape, bool)
                own[:, :, 0] = True
                ids = np.repeat(part.column("fid").to_numpy(zero_copy_only=False), segments << flips)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids), pa.array(own.ravel())], ["key", "fid", "own"])

    return work


def _words(prints: DataFrame, layout: Layout) -> DataFrame:
    """Each fid's fingerprint as ``w``, an array of longs."""
    return prints.select("fid", F.array(*[F.conv(F.hex(F.substring("wide", 8 * i + 1, 8)), 16, -10).cast("long") for i in range(layout.words)]).alias("w"))


def _close(pairs: DataFrame, layout: Layout) -> DataFrame:
    """Pairs (u, v) of rows (u, v, l, r) whose fingerprints l and r differ in few bits, each once."""
    apart = sum((F.bit_count(F.col("l")[i].bitwiseXOR(F.col("r")[i])) for i in range(layout.words)), F.lit(0))
    return pairs.where(apart <= layout.distance).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _found(probes: DataFrame) -> DataFrame:
    """(key, fid, own, a, b, n) of the probes that meet another fingerprint: the entry's smallest and largest one, and its number of them."""
    entries = probes.where("own").groupBy("key").agg(F.min("fid").alias("a"), F.max("fid").alias("b"), F.count("*").alias("n"))
    return stored(probes.join(entries, "key").where("n > 1 or a <> fid"))


def _stars(found: DataFrame, words: DataFrame, layout: Layout) -> DataFrame:
    """Close pairs of each entry's members with its smallest and its largest fingerprint."""
    ends = found.select(F.col("fid").alias("u"), F.explode(F.array_distinct(F.array("a", "b"))).alias("v"))
    pairs = ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return _close(pairs.join(words.toDF("u", "l"), "u").join(words.toDF("v", "r"), "v"), layout)


def _named(found: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, label, fid, own) of the entries of three fingerprints or more, and (key, full) of those that more than one component meets in.

    An entry is full if pairing its components' members costs more than
    ``BUCKET`` comparisons for each of its members.
    """
    large = found.where("n > 2").select("key", "fid", "own")
    named = stored(large.join(labels.withColumnRenamed("node", "fid"), "fid", "left").withColumn("label", F.coalesce("label", "fid")))
    sides = named.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum(F.col("own").cast("long")).alias("o"))
    # of the pairs with an own side, those within a component don't count
    m, o = F.sum("m").cast("double"), F.sum("o").cast("double")
    costs = sides.groupBy("key").agg(F.count("*").alias("c"), (m * o - F.sum(F.col("m").cast("double") * F.col("o"))).alias("cost"), m.alias("n"))
    return named, stored(costs.where("c > 1 and cost > 0").select("key", (F.col("cost") > BUCKET * F.col("n")).alias("full")))


def _rest(named: DataFrame, keys: DataFrame, words: DataFrame, layout: Layout) -> DataFrame:
    """Close pairs of members of the entries ``keys`` that are of different components.

    The entries' components are paired first and then their members, so that
    members of one component never meet.
    """
    members = stored(named.join(keys, "key", "left_semi").join(words, "fid").select("key", "label", "fid", "w", "own"))
    sides = members.groupBy("key", "label").agg(F.max("own").alias("own"))
    meet = sides.select("key", F.col("label").alias("x")).join(sides.where("own").select("key", F.col("label").alias("y")), "key").where("x <> y")
    left = members.select("key", F.col("label").alias("x"), F.col("fid").alias("u"), F.col("w").alias("l"))
    right = members.where("own").select("key", F.col("label").alias("y"), F.col("fid").alias("v"), F.col("w").alias("r"))
    return _close(meet.join(left, ["key", "x"]).join(right, ["key", "y"]), layout)


def _rarest(members: DataFrame, sets) -> DataFrame:
    """Pairs (u, v) of ``members`` (fid, label) of different components that share one of the rarest fifth of each one's shingles.

    All that ``SIMILAR`` asks for are among them: of n shingles, ordered in one
    way for all, two such sets share one of the first n - ceil(0.8 n) + 1.
    """
    own = sets(members.select("fid")).withColumnRenamed("shingles", "s")
    each = own.select("fid", F.explode("s").alias("x"))
    counts = stored(each.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"))
    often = each.join(counts, "x")
    # shingles of one document only come first and pair nothing
    ordered = often.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("o"))
    size, shared = F.size("s"), F.size("o")
    prefix = size - F.ceil(size * SIMILAR[0] / SIMILAR[1]) + 1 - (size - shared)
    first = ordered.join(own.select("fid", "s"), "fid").select("fid", prefix.cast("int").alias("k"), "o").where("k > 0")
    tokens = first.select("fid", F.explode(F.slice("o", 1, F.col("k"))["x"]).alias("x")).join(members, "fid")
    tokens = stored(tokens.select("x", "fid", "label"))
    # components meet first and then their members, as in _rest
    sides = tokens.select("x", "label").distinct()
    meet = sides.toDF("x", "p").join(sides.toDF("x", "q"), "x").where("p < q")
    pairs = meet.join(tokens.toDF("x", "u", "p"), ["x", "p"]).join(tokens.toDF("x", "v", "q"), ["x", "q"])
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _similar(pairs: DataFrame, sets) -> DataFrame:
    """The pairs (u, v) whose sets of shingles have a Jaccard similarity of ``SIMILAR`` or more; ``sets`` makes (fid, shingles) of asked fids."""
    pairs = stored(pairs)
    known = sets(stored(pairs.select(F.explode(F.array("u", "v")).alias("fid")).distinct()))
    both = pairs.join(known.toDF("u", "su"), "u").join(known.toDF("v", "sv"), "v")
    shared, total = F.size(F.array_intersect("su", "sv")), F.size("su") + F.size("sv")
    return cut(both.where(shared * sum(SIMILAR) >= total * SIMILAR[0]).select("u", "v"))


def links(prints: DataFrame, sets, layout: Layout) -> DataFrame:
    """Verified edges (u, v) between ids of ``prints`` (fid, wide, low), which holds each id once.

    They connect all pairs that share an entry, are close enough, and are similar
    by their exact shingles; ``sets`` makes (fid, shingles) of a table of fids.
    """
    found = _found(prints.select("fid", "wide", "low").mapInArrow(_probes(layout), "key long, fid long, own boolean"))
    words = _words(prints, layout)
    stars = _similar(_stars(found, words, layout), sets)
    named, keys = _named(found, components(stars))
    linked = stars.unionByName(_similar(_rest(named, keys.where("not full"), words, layout), sets))
    full = stored(named.join(keys.where("full"), "key", "left_semi").select("fid", "label").distinct())
    return linked if full.isEmpty() else linked.unionByName(_similar(_rarest(full, sets), sets))


def _grouped(rows: DataFrame, doc: str, text: str, width: int, layout: Layout | None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a number __row, written; and these less their text, with __first: a struct of the doc and __row that stand for the row's group.

    That is the group's smallest doc, nulls last; of one doc the smallest hash of the text.
    """
    held = stored(without(rows, "__row").withColumn("__row", F.monotonically_increasing_id()), keep=True)
    layout = layout or LAYOUT
    order = F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("doc"), F.xxhash64(text).alias("h"), F.col("__row").alias("row"))
    printed = stored(fingerprints(held.withColumn("__order", order), text, width, layout))
    different = cut(printed.groupBy("fid").agg(F.min("__order").alias("least"), F.min(F.struct("__row", "wide", "low")).alias("p")).select("fid", "least", "p.__row", "p.wide", "p.low"))

    def sets(asked: DataFrame) -> DataFrame:
        one = stored(different.select("fid", "__row").join(few(asked), "fid", "left_semi"))
        return stored(shingle_sets(held.select("__row", text).join(few(one), "__row"), text, width))

    labels = components(cut(links(different, sets, layout)))
    named = different.select("fid", "least").join(labels.withColumnRenamed("node", "fid"), "fid", "left").withColumn("label", F.coalesce("label", "fid"))
    first = named.groupBy("label").agg(F.min("least").alias("__first"))
    classes = cut(named.select("fid", "label").join(first, "label").select("fid", "__first"))
    return held, printed.drop("wide", "low", "__order").join(classes, "fid").drop("fid")


def groups(rows: DataFrame, doc: str, text: str, width: int, layout: Layout | None = None) -> DataFrame:
    """``rows`` less its text, with group_id: the smallest ``doc`` among a row's near copies.

    Equal sets of shingles are one group whatever their number; rows without words
    are one group too. Null docs count only where a group has no others. The
    layout is the same for every number of rows unless it is given.
    """
    _, grouped = _grouped(without(rows, "group_id"), doc, text, width, layout)
    return grouped.withColumn("group_id", F.col("__first.doc")).drop("__first", "__row")


def one_of_each(rows: DataFrame, doc: str, text: str, width: int, layout: Layout | None = None) -> DataFrame:
    """The row of each group of near copies that has the smallest ``doc``, nulls last; of one doc that with the smallest hash of the text.

    Rows are told apart by numbers of their own, so null and repeated docs don't
    make rows one. Of rows that are equal throughout one stays.
    """
    with scratch(rows.sparkSession):
        held, grouped = _grouped(rows, doc, text, width, layout)
        kept = stored(grouped.where(F.col("__row") == F.col("__first.row")).select(F.col("__row").alias("__kept")), keep=True)
    return held.join(kept.hint("shuffle_hash"), F.col("__row") == F.col("__kept"), "left_semi").select(*[f"`{c}`" for c in rows.columns])
