"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text's paragraphs are its lines, and sections are parted by blank lines. Below
a paragraph come leaves of a few words, or of a few characters where no space
occurs. Where a leaf ends is decided by the characters around that place alone,
so an edit changes the leaves that it touches and no others, in any script; only
stretches of ``LEAF_MOST`` characters without such a place are cut by their length. A
node's digest covers its children's; the root covers the exact text.

The fingerprint is the tree written down: the root digest, then sections parted
by ``;``, paragraphs by ``,`` and leaf digests of four characters. Roots test
equality, and two fingerprints are compared branch by branch: equal sections are
settled at once, differing ones descend to paragraphs and leaves.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallframe.session import stored, without

ROOT_BYTES, LEAF_CHARS = 16, 4
#: A place between words ends a leaf once in WORD_RATE times, one between other characters once in CHAR_RATE times, both by hash of the WINDOW characters before it.
WORD_RATE, CHAR_RATE, WINDOW = 2, 16, 4
#: Characters of the longest leaf. Texts that repeat a few characters have no other ends of leaves.
LEAF_MOST = 64
#: Key ranges for each partition of the input, and rows of the sample for each range.
RANGES, SAMPLED = 2, 20
#: Odd multipliers: of characters in a window and of places in a leaf.
MIX, STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def leaf_ends(points: np.ndarray) -> np.ndarray:
    """The places behind which a leaf ends, ascending; the last is the end of the text. A line break always ends one."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    values = points.astype(np.uint64) + np.uint64(1)
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window[k:] += values[: n - k] * np.uint64(pow(MIX, k + 1, 1 << 64))
    hashed = _mixed(window) >> np.uint64(40)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    last_space = space.copy()
    last_space[:-1] &= ~space[1:]  # the last of a run of white space
    ends = np.where(last_space, hashed % np.uint64(WORD_RATE) == 0, ~space & (hashed % np.uint64(CHAR_RATE) == 0))
    ends |= points == 10
    ends[-1] = True
    found = np.flatnonzero(ends).astype(np.int64)
    starts = np.concatenate((np.zeros(1, np.int64), found[:-1] + 1))
    more = (found - starts) // LEAF_MOST  # places that are missing in each leaf
    if not more.any():
        return found
    nth = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    return np.sort(np.concatenate((found, np.repeat(starts, more) + (nth + 1) * LEAF_MOST - 1)))


def leaves(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ends, digests): the places behind which leaves end, and a 24-bit digest of each leaf's characters and length."""
    points = _points(text)
    ends = leaf_ends(points)
    if not len(ends):
        return ends, np.zeros(0, np.uint64)
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    sizes = ends + 1 - starts
    powers = np.full(int(sizes.max()), STEP, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inside = np.arange(len(points)) - np.repeat(starts, sizes)
    own = np.add.reduceat(_mixed(points.astype(np.uint64) + np.uint64(MIX)) * powers[inside], starts)
    return ends, _mixed(own + sizes.astype(np.uint64)) >> np.uint64(40)


def _node(children: list[str], tag: bytes, size: int) -> bytes:
    return hashlib.blake2b("|".join(children).encode(), digest_size=size, person=tag).digest()


def tree(text: str) -> list[list[str]]:
    """Paragraphs by section, each as its leaves' digests written one after another; blank lines part sections and are no paragraphs."""
    ends, digests = leaves(text)
    written = base64.b64encode(digests.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()).decode()
    sections: list[list[str]] = [[]]
    at = 0
    lines = text.split("\n")
    # a line's leaves: those that end in it or with its line break
    upto = np.searchsorted(ends, np.cumsum([len(x) + 1 for x in lines]) - 1, side="right").tolist()
    for line, to in zip(lines, upto, strict=True):
        if line.strip():
            sections[-1].append(written[LEAF_CHARS * at : LEAF_CHARS * to])
        elif sections[-1]:
            sections.append([])
        at = to
    return sections if sections[-1] or len(sections) == 1 else sections[:-1]


def fingerprint(text: str) -> str:
    """Root digest, then the tree. The root hashes the text's length and digest along with its sections, so equal roots mean equal texts."""
    grown = tree(text)
    sections = ["|".join(_node([p], b"paragraph", 8).hex() for p in s) for s in grown]
    whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=ROOT_BYTES).hexdigest()
    root = _node([str(len(text)), whole, *sections], b"root", ROOT_BYTES).hex()
    return root + ":" + ";".join(",".join(s) for s in grown)


def _children(print_: str) -> tuple[str, list[str]]:
    root, _, body = print_.partition(":")
    return root, body.split(";") if body else []


def _matched(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """What remains of both lists once equal branches are taken out, as often as both have them."""
    rest_a, rest_b = Counter(a), Counter(b)
    both = rest_a & rest_b
    return list((rest_a - both).elements()), list((rest_b - both).elements())


def _common(a: str, b: str) -> int:
    """Leaves that two runs of leaf digests have in common, as often as both have them."""
    x, y = (np.sort(np.frombuffer(s.encode(), "<u4")) for s in (a, b))
    if not len(x) or not len(y):
        return 0
    # a leaf's ordinal among its equals finds its partner among those of the other side
    places = np.arange(len(x))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], x[1:] != x[:-1])), places, 0))
    at = np.searchsorted(y, x) + places - first
    inside = at < len(y)
    return int(np.count_nonzero(y[at[inside]] == x[inside]))


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common, 1 for equal roots (Dice over repeated leaves).

    Two fingerprints without leaves and with different roots have likeness 0.
    """
    (root_a, sections_a), (root_b, sections_b) = _children(a), _children(b)
    if root_a == root_b:
        return 1.0
    total = sum(len(s.replace(",", "")) for s in sections_a + sections_b) // LEAF_CHARS
    if not total:
        return 0.0
    rest_a, rest_b = _matched(sections_a, sections_b)
    paragraphs_a, paragraphs_b = _matched([p for s in rest_a for p in s.split(",")], [p for s in rest_b for p in s.split(",")])
    left_a, left_b = "".join(paragraphs_a), "".join(paragraphs_b)
    apart = (len(left_a) + len(left_b)) // LEAF_CHARS - 2 * _common(left_a, left_b)
    # different texts never reach 1, even with the same leaves
    return min((total - apart) / total, 1 - 1 / (total + 1))


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of ``a`` whose branch ``b`` lacks."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    have = Counter(p for s in _children(b)[1] for p in s.split(","))
    found = []
    for i, s in enumerate(_children(a)[1]):
        for k, p in enumerate(s.split(",")):
            if have[p]:
                have[p] -= 1
            else:
                found.append((i, k))
    return found


def _texts(column) -> list[str]:
    """Null as empty; bytes that aren't UTF-8 as the replacement character."""
    return [(b or b"").decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of its whole ``text`` (null: empty) instead of the text; a column named like ``out`` is replaced."""
    kept = without(df, out)
    fields = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(out, T.StringType())])

    def work(batches):
        for batch in batches:
            prints = [fingerprint(t) for t in _texts(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(prints, pa.string())], schema.names)

    return kept.mapInArrow(work, schema)


def _ranges_of(keys: np.ndarray, ties: np.ndarray, bound_keys: np.ndarray, bound_ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the last range whose bound isn't above it, and whether it equals that bound; bounds are sorted pairs."""
    low = np.searchsorted(bound_keys, keys, side="left")
    high = np.searchsorted(bound_keys, keys, side="right")
    own = high - 1
    # a key that is a bound itself, maybe several times, is placed by its tie
    for at in np.unique(low[high > low]).tolist():
        mine = (low == at) & (high > low)
        end = int(np.searchsorted(bound_keys, bound_keys[at], side="right"))
        own[mine] = at + np.searchsorted(bound_ties[at:end], ties[mine], side="right") - 1
    own = np.maximum(own, 0)
    return own, (bound_keys[own] == keys) & (bound_ties[own] == ties)


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df``'s (key, text) rows dealt into ranges of ``key``, each range sorted and closed by the row that follows it.

    Columns range, tail, key and text; ``tail`` marks the copy of the next
    range's first row. Texts move once, each range to a task of its own. The
    bounds are rows of a sample that takes a row the likelier the longer its text
    is, so ranges hold like numbers of bytes. The sample is all that the driver
    gathers: three numbers a row, about ``SAMPLED`` rows for each range, and the
    ranges follow the partitions of the input. Keys are whole numbers; null keys
    sort first. Rows that share a key are in order of a hash of
    their texts and may spread over ranges; only rows that are equal throughout
    stay together. They stream through, so their number costs time but no memory.
    """
    tie = F.xxhash64("text")
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    least = F.lit(-(1 << 63)).cast("long")
    narrow = stored(rows.select(F.coalesce("key", least).alias("k"), tie.alias("h"), (F.octet_length("text") + F.lit(1).cast("long")).alias("z")))
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), RANGES * df.select(key).rdd.getNumPartitions())
    whole = narrow.agg(F.min(F.struct("k", "h")).alias("first"), F.sum("z").alias("z")).first()
    rate = SAMPLED * n / (whole.z or 1)
    taken = narrow.where(F.rand(1) < F.col("z") * rate).select("k", "h", F.greatest(F.col("z"), F.lit(1 / rate)).alias("z"))
    pieces = sorted(tuple(r) for r in taken.collect())
    goal = sum(z for *_, z in pieces) / n
    bounds, filled = [tuple(whole.first)] if whole.first else [], 0
    for k, h, z in pieces:
        if filled + z / 2 > goal and (k, h) > bounds[-1]:
            bounds.append((k, h))
            filled = 0
        filled += z
    bound_keys, bound_ties = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    @F.pandas_udf("array<int>")
    def ranges(k: pd.Series, h: pd.Series) -> pd.Series:
        own, opens = _ranges_of(k.to_numpy(np.int64), h.to_numpy(np.int64), bound_keys, bound_ties)
        before = np.where(own == 0, len(bounds) - 1, own - 1)
        return pd.Series([[r, b] if o else [r] for r, b, o in zip(own.tolist(), before.tolist(), opens.tolist(), strict=True)])

    dealt = rows.withColumn("h", tie).withColumn("ranges", ranges(F.coalesce("key", least), "h")).select(F.posexplode("ranges").alias("tail", "range"), "key", "h", "text")
    placed = dealt.repartitionById(max(1, len(bounds)), "range")
    return placed.select("range", (F.col("tail") == 1).alias("tail"), "key", "h", "text").sortWithinPartitions("tail", "key", "h").select("range", "tail", "key", "text")


def half_replaced(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is that of the next key, after the last the first; a single row
    is its own next. Null texts are empty. Repeated keys follow each other in
    order of a hash of the text. Other columns of ``df`` are left out. Empty tables stay empty.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def work(batches):
        held, printed = None, ""  # the row that waits for its next, and its fingerprint
        for batch in batches:
            out = []
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), _texts(batch.column(3)), strict=True)
            for place, tail, k, t in rows:
                if held and held[0] != place:
                    held = None  # a closed range
                if tail and (held is None or held[1]):
                    continue  # further rows with the closing key
                p = fingerprint(t)
                if held:
                    _, _, k0, t0 = held
                    edited = half_replaced(t0, t)
                    e = fingerprint(edited)
                    out.append((k0, len(t0), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), printed, e, likeness(printed, e), likeness(printed, p)))
                held, printed = (place, tail, k, t), p
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2), strict=True)], schema.names)

    done = with_next(df, key, text).mapInArrow(work, schema)
    return done.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)
