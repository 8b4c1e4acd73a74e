"""SimHash near-duplicates with multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two fingerprints that
differ in at most 2 bits differ in at most 1 bit on one of the segments, so each
fingerprint asks the table of a segment for the 33 values of the Hamming ball of
radius 1 around its own segment, and every match is verified on all 64 bits.

Everything runs on *distinct* fingerprints, so exact copies cost one row. A
table entry with more than ``BUCKET`` distinct fingerprints isn't paired at all:
whoever meets such an entry takes an exact way round it. Two fingerprints link
exactly if their full balls of radius 1 (65 values) share a value; at most 65
distinct fingerprints contain one value, and linking all of these to the
smallest is right, as any two of them differ in 2 bits at most. That way is
linear in the rows, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallframe.llm.components import components
from recallframe.session import cut, without

SEGMENT = 32
#: A table entry of more distinct fingerprints is met on the exact way, not by pairs.
BUCKET = 64
#: Rows of an Arrow batch and shingles that are worked on at once in a task.
SLICE, BLOCK = 512, 1 << 16


def fingerprint_of(text: bytes, width: int, seed: int = 42) -> int:
    """SimHash of the word shingles as a signed 64-bit number."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return int(np.uint64(digest(b" ".join(words), seed)).astype(np.int64))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths[:-1])))
    ends = (starts + lengths - 1)[width - 1 :].tolist()
    starts = starts[: len(ends)].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(ends), BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(ends)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """``df`` with the SimHash (long) of its whole ``text`` instead of the text.

    A text of fewer words than ``width`` is one shingle; one without words, or
    null, has fingerprint 0. A-Z are lower-cased, words are parted by ASCII white
    space, shingles are hashed with XXH64 (UTF-8, seed 42), repeats count.
    """
    kept = without(df, out)
    fields = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(out, T.LongType())])

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(text).cast(pa.binary()).to_pylist()
                prints = pa.array([fingerprint_of(t or b"", width) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], prints], schema.names)

    return kept.mapInArrow(work, schema)


def _flips(value: Column, bits: int) -> Column:
    """The value and those that differ from it in one of the low ``bits`` bits."""
    return F.concat(F.array(value), F.transform(F.lit([1 << i if i < 63 else -(1 << 63) for i in range(bits)]).cast("array<long>"), lambda b: value.bitwiseXOR(b)))


def _segments(fp: Column) -> list[Column]:
    low = F.lit((1 << SEGMENT) - 1)
    return [fp.bitwiseAND(low), F.shiftrightunsigned(fp, SEGMENT).bitwiseAND(low)]


def links(prints: DataFrame, fp: str = "fp", bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that differ in 2 bits or fewer.

    ``prints`` holds distinct, non-null fingerprints. Pairs of table entries that
    hold ``bucket`` fingerprints or fewer all come out; of larger ones, edges that
    connect the same fingerprints.
    """
    f = F.col(fp)
    both = list(enumerate(_segments(f)))

    def keyed(n: int):
        return lambda v: F.struct(F.lit(n).alias("seg"), v.alias("value"))

    index = prints.select(F.explode(F.array(*[F.struct(F.lit(n).alias("seg"), s.alias("value")) for n, s in both])).alias("key"), f.alias("b")).select("key.*", "b")
    probes = prints.select(
        F.explode(F.concat(*[F.transform(_flips(s, SEGMENT), keyed(n)) for n, s in both])).alias("key"),
        f.alias("a"),
    ).select("key.*", "a")
    large = cut(index.groupBy("seg", "value").count().where(F.col("count") > bucket).select("seg", "value"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    paired = (
        probes.join(index.join(large, ["seg", "value"], "left_anti"), ["seg", "value"])
        .where((F.col("a") < F.col("b")) & near)
        .select("a", "b")
    )
    around = probes.join(large, ["seg", "value"], "left_semi").select("a").distinct()
    middles = around.select("a", F.explode(_flips(F.col("a"), 64)).alias("middle"))
    # a value has at most 65 fingerprints around it
    stars = middles.groupBy("middle").agg(F.collect_list("a").alias("members")).where(F.size("members") > 1)
    starred = stars.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a < b")
    return paired.unionByName(starred).distinct()


def near_duplicates(prints: DataFrame, doc: str = "doc_id", fp: str = "fp") -> DataFrame:
    """Each row's component: ``prints`` (doc, fp) with component_id, the smallest doc id reachable.

    A row with a null fingerprint reaches only itself; null doc ids count only
    where a component has no others. Repeated rows stay repeated.
    """
    rows = cut(without(prints, "component_id"))
    firsts = cut(rows.where(F.col(fp).isNotNull()).groupBy(fp).agg(F.min(doc).alias("first")))
    edges = cut(links(firsts.select(fp), fp))
    labels = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = firsts.join(labels.withColumnRenamed("node", fp), fp, "left").withColumn("label", F.coalesce("label", fp))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = cut(named.select(fp, "label").join(least, "label").select(fp, "component_id"))
    # the last step: one join that Spark can split where a fingerprint holds many rows
    joined = rows.join(classes, fp, "left")
    own = F.when(F.col(fp).isNull(), F.col(doc)).otherwise(F.col("component_id"))
    return joined.withColumn("component_id", own)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
