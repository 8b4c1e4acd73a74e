"""Quality rules on tokeniser fertility.

A public vocabulary cuts every word of a text; three measures come of that:
characters per token, the share of byte-fallback tokens, and the entropy of the
text's tokens. Bands per language (or any other grouping column) are fences
around the quartiles of all documents that pass the base rules; a document
outside of a band is rejected. The quartiles come from exact histograms of
rounded values, so their size is bounded by the measures' resolution, not by the
rows, and reruns agree.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallframe.llm.text import Memo
from recallframe.session import cut, without

#: Entries that a Python worker keeps of words; bounds its memory.
WORDS_KEPT = 500_000
SLICE = 512
SYMBOLS, GAPS = b"#*$%&|<>", b"\x20\t\n\x0b\x0c\r"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["chars_per_token", "fallback_share", "token_entropy"]
#: Resolution of the histograms, and the least half-width of a band, by measure.
STEP = {"chars_per_token": 0.01, "fallback_share": 0.001, "token_entropy": 0.01}
SLACK = {"chars_per_token": 0.1, "fallback_share": 0.02, "token_entropy": 0.1}
#: Width of a band in interquartile ranges beyond the quartiles. Short texts scatter
#: more: the width grows by sqrt(1 + SHORT / n_words).
FENCE, SHORT = 2.5, 200.0


class Vocabulary:
    """Words to packed token ids by a sentencepiece model; one per Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        fallback = [i for i in range(self.model.get_piece_size()) if self.model.is_byte(i)]
        self.bytes_from, self.bytes_to = min(fallback, default=0), max(fallback, default=-1)
        self.words = Memo(self._word, WORDS_KEPT)

    def _word(self, word: bytes) -> bytes:
        ids = self.model.encode(word.decode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}i", *ids)

    def measures(self, words: list[bytes], word_chars: int) -> tuple[float, float, float]:
        ids = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<i4")
        if not len(ids):
            return 0.0, 0.0, 0.0
        ordered = np.sort(ids)
        edges = np.flatnonzero(np.diff(ordered)) + 1
        counts = np.diff(np.concatenate(([0], edges, [len(ids)])))
        share = counts / len(ids)
        entropy = float(-(share * np.log2(share)).sum()) / np.log2(len(ids) + 1)
        fallback = np.count_nonzero((ids >= self.bytes_from) & (ids <= self.bytes_to))
        return word_chars / len(ids), fallback / len(ids), entropy


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for i in range(width):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29)))
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    often = np.zeros(n, bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + n] |= often
    return int(covered.sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    chars = len(text.translate(None, GAPS).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(GAPS)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def measure(df: DataFrame, text: str, vocabulary_path: str) -> DataFrame:
    """``df`` with the base counts and the three measures instead of its ``text``.

    Null and empty texts have zeros throughout. Input columns named like the
    results are replaced.
    """
    kept = without(df, *BASE, *MEASURES)
    fields = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in BASE], *[T.StructField(c, T.DoubleType()) for c in MEASURES]])

    def work(batches):
        own = vocabulary(vocabulary_path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = []
                for t in part.column(text).cast(pa.binary()).to_pylist():
                    words = (t := t or b"").split()
                    counts = base_counts(t, words)
                    rows.append(counts + own.measures(words, counts[1]))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.float64()] * 3, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], *columns], schema.names)

    return kept.mapInArrow(work, schema)


def bands(measured: DataFrame, group: str) -> DataFrame:
    """(group, measure, low, q1, q3, high) of the rows of ``measured`` that passed the base rules."""
    long = measured.select(
        group,
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) / STEP[m]).cast("long").alias("bin")) for m in MEASURES])).alias("x"),
    ).select(group, "x.*")
    bins = long.groupBy(group, "measure", "bin").count()
    whole = Window.partitionBy(group, "measure")
    upto = whole.orderBy("bin")
    shares = bins.withColumn("upto", F.sum("count").over(upto)).withColumn("all", F.sum("count").over(whole))
    quartiles = shares.groupBy(group, "measure").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("bin"))).alias("q3"),
    )
    step, slack = (F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.lit(d[m]))])[F.col("measure")] for d in (STEP, SLACK))
    q1, q3 = F.col("q1") * step, F.col("q3") * step
    return quartiles.select(group, "measure", q1.alias("q1"), q3.alias("q3"), F.greatest((q3 - q1) * FENCE, slack).alias("width"))


def judge(df: DataFrame, text: str, vocabulary_path: str, group: str) -> DataFrame:
    """``df`` without its text, with base counts, measures, base_failed, kept and reason.

    ``reason`` names the first measure outside of its band, else is null. A null
    group is a group of its own. A group whose rows all fail the base rules has
    no bands. A text that fails the base rules is not kept.
    """
    measured = measure(without(df, "base_failed", "kept", "reason"), text, vocabulary_path)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = cut(measured.withColumn("base_failed", failed))
    long = bands(measured.where("not base_failed"), group)
    band = [F.first(F.when(F.col("measure") == m, F.struct("q1", "q3", "width")), ignorenulls=True).alias(f"__{m}") for m in MEASURES]
    wide = long.groupBy(F.col(group).alias("__group")).agg(*band)
    joined = measured.join(wide, F.col(group).eqNullSafe(F.col("__group")), "left")
    scatter = F.sqrt(1 + F.lit(SHORT) / F.greatest("n_words", F.lit(1)))

    def outside(m: str):
        reach = F.col(f"__{m}.width") * scatter
        return (F.col(m) < F.col(f"__{m}.q1") - reach) | (F.col(m) > F.col(f"__{m}.q3") + reach)

    reason = F.coalesce(*[F.when(outside(m), F.lit(m)) for m in MEASURES])
    judged = joined.withColumn("reason", F.when(~F.col("base_failed"), reason))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("reason").isNull()).drop("__group", *[f"__{m}" for m in MEASURES])
