"""Ranked lexical search, a term at a time with limited accumulators.

Queries come in blocks of a fixed number, so what a task holds of them is bounded.
For a block, one pass over the whole texts keeps, per document, its length and the
block's terms with their frequencies. A second pass takes the documents in shards of
a task's batches: postings by term, and per query an accumulator for each document
that some term has created. Terms go from the rarest to the most frequent. Before
each term the bounds of it and of all later ones (the largest contributions in the
shard) are added up: that is all a document without an accumulator can still get.
Once it is less than the kth score so far, be it partial or that of an earlier shard
of the task, no accumulators are created any more; those that exist are kept up to
the last term, so their scores are exact. A task hands on k documents a query.

All scores are whole numbers, so no order of additions matters and ties are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallframe.llm.shard import number_rows
from recallframe.session import scratch, stored

#: Queries of a block.
BLOCK = 1024
#: Documents whose terms are counted at once, and documents of a shard.
SLICE, SHARD = 512, 8192
#: Terms are runs of ASCII letters and digits and of anything that isn't ASCII; A-Z count as a-z.
_ASCII = bytes(range(128))
TERMS = bytes.maketrans(_ASCII, bytes(b if chr(b).isalnum() else 0x20 for b in _ASCII.lower()))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a whole text in order, repeats included; null has none."""
    return (text or b"").translate(TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def contributions(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What each posting adds to its document's score; 64-bit whole numbers."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def term_frequencies(docs: DataFrame, doc: str, text: str, asked: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, tfs): a document's number of terms, and the ``asked`` ones among them by number with their frequencies."""
    id_type = docs.schema[doc].dataType
    schema = T.StructType([T.StructField("doc", id_type), T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "tfs")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(asked) + 1
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lengths, found, sizes = [], [], []
                for t in part.column(1).cast(pa.binary()).to_pylist():
                    words = terms_of(t)
                    known = [asked[w] for w in words if w in asked]
                    lengths.append(len(words))
                    found += known
                    sizes.append(len(known))
                row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
                keys, tf = np.unique(row * width + np.array(found, np.int64), return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(len(sizes) + 1, dtype=np.int64) * width), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (keys % width, tf)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    return docs.select(F.col(doc).alias("doc"), F.col(text).cast("binary").alias("text")).mapInArrow(work, schema)


class Shard:
    """Postings of a batch of documents by term, with each term's largest contribution."""

    def __init__(self, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.size = len(n)
        m = 10 + (90 * n * n_docs) // max(n_terms, 1)
        row = np.repeat(np.arange(self.size), np.diff(offsets))
        parts = contributions(weights[terms], tf.astype(np.int64), m[row])
        order = np.argsort(terms, kind="stable")
        self.rows, self.parts = row[order], parts[order]
        known, starts = np.unique(terms[order], return_index=True)
        ends = [*starts[1:].tolist(), len(order)]
        largest = np.maximum.reduceat(self.parts, starts) if len(starts) else self.parts
        self.postings = {t: (a, b, u) for t, a, b, u in zip(known.tolist(), starts.tolist(), ends, largest.tolist(), strict=True) if u > 0}

    def search(self, terms: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all documents that may be among the ``k`` best and reach ``least``, their scores exact. ``terms`` come rarest first."""
        lists = [self.postings[t] for t in terms if t in self.postings]
        left = sum(u for _, _, u in lists)
        scores, has = np.zeros(self.size, np.int64), np.zeros(self.size, bool)
        creating, spent = True, 0
        for a, b, most in lists:
            if creating and (left < least or left < spent and left < self._kth(scores, has, k)):
                creating = False
                if not has.any():
                    break
            rows, parts = self.rows[a:b], self.parts[a:b]
            if creating:
                has[rows] = True
            else:
                kept = has[rows]
                rows, parts = rows[kept], parts[kept]
            scores[rows] += parts  # a document is once in a term's postings
            left, spent = left - most, spent + most
        rows = np.flatnonzero(has & (scores >= least))
        return rows, scores[rows]

    @staticmethod
    def _kth(scores: np.ndarray, has: np.ndarray, k: int) -> int:
        """The kth largest score so far, 0 if there are fewer."""
        own = scores[has]
        return int(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else 0


def _best(asked: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Task: the k best documents of its rows for each query, as (query, doc, score)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pa.Table | None] = [None] * len(asked)
        least = [1] * len(asked)
        schema = None
        for batch in batches:
            schema = pa.schema([("query", pa.int32()), ("doc", batch.schema.field("doc").type), ("score", pa.int64())])
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                terms, tfs = part.column("terms"), part.column("tfs")
                offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False)))).astype(np.int64)
                shard = Shard(part.column("n").to_numpy(), offsets, terms.flatten().to_numpy(), tfs.flatten().to_numpy(), weights, n_docs, n_terms)
                for q, own in enumerate(asked):
                    rows, scores = shard.search(own, k, least[q])
                    if not len(rows):
                        continue
                    if len(rows) > k:  # all that tie with the kth stay, as documents decide
                        enough = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
                        rows, scores = rows[enough], scores[enough]
                    found = pa.table([pa.array(np.full(len(rows), q, np.int32)), part.column("doc").take(pa.array(rows)), pa.array(scores)], schema=schema)
                    both = pa.concat_tables([best[q], found]) if best[q] is not None else found
                    best[q] = both.take(pc.sort_indices(both, [("score", "descending"), ("doc", "ascending")]).slice(0, k))
                    if len(best[q]) == k:
                        least[q] = best[q].column("score")[k - 1].as_py()
        if found := [b for b in best if b is not None]:
            yield from pa.concat_tables(found).combine_chunks().to_batches()

    return work


def search(docs: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id", text: str = "text", query: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query, rank int, doc, score long): the ``k`` best documents of each row of ``queries``.

    Scores are above 0; equal ones go by ascending doc, nulls last. Null and empty
    texts have no terms: such documents count for nothing and such queries find
    nothing. Rows of ``docs`` that share an id are documents of their own, and so
    are repeated rows; rows of ``queries`` that share an id are queries of their
    own, each with ranks from 1. Extra columns are ignored.
    """
    spark = docs.sparkSession
    out = None
    with scratch(spark):
        numbered, total = number_rows(queries.select(F.col(query).alias("__q"), F.col(query_text).alias("__t")), ["__q", "__t"], "__n")
        for first in range(0, max(total, 1), BLOCK):
            block = numbered.where(F.col("__n").between(first, first + BLOCK - 1)).orderBy("__n").select("__q", F.col("__t").cast("binary")).collect()
            texts = [set(terms_of(bytes(r[1] or b""))) for r in block]
            asked = {t: i for i, t in enumerate(sorted(set().union(*texts)))}
            held = stored(term_frequencies(docs, doc, text, asked))
            n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
            df = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row for each asked term at most
            weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(asked))], np.int64)
            rarest = [sorted((asked[t] for t in own), key=lambda i: (df.get(i, 0), i)) for own in texts]
            fields = [T.StructField("query", T.IntegerType()), T.StructField("doc", docs.schema[doc].dataType), T.StructField("score", T.LongType())]
            found = held.where(F.size("terms") > 0).mapInArrow(_best(rarest, weights, n_docs, n_terms, k), T.StructType(fields))
            order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
            top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            names = numbered.select("__q", (F.col("__n") - first).cast("int").alias("query"))
            rows = stored(top.join(names, "query").select(F.col("__q").alias(query), "rank", F.col("doc").alias(doc), "score"), keep=True)
            out = rows if out is None else out.unionByName(rows)
    return out


#: The same for 10 documents of each row of view benchmark, over view documents, in DuckDB SQL.
ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), asked AS (
  SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS q, * FROM benchmark)
), size AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM t
), tf AS (
  SELECT r, doc_id, len(terms) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, terms, unnest(terms) AS term FROM t) SEMI JOIN asked USING (term) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, size GROUP BY term, n_docs
), scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term), size GROUP BY q, item_id, r, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
