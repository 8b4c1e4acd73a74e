"""Sharding by a Feistel permutation over global row numbers.

Rows get the numbers 0..N-1 in the order of key columns; a keyed Feistel network
permutes these numbers, and the permuted number p alone says where a row goes:
shard p mod n, slot p div n. So shard sizes differ by one row at most, slots have
no gaps, and anyone with (N, n, seed) can compute a row's place or, by the inverse
network, the row of a place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallframe.session import cut, without

#: Round keys come from this generator; the numbers stay below 2**62 all along, so that SQL can compute them in BIGINT.
PRIME, STEP, ADD, ROUNDS = 2_147_483_647, 48_271, 1_013_904_223, 6


def round_keys(seed: int) -> list[int]:
    keys, x = [], (seed * STEP + ADD) % PRIME
    for _ in range(ROUNDS):
        x = (x * STEP + ADD) % PRIME
        keys.append(x)
    return keys


def half_bits(n_rows: int) -> int:
    """Bits of one half: the network permutes 0 .. 4**half_bits - 1, at least n_rows numbers."""
    return max(1, (max(1, n_rows - 1).bit_length() + 1) // 2)


def _mix(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = ((x + key) * STEP + ADD) % PRIME
    x = ((x ^ (x >> 15)) * STEP + key) % PRIME
    return (x ^ (x >> 13)) & mask


def _network(x: np.ndarray, half: int, keys: list[int], inverse: bool) -> np.ndarray:
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    if inverse:
        for key in reversed(keys):
            left, right = right ^ _mix(left, key, mask), left
    else:
        for key in keys:
            left, right = right, left ^ _mix(right, key, mask)
    return (left << half) | right


def permute(numbers: np.ndarray, n_rows: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n_rows-1; numbers that leave the range walk on along their cycle."""
    half, keys = half_bits(n_rows), round_keys(seed)
    out = _network(np.asarray(numbers, np.int64), half, keys, inverse)
    while (away := out >= n_rows).any():
        out[away] = _network(out[away], half, keys, inverse)
    return out


def number_rows(df: DataFrame, order: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with dense numbers 0..N-1 in the order of ``order`` (nulls first), and N.

    Rows equal in ``order`` get neighbouring numbers in some order. A row's
    partition and its place there come from one global sort, kept in the shared
    folder; the only thing gathered is one count per sorted partition. The sort
    goes by the task's row id last, so a key that holds any share of the rows is
    still dealt over many partitions. Pass narrow columns; join payload later.
    """
    kept = without(df, number)
    salted = kept.withColumn("__tie", F.monotonically_increasing_id())
    ordered = cut(salted.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie"))
    return dense(ordered.withColumn("__place", F.monotonically_increasing_id()), number)


def dense(placed: DataFrame, number: str) -> tuple[DataFrame, int]:
    """``placed`` with numbers 0..N-1 for its stored ``__place``, made by ``monotonically_increasing_id``, and N."""
    counts = placed.groupBy(F.shiftrightunsigned("__place", 33).alias("part")).count().orderBy("part").collect()
    starts, total = {}, 0
    for part, n in counts:
        starts[part] = total
        total += n
    last = max(starts, default=-1)
    first = F.array(*[F.lit(starts.get(p, 0)).cast("long") for p in range(last + 1)]) if starts else F.array(F.lit(0).cast("long"))
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    row = F.element_at(first, (F.shiftrightunsigned("__place", 33) + 1).cast("int")) + inside
    return placed.withColumn(number, row).drop("__place"), total


def assign(df: DataFrame, order: list[str], n_shards: int, seed: int = 1) -> DataFrame:
    """``df`` with shard (int) and slot (long).

    Law ``rows``: shard sizes differ by one at most; slots are gapless from 0 in
    each shard. Nulls in ``order`` sort first, ties and repeated rows get places
    of their own, an empty table stays empty. Input columns named shard or slot
    are replaced. The same rows, order and seed give the same places, up to the
    exchange of rows that are equal in ``order``.
    """
    numbered, total = number_rows(without(df, "shard", "slot"), order, "__row")

    @F.pandas_udf("long")
    def permuted(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), total, seed))

    return (
        numbered.withColumn("__p", permuted("__row"))
        .withColumn("shard", F.pmod("__p", F.lit(n_shards)).cast("int"))
        .withColumn("slot", F.floor(F.col("__p") / n_shards).cast("long"))
        .drop("__row", "__p")
    )


def oracle(n_shards: int, seed: int) -> str:
    """The same places of table documents in DuckDB SQL, CRC-32 and cycle walking included."""
    mix = lambda x, key: (
        f"(WITH a AS (SELECT (({x} + {key}) * {STEP} + {ADD}) % {PRIME} AS v), b AS (SELECT (xor(v, v >> 15) * {STEP} + {key}) % {PRIME} AS v FROM a) SELECT xor(v, v >> 13) & mask FROM b)"
    )
    step = "SELECT r, p >> half AS l0, p & mask AS r0, half, mask, n FROM {0}"
    for i, key in enumerate(round_keys(seed)):
        step = f"SELECT r, r{i} AS l{i + 1}, xor(l{i}, {mix(f'r{i}', key)}) AS r{i + 1}, half, mask, n FROM ({step})"
    step = f"SELECT r, (l{ROUNDS} << half) | r{ROUNDS} AS p, half, mask, n FROM ({step})"
    crc = "xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc} AS text_crc32 FROM documents, crc_table
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS r FROM sized
), width AS (
  SELECT n, half, (1::BIGINT << half) - 1 AS mask FROM (SELECT count(*) AS n, (SELECT min(h) FROM range(1, 31) x(h) WHERE pow(4, h) >= (SELECT count(*) FROM documents)) AS half FROM documents)
), walk AS (
  {step.format("(SELECT r, r AS p, half, mask, n FROM numbered, width)")}
  UNION ALL
  {step.format("(SELECT * FROM walk WHERE p >= n)")}
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(p % {n_shards} AS INT) AS shard, CAST(p // {n_shards} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM numbered JOIN walk USING (r) WHERE p < n"""
