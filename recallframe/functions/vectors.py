"""Vector expressions: validity, cosine, fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_valid(vector: Column, dimension: int) -> Column:
    """Right length, finite throughout, and not all zero."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0)


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


@F.pandas_udf(T.DoubleType())
def cosine_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same as ``cosine`` over Arrow batches."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = np.stack(a.to_numpy()).astype(np.float64), np.stack(b.to_numpy()).astype(np.float64)
    return pd.Series(np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)))


def cosines(a: list, b: list) -> np.ndarray:
    """The cosine of each of ``a`` with each of ``b``, NaN where one is missing or their lengths differ.

    Sums go dimension by dimension, as in ``cosine``, so equal vectors have equal scores wherever they stand.
    """
    out = np.full((len(a), len(b)), np.nan)
    by_size = [{n: [i for i, v in enumerate(side) if v is not None and len(v) == n] for n in {len(v) for v in side if v is not None}} for side in (a, b)]
    for n in by_size[0].keys() & by_size[1].keys():
        rows, columns = by_size[0][n], by_size[1][n]
        x, y = (np.array([side[i] for i in at], np.float64).reshape(len(at), n) for side, at in ((a, rows), (b, columns)))
        dot, xx, yy = np.zeros((len(rows), len(columns))), np.zeros(len(rows)), np.zeros(len(columns))
        for k in range(n):
            dot += x[:, k, None] * y[None, :, k]
            xx += x[:, k] ** 2
            yy += y[:, k] ** 2
        with np.errstate(invalid="ignore", divide="ignore"):
            out[np.ix_(rows, columns)] = dot / np.sqrt(xx[:, None] * yy[None, :])
    return out


@F.pandas_udf(T.StringType())
def fingerprint(vector: pd.Series) -> pd.Series:
    """SHA-256 of the big-endian float32 bits; -0.0 differs from 0.0."""
    return vector.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, ">f4").tobytes()).hexdigest())
