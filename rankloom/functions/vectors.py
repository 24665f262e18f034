"""Products of vector columns, in Arrow batches with numpy.

An array lambda in Spark works number by number outside generated code; a
batch function multiplies whole columns at once, on the columns' own buffers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matrix(col: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, all of one length, as a matrix."""
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def as_lists(m: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m, dtype=np.float64).ravel()))


@F.arrow_udf(T.DoubleType())
def dot(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sum of element-wise products in DOUBLE; NULL where a side is NULL."""
    ok = pc.and_(a.is_valid(), b.is_valid())
    at = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
    out = np.zeros(len(a))
    if len(at):
        out[at] = np.einsum("ij,ij->i", matrix(a.filter(ok)), matrix(b.filter(ok)))
    return pa.array(out, mask=~ok.to_numpy(zero_copy_only=False))


def _nested(v) -> np.ndarray | None:
    """A row's vectors as a matrix, None without any."""
    if not v.is_valid or not len(v.values):
        return None
    return matrix(v.values)


@F.arrow_udf(T.DoubleType())
def maxsim(q: pa.Array, d: pa.Array) -> pa.Array:
    """Sum over the vectors of ``q`` of the largest product with a vector of ``d``; NULL without vectors."""
    out = []
    for x, y in zip(q, d, strict=True):
        x, y = _nested(x), _nested(y)
        out.append(None if x is None or y is None else float((x @ y.T).max(axis=1).sum()))
    return pa.array(out, pa.float64())


@F.arrow_udf(T.DoubleType())
def weighted_maxsim(q: pa.Array, w: pa.Array, d: pa.Array) -> pa.Array:
    """As ``maxsim`` with a weight for each vector of ``q``."""
    out = []
    for x, k, y in zip(q, w, d, strict=True):
        x, y = _nested(x), _nested(y)
        weights = np.asarray(k.values, dtype=np.float64) if k.is_valid else None
        out.append(None if x is None or y is None or weights is None else float((x @ y.T).max(axis=1) @ weights))
    return pa.array(out, pa.float64())
