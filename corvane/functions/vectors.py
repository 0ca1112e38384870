"""Vector functions on array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

ROWS_AT_ONCE = 4096  # vectors of one matrix product


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def best_dots(vec: Column, banks: list[np.ndarray]) -> Column:
    """Array of the largest dot product with the rows of each bank, null for an empty one and for a vector that is null, has a null or another length.

    One matrix product an Arrow batch; the banks (a bounded number of prompts) go along with the function.
    """
    banks = [np.asarray(b, dtype=np.float64) for b in banks]
    dim = next((b.shape[1] for b in banks if len(b)), 0)

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(v: pa.Array) -> pa.Array:
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        lengths = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
        flat = v.flatten().cast(pa.float64())
        whole = np.ones(len(v), dtype=bool)
        if flat.null_count:
            owner = np.repeat(np.arange(len(v)), np.maximum(lengths, 0))
            whole[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = False
        values = flat.to_numpy(zero_copy_only=False)
        fit = (lengths == dim) & whole & (dim > 0)
        x = values[np.repeat(fit, np.maximum(lengths, 0))].reshape(-1, dim) if dim else np.zeros((0, 0))
        out = np.full((len(v), len(banks)), np.nan)
        for k, b in enumerate(banks):
            for at in range(0, len(x) if len(b) else 0, ROWS_AT_ONCE):
                out[np.flatnonzero(fit)[at : at + ROWS_AT_ONCE], k] = (x[at : at + ROWS_AT_ONCE] @ b.T).max(axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(banks), pa.int32()), pa.array(out.ravel(), mask=np.isnan(out.ravel())))

    return run(vec)


def best_dot(vec: Column, bank: list[list[float]]) -> Column:
    """Largest dot product with the vectors of a bank."""
    return best_dots(vec, [np.array(bank)])[0]
