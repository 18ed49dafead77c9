"""Reading vectors: which rows take part, and one node per distinct vector.

A vector takes part if it and its components are not null, and it is finite and
not zero.  Vectors are compared with those of their own length only, so each
length is a frame of its own, and the operators go through them one by one.
Equal vectors are one node, a 64-bit hash of the components, so thousands of
copies cost one comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: SQL: whether ``embedding`` takes part.
_FINE = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> coalesce(not isnan(x) and abs(x) < double('infinity'), false)) and exists(embedding, x -> x <> 0)"


def node() -> Column:
    """The node of ``embedding``, null where it takes no part (hashes skip null
    components, so others would share theirs)."""
    return F.expr(f"if({_FINE}, xxhash64(embedding), cast(null as bigint))")


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> list[DataFrame]:
    """vec_id, embedding, node of the rows that take part, by length (one frame
    without rows, if none do)."""
    src = df.select(df[id_col].cast("long").alias("vec_id"), df[vec_col].alias("embedding"))
    src = src.where(_FINE)
    lengths = [r["d"] for r in src.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    return [src.where(F.size("embedding") == d).withColumn("node", node()) for d in lengths or [0]]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, in a fixed order
    of summation."""
    with np.errstate(over="ignore", invalid="ignore"):
        c = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    return np.where(np.isfinite(c), c, (unit(a) * unit(b)).sum(axis=1))
