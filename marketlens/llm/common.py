"""Helpers shared by the operators: table reading, lineage cuts, row keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import apply_defaults, remove_scratch_path, scratch_path

#: Bytes of text that a task turns into numpy arrays at a time.
BLOCK_BYTES = 1 << 20
#: Most bits of a bit table; beyond a sixteenth of it in entries it lets more
#: rows pass, which an exact join then drops.
TABLE_BITS = 1 << 26


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    apply_defaults(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: Set where unset: what passes between a task and its Python worker at a time.
#: Texts are long, and both sides hold a batch or two.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}


def prepared(df: DataFrame) -> SparkSession:
    """The frame's session, with this package on the executors' path and unset
    settings filled in."""
    spark = df.sparkSession
    apply_defaults(spark)
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the cluster's shared checkpoint folder and read it
    back: later steps neither recompute it nor depend on executors that hold
    its shuffle files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these frames, once what follows from
    them is written, and let Spark clean up the shuffles of frames that are gone."""
    for df in frames:
        remove_scratch_path(df.sparkSession, df._scratch_path)
    frames[0].sparkSession.sparkContext._jvm.System.gc()


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits that are equal for identical rows (id and text, nulls told
    apart from empty values).  Rows that agree in both get the same results,
    so results can be joined back on it without numbering rows."""
    d, t = F.col(doc_id).cast("string"), F.col(text)
    return F.xxhash64(F.coalesce(d, F.lit("\x00")), d.isNull(), F.coalesce(t, F.lit("")), t.isNull())


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, out of the way of other names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_order(df: DataFrame) -> Column:
    """64 bits of all columns (but maps): tells rows apart that agree in id and
    text, so the choice of one is the same in every run."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() != "map"])


def bit_table(df: DataFrame, column: str) -> np.ndarray:
    """A table of 2^k bits, as 64-bit words, with a bit for every value of a
    long column: a filter without false negatives.  Sixteen bits a row, at most
    TABLE_BITS, so its words fit the driver and a broadcast at any scale."""
    bits = 1 << int(np.clip(np.ceil(np.log2(max(df.count(), 1) * 16)), 10, np.log2(TABLE_BITS)))
    words = df.selectExpr(f"cast(pmod({column}, {bits}L) div 64 as int) as w", f"shiftleft(1L, cast(pmod({column}, 64) as int)) as v")
    found = words.groupBy("w").agg(F.expr("bit_or(v)").alias("v")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found["w"].to_numpy()] = found["v"].to_numpy()
    return table.view(np.uint64)


def has_bit(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values have their bit set."""
    p = x & np.uint64(len(table) * 64 - 1)
    return ((table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its row offsets (n + 1);
    a null row is empty.  No copy when the column has no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], (off - off[0]).astype(np.int64)


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose text together stays within ``limit`` bytes (a longer
    text is a range of its own)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def arrow_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that hold rows.  What Arrow has freed goes back to the system
    at the end of a task: its worker lives on beside others."""
    for b in batches:
        if b.num_rows:
            yield b
    pa.default_memory_pool().release_unused()
