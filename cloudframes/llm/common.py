"""What the operators share: reading, shared scratch tables, and text columns as flat byte arrays."""

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once; documents longer than this come alone.
TILE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='cloudframes-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder, which a lost executor doesn't take along.

    The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.parquet(path)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of an Arrow string column: all UTF-8 bytes in a row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def tiles(offsets: np.ndarray, most: int = TILE_BYTES):
    """Row ranges (i, j) of at most so many bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_tiles(column, most: int = TILE_BYTES):
    """(i, j, data, offsets) for each tile of a string column."""
    data, offsets = text_bytes(column)
    for i, j in tiles(offsets, most):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    """doc_id as int64; a null id becomes the least long, and is null again in results."""
    return np.asarray(pc.fill_null(batch.column("doc_id").cast(pa.int64()), -(1 << 63)))


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


#: Rows of an Arrow batch between Spark and Python, in place of Spark's 10,000, for rows are whole texts.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt, libc.malloc_trim  # noqa: B018
    except (OSError, AttributeError):  # another C library: its allocator is left alone
        return None
    return libc


def frugal(f):
    """f for a task, with large arrays given back to the system at once, and the rest at the task's end, for Spark keeps its workers."""

    def begin():
        libc = _libc()
        if libc is not None:
            libc.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD
        return libc

    def end(libc):
        pa.default_memory_pool().release_unused()
        if libc is not None:
            libc.malloc_trim(0)

    @functools.wraps(f)
    def over(batches):
        libc = begin()
        if isinstance(batches, pa.Table):
            out = f(batches)
            end(libc)
            return out
        return stream(batches, libc)

    def stream(batches, libc):
        try:
            yield from f(batches)
        finally:
            end(libc)

    return over


def small(rows: DataFrame, most: int) -> DataFrame:
    """A written table, to be broadcast if its counted rows are within a bound; else Spark shuffles both sides."""
    return F.broadcast(rows) if rows.count() <= most else rows


def doc_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read; all others, whatever their names, stay out of the way.

    Batches to Python are made smaller for the session, unless it asks for less already, so that memory stays bounded.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_BASE = 0x9E3779B97F4A7C15
def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads differences over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document rows of the words [^\\x20\\x09-\\x0D]+ of a tile."""
    inside = np.ones(len(data) + 1, bool)
    inside[:-1] = (data != 32) & ((data < 9) | (data > 13))
    inside[-1] = False
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(numbers, values): disjoint ascending ranges of bytes as numbers of distinct values, compared byte by byte and not by codes."""
    if not len(starts):
        return np.zeros(0, np.int32), pa.array([], pa.large_binary())
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    found = array.dictionary_encode()
    return np.asarray(found.indices), found.dictionary


#: The bits of codes that are used; exact results are the same with any, only slower.
CODE = np.uint64(0xFFFFFFFFFFFFFFFF)


def equal_rows(columns: list[np.ndarray], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): an order in which equal rows of some columns of integers are neighbours, and whether each row there equals the one before.

    Rows are ordered by a code; if one code has unequal rows, by the columns behind it too. So codes only speed this up.
    """
    order = np.argsort(code, kind="stable")

    def equal(of: np.ndarray) -> np.ndarray:
        out = np.zeros(len(order), bool)
        x = of[order]
        out[1:] = x[1:] == x[:-1]
        return out

    coded, same = equal(code), np.ones(len(order), bool)
    for c in columns:
        same &= equal(c)
    if (coded & ~same).any():
        order = np.lexsort([*columns[::-1], code])
        same = np.logical_and.reduce([equal(c) for c in columns])
    return order, same


#: Ranges over so many bytes get their code from a library call each.
LONG_RANGE = 2048


def range_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit codes of ranges of bytes: eight bytes at a time are mixed into a state, for all ranges at once.

    Mixing isn't linear, so no family of strings collides by its structure; still, equal codes are no proof of equal bytes.
    """
    left = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mixed(left.astype(np.uint64) + np.uint64(_BASE))
    for k in np.flatnonzero(left > LONG_RANGE).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    live = np.flatnonzero((left > 0) & (left <= LONG_RANGE))
    at, left, h = starts[live], left[live], out[live]
    while len(live):
        x = eights[at]
        short = left < 8
        x[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h = mixed((h ^ x) * np.uint64(0xA0761D6478BD642F) + np.uint64(0xE7037ED1A0B428DB))
        more = left > 8
        out[live[~more]] = h[~more]
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    return out


def per_doc(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    out = np.bincount(rows, weights, n)
    return out if weights is None else np.rint(out).astype(np.int64)
