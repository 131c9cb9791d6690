"""What the training-data operators share: tables, the shared folder, hashing and the block/bucket exchange of key counts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a single-process session (local[...], as in tests) gets a folder of its own; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: the lineage ends here and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that written() made and nothing will read again."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scan_parts(df: DataFrame) -> int:
    """Number of partitions of a scan; grows with the input."""
    return max(1, df.rdd.getNumPartitions())


def crc_mod(col: str, n: int) -> Column:
    """crc32(col as text) mod n; null where the column is null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def map_arrow(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply fn to the columns of small slices of each batch: memory stays bounded by a slice, also with very long texts."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                cols = fn(batch.slice(i, 256).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `most` bytes of a text or binary column, or of one longer row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, i = np.cumsum(size), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def given_back() -> None:
    """Return freed memory of this Python worker to the system: workers live on between tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


# --- words and hashes -------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) on uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.arange(256)
#: A 64-bit number for each byte, alike for A-Z and a-z.
BYTE_KEY = mix(np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint64) + np.uint64(1000))
BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 18
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 modulo 2^64, and those of its inverse."""
    if n > SEGMENT or "up" not in _powers:
        up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, SEGMENT) - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
        if n > SEGMENT:
            return up, down
        _powers["up"], _powers["down"] = up, down
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, key: np.ndarray = BYTE_KEY) -> np.ndarray:
    """64-bit hashes of the byte spans [start, stop) of data; the spans are in order and don't overlap.

    Differences of one running sum of key times power, shifted to power 0: equal bytes give equal hashes wherever they stand.
    """
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + SEGMENT, "right")))
        a, b = int(start[i]), int(stop[j - 1])
        up, down = powers(b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(key.take(data[a:b]) * up[: b - a], out=total[1:])
        out[i:j] = (total[stop[i:j] - a] - total[start[i:j] - a]) * down[start[i:j] - a]
        i = j
    return mix(out)


def joined(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A text or binary column as one array of bytes and the bounds of its rows in it; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, number in each row) of the words [^\\x20\\x09-\\x0D]+ of joined rows."""
    word = (data != 32) & (data - np.uint8(9) > 4)  # not one of \x20 and \x09-\x0D; below 9 wraps around
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner], last[inner - 1] = word[inner], word[inner - 1]  # a row's end is a word's end
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, bounds))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, lower-cased A-Z only; number of words in each row) of joined rows."""
    start, stop, n = word_spans(data, bounds)
    return span_hashes(data, start, stop), n


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n in a row of h, put together from runs of 1, 2, 4, ..."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, done, of, p = np.zeros(len(h) - n + 1, np.uint64), 0, 1, RUN
    while of <= n:
        if n & of:
            out = out * p + h[done : done + len(out)]
            done += of
        if 2 * of <= n:
            h = h[:-of] * p + h[of:]
        of, p = 2 * of, np.uint64(int(p) ** 2 & (1 << 64) - 1)
    return mix(out)


#: Multiplier of hashes in a row.
RUN = np.uint64(0x100000001B3)


def squeezed(docs: DataFrame) -> DataFrame:
    """The same columns with text as zstd-compressed UTF-8, which is a third less to shuffle than what Spark compresses; null is empty."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], text, *part.columns[at + 1 :]], names=part.schema.names)

    return docs.mapInArrow(run, StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in docs.schema]))


def expanded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Compressed texts as joined rows."""
    z = zstandard.ZstdDecompressor()
    raw = [z.decompress(t) for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


# --- the exchange: blocks of documents send sorted distinct keys to buckets, buckets answer in the same order -----------


def pack_u64(x: np.ndarray) -> bytes:
    """Sorted uint64 as byte planes of differences, entropy-coded: the high planes are nearly empty."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_u64(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_ints(x: np.ndarray) -> bytes:
    """int64 as byte planes."""
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_ints(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def pack_narrow(x: np.ndarray) -> bytes:
    """Counts as the byte planes that the greatest one needs."""
    width = max(1, int(x.max(initial=0)).bit_length() + 7 >> 3)
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() if len(x) else b""


def unpack_narrow(b: bytes, n: int) -> np.ndarray:
    """The n counts of pack_narrow."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(b, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view(np.int64).ravel()


def pack_counts(x: np.ndarray) -> bytes:
    """int64 counts, mostly small: byte planes, entropy-coded."""
    return zstandard.ZstdCompressor(level=1).compress(pack_ints(x))


def unpack_counts(b: bytes) -> np.ndarray:
    return unpack_ints(zstandard.ZstdDecompressor().decompress(b))


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Start of each bucket in sorted uint64 keys: buckets are equal ranges of the key space."""
    edges = (np.arange(buckets + 1, dtype=np.float64) * (2.0**64 / buckets)).clip(0, 2.0**64 - 2048).astype(np.uint64)
    cuts = np.searchsorted(keys, edges)
    cuts[0], cuts[-1] = 0, len(keys)
    return cuts
