"""Files of token ids in planes, as a Spark data source: `bitplane`.

A file holds the ids of its documents one after the other, cut into chunks of CHUNK ids. A chunk's ids are transposed into
byte planes (all lowest bytes, all second bytes, ...) or bit planes, and each plane is compressed by zstandard; a plane
of zeros takes a few bytes. After the chunks come the documents (key and number of ids, as an Arrow stream), then the chunk index
(place, ids and plane sizes of each chunk, so any range of ids is read without the rest), then the lengths of both and the mark.

Writing keeps the order of rows and partitions: one file for each partition, written under its attempt's own name and
given its last name when the job commits, together with `_files`, which lists files, documents and ids in order. Reading makes one
partition of each file; a document's start is the sum of the ids of the files before, from `_files`, and of the documents
before it in its file. Paths are those that pyarrow opens: local, HDFS or an object store.

Defined results: a null array of ids is an empty document; keys may be null, repeated or of any type that Arrow holds; a table
without rows is a folder whose `_files` is empty. Memory: one chunk and one document's ids.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the format.
MARK, CHUNK = b"IDPLANE1", 1 << 16
FOOTER = struct.Struct("<QQB8s")
INDEX = struct.Struct("<QI32H")
KINDS = {"byte": 8, "bit": 1}
BATCH_BYTES = 4 << 20


def planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of uint32 ids, lowest first: 4 of 8 bits or 32 of one."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if bits == 8:
        return [r.tobytes() for r in rows]
    return [np.packbits(rows[b // 8] >> np.uint8(b % 8) & 1).tobytes() for b in range(32)]


def from_planes(parts: list[bytes], n: int, bits: int) -> np.ndarray:
    """The n ids of planes()."""
    if bits == 8:
        return np.ascontiguousarray(np.frombuffer(b"".join(parts), np.uint8).reshape(4, n).T).view("<u4").ravel()
    rows = np.zeros((4, n), np.uint8)
    for b, part in enumerate(parts):
        rows[b // 8] |= np.unpackbits(np.frombuffer(part, np.uint8), count=n) << np.uint8(b % 8)
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class PlaneWriter:
    """One file: add() ids of documents in order, close() with their keys."""

    def __init__(self, out, bits: int = 8) -> None:
        self.out, self.bits, self.z = out, bits, zstandard.ZstdCompressor(level=3)
        self.at, self.index, self.rest, self.waiting, self.ids = 0, [], [], 0, 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def chunk(self, ids: np.ndarray) -> None:
        packed = []
        for raw in planes(ids, self.bits):
            small = self.z.compress(raw)
            packed.append(small if len(small) < 1 << 16 else raw)  # of 64 KB then, so its size in the index is 0
        self.index.append(INDEX.pack(self.at, len(ids), *([len(p) & 0xFFFF for p in packed] + [0] * (32 - len(packed)))))
        for p in packed:
            self.put(p)

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= CHUNK:
            every = np.concatenate(self.rest)
            for i in range(0, len(every) - CHUNK + 1, CHUNK):
                self.chunk(every[i : i + CHUNK])
            every = every[len(every) - len(every) % CHUNK :].copy()
            self.rest, self.waiting = [every], len(every)

    def close(self, documents: bytes) -> None:
        if self.waiting:
            self.chunk(np.concatenate(self.rest))
        documents, index = self.z.compress(documents), self.z.compress(b"".join(self.index))
        self.put(documents)
        self.put(index)
        self.put(FOOTER.pack(len(documents), len(index), self.bits, MARK))


class PlaneFile:
    """A file's documents and chunk index; chunks are read when asked for."""

    def __init__(self, source) -> None:
        self.source, self.z = source, zstandard.ZstdDecompressor()
        size = source.size()
        documents, index, self.bits, mark = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if mark != MARK:
            raise ValueError("not a file of id planes")
        end = size - FOOTER.size
        self.index = list(INDEX.iter_unpack(self.z.decompress(self.read(end - index, index))))
        self.documents = pa.ipc.open_stream(self.z.decompress(self.read(end - index - documents, documents))).read_all()

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k]
        each = n if self.bits == 8 else -(-n // 8)
        parts = []
        for size in sizes[: 32 // self.bits]:
            parts.append(self.z.decompress(self.read(at, size)) if size else self.read(at, each))
            at += size or each
        return from_planes(parts, n, self.bits)

    def rows(self) -> Iterator[np.ndarray]:
        """The ids of each document in order."""
        rest, k = np.empty(0, np.uint32), 0
        for n in self.documents.column("n_tokens").to_numpy():
            got, have = [rest], len(rest)
            while have < n:
                got.append(self.chunk(k))
                have += len(got[-1])
                k += 1
            every = np.concatenate(got) if len(got) > 1 else rest
            yield every[:n]
            rest = every[n:]


def opened(path: str):
    """(file system, folder) of a path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    part: int
    temporary: str
    documents: int
    ids: int


class PlaneSink(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.bits, self.overwrite = options["path"], KINDS[options.get("planes", "byte")], overwrite
        self.attempts = f"_attempts-{options.get('job', '0')}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = opened(self.path)
        context = TaskContext.get()
        temporary = f"{folder}/{self.attempts}/{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(f"{folder}/{self.attempts}", recursive=True)
        kept, n_documents = io.BytesIO(), 0
        stream = None
        with store.open_output_stream(temporary) as out:
            file = PlaneWriter(out, self.bits)
            for batch in iterator:
                names = batch.schema.names
                keys, column = batch.column(names.index("doc_id")), batch.column(names.index("ids"))
                sizes = []
                for value in column:
                    ids = np.frombuffer(value.as_buffer() or b"", "<u4") if value.is_valid else np.empty(0, np.uint32)
                    file.add(ids)
                    sizes.append(len(ids))
                told = pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])
                stream = stream or pa.ipc.new_stream(kept, told.schema)
                stream.write_batch(told)
                n_documents += len(sizes)
            if stream is None:
                stream = pa.ipc.new_stream(kept, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))
            stream.close()
            file.close(kept.getvalue())
        return Written(context.partitionId(), temporary, n_documents, file.ids)

    def commit(self, messages: list[Written | None]) -> None:
        """Last names for the files of the attempts that count; whatever other attempts left goes."""
        from pyarrow import fs

        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        before = [f for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File]
        if before and not self.overwrite:
            raise FileExistsError(self.path)
        for f in before:
            store.delete_file(f.path)
        lines = []
        for m in sorted((m for m in messages if m is not None and m.documents), key=lambda m: m.part):
            name = f"part-{m.part:06d}.ids"
            store.move(m.temporary, f"{folder}/{name}")
            lines.append(json.dumps({"file": name, "documents": m.documents, "ids": m.ids}))
        with store.open_output_stream(f"{folder}/_files") as out:
            out.write("".join(x + "\n" for x in lines).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, folder = opened(self.path)
        if store.get_file_info(f"{folder}/{self.attempts}").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/{self.attempts}")


@dataclass
class OneFile(InputPartition):
    file: str
    before: int


class PlaneScan(DataSourceReader):
    def __init__(self, path: str, schema) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[OneFile]:
        """A partition for each file; `_files` is a line for each."""
        store, folder = opened(self.path)
        with store.open_input_stream(f"{folder}/_files") as f:
            lines = [json.loads(x) for x in f.read().decode().splitlines()]
        before = np.cumsum([0, *(x["ids"] for x in lines)], dtype=np.int64).tolist()
        return [OneFile(x["file"], b) for x, b in zip(lines, before)] or [OneFile("", 0)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.file:
            return
        out = to_arrow_schema(self.schema)
        store, folder = opened(self.path)
        with store.open_input_file(f"{folder}/{partition.file}") as source:
            file = PlaneFile(source)
            keys, sizes = file.documents.column("doc_id"), file.documents.column("n_tokens").to_numpy()
            start = partition.before + np.cumsum(sizes) - sizes
            first, held, weight = 0, [], 0
            for i, ids in enumerate(file.rows()):
                held.append(ids.tobytes())
                weight += len(held[-1]) + 64
                if weight >= BATCH_BYTES or i + 1 == len(sizes):
                    n = len(held)
                    columns = {"doc_id": keys.slice(first, n).combine_chunks(), "start": pa.array(start[first : first + n]), "n_tokens": pa.array(sizes[first : first + n]), "ids": pa.array(held, pa.binary())}
                    yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out], schema=out)
                    first, held, weight = first + n, [], 0


class PlaneSource(DataSource):
    """Options: path, planes ("byte", the default, or "bit"), key (type of doc_id, "long" by default)."""

    @classmethod
    def name(cls) -> str:
        return "bitplane"

    def schema(self) -> str:
        return f"doc_id {self.options.get('key', 'long')}, start long, n_tokens long, ids binary"

    def reader(self, schema) -> PlaneScan:
        return PlaneScan(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> PlaneSink:
        return PlaneSink(self.options, overwrite)


def write(ids: DataFrame, path: str, kind: str = "byte") -> None:
    """Write (doc_id, ids), ids little-endian unsigned 32-bit in binary, in the order of rows and partitions."""
    import uuid

    ids.sparkSession.dataSource.register(PlaneSource)
    ids.select("doc_id", "ids").write.format("bitplane").option("planes", kind).option("job", uuid.uuid4().hex).mode("overwrite").save(path)


def read(spark: SparkSession, path: str, key: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents of a folder."""
    spark.dataSource.register(PlaneSource)
    return spark.read.format("bitplane").option("key", key).load(path)


def ordered(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text) in ascending doc_id, null first; rows of one doc_id in the order in which they are read, in as many partitions as they need."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    return rows.repartitionByRange(parts, "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
