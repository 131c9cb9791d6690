"""Packed files as a Spark data source: blocks of BGZF are split over partitions, other layers are inflated as a stream.

A BGZF file is a row of small gzip members that tell their own size, so a range of its bytes begins at the first place from which
such members follow each other. A partition owns the members that start in its range. Lines: all partitions but a file's first leave
out what stands before their first line end, and every partition reads on to the first line end after its members, so each
line is read once, wherever it is cut. Other packed files (one long gzip member, zip, layers in layers) have no place to begin in
the middle: they are one partition, inflated piece by piece in bounded memory.

Paths are those that pyarrow opens (local, HDFS, object stores).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_LAYERS = 10
#: Bytes that are read, inflated or given out at once.
PIECE = 1 << 20
#: Fixed values of the formats: gzip and zip marks, the longest BGZF member, its header with the extra field BC.
GZIP, ZIP, LONGEST_MEMBER = b"\x1f\x8b", b"PK\x03\x04", 1 << 16


def opened(path: str):
    """(file system, path in it) of a path, wherever pyarrow can open it."""
    from pyarrow import fs

    if "://" not in path:
        path = f"file://{path.removeprefix('file:')}"
    return fs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether tasks can open a path by themselves; stores that only Hadoop knows are left to Spark's readers."""
    try:
        store, at = opened(path)
        return store.get_file_info(at).is_file
    except (pa.ArrowInvalid, OSError):
        return False


# --- BGZF ---------------------------------------------------------------------------------------------------------------


def member_size(data: bytes, at: int = 0) -> int | None:
    """Size of the BGZF member at a place, None where there is none or its header is cut."""
    if len(data) < at + 18 or data[at : at + 4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", data, at + 10)[0]
    i, end = at + 12, at + 12 + extra
    while i + 4 <= min(end, len(data)):
        name, n = data[i : i + 2], struct.unpack_from("<H", data, i + 2)[0]
        if name == b"BC" and n == 2 and i + 6 <= len(data):
            return struct.unpack_from("<H", data, i + 4)[0] + 1
        i += 4 + n
    return None


def first_member(source, start: int, size: int) -> int:
    """The first place from `start` on at which members follow each other: three, or as many as there are to the file's end."""
    source.seek(start)
    data = source.read(min(4 * LONGEST_MEMBER + 64, size - start))
    at = 0
    while (at := data.find(GZIP, at)) >= 0:
        to, told = at, 0
        while told < 3 and (n := member_size(data, to)):
            to, told = to + n, told + 1
        if told and (told == 3 or start + to == size):
            return start + at
        at += 1
    return size


def members(source, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, inflated bytes) of each member from a place on to the file's end."""
    at, data, base = start, b"", start
    source.seek(start)
    while at < size:
        n = member_size(data, at - base)
        if n is None or at - base + n > len(data):
            data, base = data[at - base :] + source.read(PIECE), at
            n = member_size(data)
            if n is None or n > len(data):
                raise ValueError(f"no whole BGZF member at byte {at}")
        extra = struct.unpack_from("<H", data, at - base + 10)[0]
        begin = at - base
        yield at, zlib.decompressobj(-15).decompress(data[begin + 12 + extra : begin + n - 8])
        at += n


def owned(source, start: int, stop: int, size: int) -> Iterator[tuple[bool, bytes]]:
    """(whether the member starts before stop, inflated bytes) from the first member of a range on."""
    first = start if start == 0 else first_member(source, start, size)
    for at, data in members(source, first, size):
        yield at < stop, data


def line_bytes(source, start: int, stop: int, size: int) -> Iterator[bytes]:
    """The bytes of the lines that belong to a range."""
    skipping = start > 0
    for mine, data in owned(source, start, stop, size):
        if skipping:
            if not mine:  # no line end in any member of this range: the line is the range's before it
                return
            end = data.find(b"\n")
            if end < 0:
                continue
            skipping, data = False, data[end + 1 :]
        if not mine:  # up to the end of the line that is open here
            end = data.find(b"\n") + 1
            yield data[: end or len(data)]
            if end:
                return
        else:
            yield data


# --- other layers ---------------------------------------------------------------------------------------------------------


def read_on(source) -> Iterator[bytes]:
    while data := source.read(PIECE):
        yield data


def inflated(pieces: Iterator[bytes], first: bytes) -> Iterator[bytes]:
    """Bytes of gzip members that follow each other."""
    z, data = zlib.decompressobj(31), first
    while True:
        while data:
            if out := z.decompress(data, PIECE):
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data = z.unused_data
                if data[:2] != GZIP[: len(data[:2])]:  # what follows the last member is no gzip
                    return
                z = zlib.decompressobj(31)
        more = next(pieces, None)
        if more is None:
            if out := z.flush():
                yield out
            return
        data = more


def unzipped(pieces: Iterator[bytes], first: bytes) -> Iterator[bytes]:
    """Bytes of a zip file's first entry, told by its own header."""
    data = first
    while len(data) < 30 and (more := next(pieces, None)):
        data += more
    flags, method = struct.unpack_from("<HH", data, 6)
    size, name, extra = struct.unpack_from("<I", data, 18)[0], *struct.unpack_from("<HH", data, 26)
    while len(data) < 30 + name + extra and (more := next(pieces, None)):
        data += more
    data = data[30 + name + extra :]
    if method == 8:
        z = zlib.decompressobj(-15)
        while not z.eof:
            while data and not z.eof:
                if out := z.decompress(data, PIECE):
                    yield out
                data = z.unconsumed_tail
            if z.eof or (data := next(pieces, b"")) == b"":
                break
        if out := z.flush():
            yield out
        return
    if method:
        raise ValueError(f"zip method {method} is not supported")
    left = None if flags & 8 else size  # a size that follows the data can't be known before
    while data and left != 0:
        yield data if left is None else data[:left]
        left = None if left is None else max(0, left - len(data))
        data = next(pieces, b"")


def peeled(pieces: Iterator[bytes], layers: int = MOST_LAYERS) -> Iterator[bytes]:
    """A stream without its gzip and zip layers, told by magic."""
    head = b""
    for _ in range(layers):
        head = b""
        while len(head) < 4 and (more := next(pieces, None)):
            head += more
        layer = inflated if head[:2] == GZIP else unzipped if head[:4] == ZIP else None
        if layer is None:
            break
        pieces, head = layer(pieces, head), b""
    if head:
        yield head
    yield from pieces


def whole_lines(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes, cut at line ends."""
    rest: list[bytes] = []
    for data in pieces:
        end = data.rfind(b"\n") + 1
        if end:
            yield b"".join([*rest, data[:end]])
            rest = [data[end:]] if end < len(data) else []
        else:
            rest.append(data)
    if rest:
        yield b"".join(rest)


def as_lines(piece: bytes) -> pa.Array:
    """Lines of a piece that ends at a line's or the file's end, without \\n or \\r\\n."""
    lines = piece.decode("utf-8", "replace").split("\n")
    if lines[-1] == "":
        lines.pop()
    return pa.array([x[:-1] if x.endswith("\r") else x for x in lines] if b"\r" in piece else lines, pa.string())


# --- the source -----------------------------------------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int
    size: int
    split: bool


def ranges(files: list[str], most: int) -> list[Range]:
    """A partition for each `most` bytes of a BGZF file and for each other file, in the order of the files."""
    out = []
    for file in files:
        store, at = opened(file)
        size = store.get_file_info(at).size
        with store.open_input_file(at) as source:
            split = member_size(source.read(256)) is not None
            if split:  # layers inside are no lines
                inner = next((d for _, d in members(source, 0, size) if d), b"")
                split = inner[:2] != GZIP and inner[:4] != ZIP
        cuts = range(0, max(size, 1), most) if split else [0]
        out += [Range(file, a, min(a + most, size) if split else size, size, split) for a in cuts]
    return out


class LineScan(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.most = options["files"].split("\n"), int(options.get("bytes", 32 << 20))

    def partitions(self) -> list[Range]:
        return ranges(self.files, self.most)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, at = opened(partition.file)
        if partition.split:
            with store.open_input_file(at) as source:
                yield from batches(whole_lines(line_bytes(source, partition.start, partition.stop, partition.size)))
        else:
            with store.open_input_stream(at, compression=None) as source:
                yield from batches(whole_lines(peeled(read_on(source))))


def batches(pieces: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for piece in pieces:
        yield pa.RecordBatch.from_arrays([as_lines(piece)], names=["line"])


class LineSource(DataSource):
    """Options: files (one path a line), bytes (of a packed file for each partition)."""

    @classmethod
    def name(cls) -> str:
        return "packed_lines"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> LineScan:
        return LineScan(self.options)


def streamed(content: bytes) -> Iterator[bytes]:
    """Bytes at hand without their layers, for files that only Spark can open."""
    return peeled(content[i : i + PIECE] for i in range(0, len(content), PIECE))
