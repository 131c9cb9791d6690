"""BCF 2.2: records to and from rows. A file is split at its BGZF members; written records are BGZF blocks in row order.

A partition owns the records that start in the members of its range. Where a range doesn't begin with the file, its first record
is the first place whose bytes are a whole record of this file: every field is parsed, all numbers are of this header's dictionaries
and samples, and both parts end exactly where their lengths say.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import accumulate, pairwise
from math import isfinite

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.sources import layered
from strandloom.sources.text import heads, start_of

SCHEMA = "chrom string, pos bigint, ids array<string>, ref string, alts array<string>, qual float, filters array<string>, info map<string,string>, format array<string>, samples array<map<string,string>>"
_TEXT, _MAP = pa.string(), pa.map_(pa.string(), pa.string())
#: The same columns in Arrow.
ARROW = pa.schema([("chrom", _TEXT), ("pos", pa.int64()), ("ids", pa.list_(_TEXT)), ("ref", _TEXT), ("alts", pa.list_(_TEXT)), ("qual", pa.float32()), ("filters", pa.list_(_TEXT)), ("info", _MAP), ("format", pa.list_(_TEXT)), ("samples", pa.list_(_MAP))])
#: Fixed values of the format: type codes, their struct letters, and the values for missing and end of vector.
KINDS = {1: ("b", -128, -127), 2: ("h", -32768, -32767), 3: ("i", -(2**31), -(2**31) + 1)}
MOST_FLOAT = struct.unpack("<f", b"\xff\xff\x7f\x7f")[0]
FLOAT_MISSING, FLOAT_END = b"\x01\x00\x80\x7f", b"\x02\x00\x80\x7f"
#: Fixed value: the empty BGZF block at the end of a file.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


#: Fixed value: the layout of a record's first fields, up to its ID.
FIXED = struct.Struct("<IIiii4sHHI")


@lru_cache(1 << 12)
def _struct(form: str) -> struct.Struct:
    return struct.Struct("<" + form)


class _Reader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def shape(self) -> tuple[int, int]:
        """(type, length) of a typed value."""
        b = self.data[self.at]
        self.at += 1
        n = b >> 4
        if n == 15:
            kind, _ = self.shape()
            form = _struct(KINDS[kind][0])
            n = form.unpack_from(self.data, self.at)[0]
            self.at += form.size
        return b & 15, n

    def values(self, kind: int, n: int) -> list:
        """Values with None for missing; vectors end early at their end mark."""
        if kind == 7:
            raw = self.data[self.at : self.at + n].rstrip(b"\0")
            self.at += n
            return [raw.decode("utf-8", "replace")] if raw not in (b"", b".") else []
        if not kind or not n:
            return []
        letter, missing, end = KINDS[kind] if kind != 5 else ("f", None, None)
        form = _struct(f"{n}{letter}")
        at, out = self.at, form.unpack_from(self.data, self.at)
        self.at += form.size
        if kind == 5:
            if all(v == v for v in out):  # marks are NaNs
                return list(out)
            raw = [self.data[i : i + 4] for i in range(at, self.at, 4)]
            return [None if r == FLOAT_MISSING else v for r, v in zip(raw, out, strict=True) if r != FLOAT_END]
        if min(out) > end:  # the marks are the two smallest
            return list(out)
        return [None if v == missing else v for v in out if v != end]

    def typed(self) -> list:
        return self.values(*self.shape())


def dictionaries(header: str) -> tuple[list[str], list[str]]:
    """(contigs, strings) by index; IDX in a definition counts, else order, PASS being the first string."""
    contigs: dict[int, str] = {}
    strings: dict[int, str] = {0: "PASS"}
    seen = {"PASS"}
    for kind, body in re.findall(r"^##(contig|INFO|FORMAT|FILTER)=<(.*)>$", header, re.M):
        name, idx = re.search(r"(?:^|,)ID=([^,>]*)", body)[1], re.search(r",IDX=(\d+)", body)
        if kind == "contig":
            contigs[int(idx[1]) if idx else len(contigs)] = name
        elif name not in seen:
            strings[int(idx[1]) if idx else len(strings)] = name
            seen.add(name)
    flat = lambda d: [d.get(i, "") for i in range(max(d, default=-1) + 1)]
    return flat(contigs), flat(strings)


def _show(values: list) -> str:
    return ",".join("." if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in values) or "."


@lru_cache(1 << 12)
def _genotype(values: tuple) -> str:
    out = ""
    for k, v in enumerate(values):
        out += ("|" if v & 1 else "/") * (k > 0) + (str((v >> 1) - 1) if v >> 1 else ".") if v is not None else ("/" if k else "") + "."
    return out or "."


@dataclass(frozen=True)
class Head:
    """What a file's records refer to, and the bytes up to its first record."""

    contigs: list[str]
    strings: list[str]
    samples: int
    size: int


def head_of(data: bytes) -> Head | None:
    """The header at the start of unpacked bytes, None where it is cut."""
    if data[:3] != b"BCF":
        raise ValueError("not a BCF file")
    n = struct.unpack_from("<I", data, 5)[0] if len(data) >= 9 else 0
    if len(data) < 9 + n or len(data) < 9:
        return None
    text = data[9 : 9 + n].split(b"\0")[0].decode("utf-8", "replace")
    names = next((x for x in text.splitlines() if x.startswith("#CHROM")), "").split("\t")
    return Head(*dictionaries(text), max(0, len(names) - 9), 9 + n)


def record_row(data: bytes, at: int, head: Head) -> dict:
    """The row of the record at a place of unpacked bytes."""
    shared, each, chrom, pos, _, raw_qual, n_info, n_allele, sample_word = FIXED.unpack_from(data, at)
    r = _Reader(data, at + FIXED.size)
    qual = _struct("f").unpack(raw_qual)[0]
    ids = r.typed()
    alleles = [(r.typed() or ["."])[0] for _ in range(n_allele)]
    filters = [head.strings[i] for i in r.typed() if i is not None]
    info = {}
    for _ in range(n_info):
        key = head.strings[r.typed()[0]]
        kind, size = r.shape()
        info[key] = "" if size == 0 else _show(r.values(kind, size))
    names, cells = [], [{} for _ in range(sample_word & 0xFFFFFF)]
    if r.at != at + 8 + shared:
        raise ValueError("a record's fields and length differ")
    for _ in range(sample_word >> 24):
        key = head.strings[r.typed()[0]]
        kind, size = r.shape()
        names.append(key)
        for cell in cells:
            values = r.values(kind, size)
            cell[key] = _genotype(tuple(values)) if key == "GT" and kind in KINDS else _show(values)
    if r.at != at + 8 + shared + each:
        raise ValueError("a record's samples and length differ")
    return {"chrom": head.contigs[chrom], "pos": pos + 1, "ids": ids[0].split(";") if ids else [], "ref": alleles[0] if alleles else "N", "alts": alleles[1:], "qual": None if raw_qual == FLOAT_MISSING else qual, "filters": filters, "info": list(info.items()), "format": names, "samples": [list(c.items()) for c in cells]}


def may_start(data: bytes, at: int, head: Head) -> bool:
    """Whether the fixed fields at a place are those of a record of this file."""
    shared, each, chrom, pos, length, _, word, samples = struct.unpack_from("<IIiiiIII", data, at)
    return 0 <= chrom < len(head.contigs) and pos >= -1 and length >= 0 and samples & 0xFFFFFF == head.samples and word >> 16 >= 1 and (word & 0xFFFF) * 2 + (word >> 16) + 24 <= shared < 1 << 30 and each < 1 << 30


def record_places(stream: Iterator[tuple[bool, bytes]], head: Head, from_start: bool) -> Iterator[tuple[bytes, list[int]]]:
    """(bytes, places of whole records in them) of the records that start in the members of a range."""
    data, at, end, more, closed = b"", 0, 0, True, False  # end: how many of the bytes are of the range; closed: all of them are here

    def grow() -> None:
        nonlocal data, end, more, closed
        got = [data]
        while sum(map(len, got[1:])) < layered.PIECE:
            mine, piece = next(stream, (False, None))
            if piece is None:
                more, closed = False, True
                break
            got.append(piece)
            if not mine:
                closed = True
                break
            end += len(piece)
        data = b"".join(got)

    if from_start:
        while len(data) < head.size and more:
            grow()
        at = head.size
    else:
        while True:  # the first record of the range
            if at >= end and closed:
                return
            if len(data) < at + 32 or at >= end:
                if not more:
                    return
                grow()
                continue
            if may_start(data, at, head):
                n = 8 + sum(struct.unpack_from("<II", data, at))
                if len(data) < at + n and more:
                    grow()
                    continue
                try:
                    record_row(data[at : at + n], 0, head)
                    break
                except (ValueError, IndexError, KeyError, struct.error):
                    pass
            at += 1
    while True:
        places = []
        while at < end and len(data) >= at + 8 and len(data) >= at + 8 + sum(struct.unpack_from("<II", data, at)):
            places.append(at)
            at += 8 + sum(struct.unpack_from("<II", data, at))
        if places:
            yield data, places
        if at >= end and closed:
            return
        if not more:
            raise ValueError("a record is cut at the file's end")
        data, at, end = data[at:], 0, end - at
        grow()


def rows_of(stream: Iterator[tuple[bool, bytes]], head: Head, from_start: bool) -> Iterator[pa.RecordBatch]:
    for data, places in record_places(stream, head, from_start):
        for i in range(0, len(places), 2000):
            rows = [record_row(data, at, head) for at in places[i : i + 2000]]
            yield pa.RecordBatch.from_arrays([_column([r[f.name] for r in rows], f.type) for f in ARROW], schema=ARROW)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """values without None in lists, built from their flat entries: several times as fast as entry by entry."""
    if not pa.types.is_list(kind) and not pa.types.is_map(kind):
        return pa.array(values, kind)
    flat = [x for v in values for x in v]
    offsets = pa.array(accumulate(map(len, values), initial=0), pa.int32())
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(offsets, _column(flat, kind.value_type), type=kind)
    return pa.MapArray.from_arrays(offsets, pa.array([k for k, _ in flat], kind.key_type), pa.array([v for _, v in flat], kind.item_type), type=kind)


def _values(column: pa.Array) -> list:
    """Entries of a column, maps as lists of pairs: what to_pylist() gives, from the flat entries."""
    if pa.types.is_string(column.type) or pa.types.is_primitive(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    if not pa.types.is_list(column.type) and not pa.types.is_map(column.type):
        return column.to_pylist()
    offsets = column.offsets.to_pylist()
    first, stop = offsets[0], offsets[-1]
    if pa.types.is_list(column.type):
        flat = _values(column.values[first:stop])
    else:
        flat = list(zip(_values(column.keys[first:stop]), _values(column.items[first:stop]), strict=True))
    out = [flat[a - first : b - first] for a, b in pairwise(offsets)]
    return [v if there else None for v, there in zip(out, column.is_valid().to_pylist(), strict=True)] if column.null_count else out


def head_from(stream: Iterator[bytes]) -> Head:
    data = b""
    for piece in stream:
        data += piece
        if len(data) >= 9 and (head := head_of(data)):
            return head
    raise ValueError("a file has no BCF header")


@dataclass
class BcfRange(layered.Range):
    head: Head | None = None


class BcfScan(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.most = options["files"].split("\n"), int(options.get("bytes", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        """The driver reads each file's header once and its partitions carry what it says."""
        heads_of = {}
        for file in self.files:
            store, at = layered.opened(file)
            with store.open_input_stream(at, compression=None) as source:
                heads_of[file] = head_from(layered.peeled(layered.read_on(source)))
        return [BcfRange(**r.__dict__, head=heads_of[r.file]) for r in layered.ranges(self.files, self.most)]

    def read(self, partition: BcfRange) -> Iterator[pa.RecordBatch]:
        store, at = layered.opened(partition.file)
        if partition.split:
            with store.open_input_file(at) as source:
                yield from rows_of(layered.owned(source, partition.start, partition.stop, partition.size), partition.head, partition.start == 0)
        else:
            with store.open_input_stream(at, compression=None) as source:
                yield from rows_of(((True, piece) for piece in layered.peeled(layered.read_on(source))), partition.head, True)


class BcfSource(DataSource):
    """Options: files (one path a line), bytes (of a file for each partition)."""

    @classmethod
    def name(cls) -> str:
        return "bcf_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BcfScan:
        return BcfScan(self.options)


def read(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """ord and the columns of SCHEMA, in ranges of split_bytes; in stores that only Spark opens, a file is held whole by its task."""
    files = [name for name, _ in heads(spark, path, 1)]
    if files and layered.reachable(files[0]):
        spark.dataSource.register(BcfSource)
        out = spark.read.format("bcf_records").option("files", "\n".join(files)).option("bytes", split_bytes).load()
    else:

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    data = content.as_py()
                    yield from rows_of(((True, piece) for piece in layered.streamed(data)), head_from(layered.streamed(data)), True)

        out = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, SCHEMA)
    return out.select(F.monotonically_increasing_id().alias("ord"), "*")


def header_lines(spark: SparkSession, path: str) -> list[str]:
    """Header of the first file under a path, without the indices of its definitions. Only the file's start is read, more of it until the header is whole."""
    n = 1 << 20
    while True:
        raw = heads(spark, path, n)[0][1]
        data = start_of(raw, 1 << 40)
        size = struct.unpack_from("<I", data, 5)[0] if data[:3] == b"BCF" and len(data) >= 9 else None
        if size is not None and len(data) >= 9 + size:
            lines = data[9 : 9 + size].split(b"\0")[0].decode("utf-8", "replace").splitlines()
            return [re.sub(r",IDX=\d+", "", x) if x.startswith("##") else x for x in lines]
        if len(raw) < n:
            raise ValueError(f"{path} has no BCF header")
        n *= 4


def text_lines(records: DataFrame) -> DataFrame:
    """(ord, line): rows of `read` as VCF text."""
    listed = lambda c, sep: F.when(F.size(c) > 0, F.array_join(c, sep)).otherwise(".")
    info = F.transform(F.map_entries("info"), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    cells = F.transform("samples", lambda cell: F.array_join(F.transform("format", lambda k: F.coalesce(F.try_element_at(cell, k), F.lit("."))), ":"))
    qual = F.coalesce(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", ""), F.lit("."))
    site = F.array("chrom", F.col("pos").cast("string"), listed(F.col("ids"), ";"), "ref", listed(F.col("alts"), ","), qual, listed(F.col("filters"), ";"), listed(info, ";"))
    return records.select("ord", F.array_join(F.concat(site, F.when(F.size("samples") > 0, F.concat(F.array(listed(F.col("format"), ":")), cells)).otherwise(F.array().cast("array<string>"))), "\t").alias("line"))


def _int_kind(values: list[int]) -> int:
    """The narrowest type that holds values beside its reserved ones."""
    low, high = min(values, default=0), max(values, default=0)
    return 1 if low >= -120 and high <= 127 else 2 if low >= -32760 and high <= 32767 else 3


def _holds(numbers: list[int | float | None], kind: str) -> bool:
    """Whether the format has numbers of a type: 32 bits, of integers less the reserved ones."""
    there = [v for v in numbers if v is not None]
    if kind == "Integer":
        return not there or (min(there) >= -(2**31) + 8 and max(there) < 2**31)
    return all(not isfinite(v) or abs(v) <= MOST_FLOAT for v in there)


def _length(n: int, kind: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind]) + _typed_ints([n])


def _int_vector(values: list[int | None], kind: int, width: int) -> bytes:
    """values, None for missing, filled up to width with the end of vector."""
    letter, missing, end = KINDS[kind]
    return _struct(f"{width}{letter}").pack(*(missing if v is None else v for v in values), *[end] * (width - len(values)))


def _float_vector(values: list[float | None], width: int) -> bytes:
    return b"".join(FLOAT_MISSING if v is None else struct.pack("<f", v) for v in values) + FLOAT_END * (width - len(values))


def _typed_ints(values: list[int | None]) -> bytes:
    kind = _int_kind([v for v in values if v is not None])
    return _length(len(values), kind) + _int_vector(values, kind, len(values))


@lru_cache(1 << 12)
def _key(number: int) -> bytes:
    """A key's number in the dictionary of strings."""
    return _typed_ints([number])


def _typed_text(s: str) -> bytes:
    raw = s.encode()
    return _length(len(raw), 7) + raw


def header_bytes(lines: list[str]) -> bytes:
    text = ("\n".join(lines) + "\n").encode() + b"\0"
    return b"BCF\x02\x02" + struct.pack("<I", len(text)) + text


def types(lines: list[str]) -> dict[tuple[str, str], str]:
    """Type by (INFO or FORMAT, key) of header lines."""
    found = (re.match(r"##(INFO|FORMAT)=<ID=([^,>]+),.*?Type=(\w+)", x) for x in lines)
    return {(m[1], m[2]): m[3] for m in found if m}


def _parsed(value: str, kind: str) -> list:
    """Entries of a value as its type says, None for missing."""
    read = int if kind == "Integer" else float
    return [None if x in (".", "") else read(x) for x in value.split(",")]


def _one(value: str, kind: str) -> bytes:
    """A typed INFO value: a vector of numbers, text, or nothing for a flag. Numbers that the format can't hold stay whole as text; a value tells its own type."""
    if kind == "Flag" or value == "":
        return b"\x00"
    if kind in ("Integer", "Float") and _holds(numbers := _parsed(value, kind), kind):
        return _typed_ints(numbers) if kind == "Integer" else _length(len(numbers), 5) + _float_vector(numbers, len(numbers))
    return _typed_text(value)


@lru_cache(1 << 12)
def genotype_codes(gt: str) -> tuple[int, ...]:
    """Allele numbers of a GT as the format codes them: (number + 1) * 2, and 1 more for an allele that is phased with the one before."""
    marks = re.findall(r"[/|]", gt)
    return tuple((0 if a in (".", "") else (int(a) + 1) << 1) | int(k > 0 and marks[k - 1] == "|") for k, a in enumerate(re.split(r"[/|]", gt)))


def _each(key: str, values: list[str], kind: str) -> bytes:
    """Type, length and one vector for each sample, all as long as the longest; text for all where one sample has a number that the format can't hold."""
    rows = [genotype_codes(v) for v in values] if key == "GT" else [_parsed(v, kind) for v in values] if kind in ("Integer", "Float") else None
    if rows is None or key != "GT" and not all(_holds(r, kind) for r in rows):
        raw = [b"" if v == "." else v.encode() for v in values]
        width = max(map(len, raw))
        return _length(width, 7) + b"".join(x.ljust(width, b"\0") for x in raw)
    width = max(map(len, rows))
    if kind == "Float" and key != "GT":
        return _length(width, 5) + b"".join(_float_vector(r, width) for r in rows)
    number = _int_kind([v for r in rows for v in r if v is not None])
    return _length(width, number) + b"".join(_int_vector(r, number, width) for r in rows)


def record(row: dict, contigs: dict[str, int], strings: dict[str, int], kinds: dict[tuple[str, str], str] | None = None) -> bytes:
    """One record of a row: chrom, pos, id, ref, alts; qual, filters, info (map), format and samples (maps) where they are there, or gts alone.

    Values are encoded by the types that the header gives; keys without one are text.
    """
    kinds = kinds or {}
    alleles, info = [row["ref"], *row["alts"]], dict(row.get("info") or {})
    names, cells = row.get("format"), row.get("samples")
    if names is None:
        names, cells = (["GT"], [{"GT": g} for g in row["gts"]]) if row.get("gts") else ([], [])
    cells = [dict(c) for c in cells or []]
    names = [k for k in names if cells]
    qual = FLOAT_MISSING if row.get("qual") is None else struct.pack("<f", row["qual"])
    shared = struct.pack("<iii", contigs[row["chrom"]], row["pos"] - 1, len(row["ref"])) + qual
    shared += struct.pack("<HHI", len(info), len(alleles), len(cells) | len(names) << 24)
    filters = row.get("filters") or []
    shared += _typed_text(row.get("id") or ".") + b"".join(map(_typed_text, alleles)) + (_typed_ints([strings[f] for f in filters]) if filters else b"\x00")
    for k, v in info.items():
        shared += _key(strings[k]) + _one(v, kinds.get(("INFO", k), "String"))
    each = b"".join(_key(strings[k]) + _each(k, [c.get(k) or "." for c in cells], kinds.get(("FORMAT", k), "String")) for k in names)
    return struct.pack("<II", len(shared), len(each)) + shared + each


def bgzf(data: bytes) -> bytes:
    """Data as BGZF blocks."""
    out = []
    for at in range(0, len(data), 60_000):
        part = data[at : at + 60_000]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


#: Columns that blocks() takes where rows have them.
FIELDS = {"id": "string", "qual": "float", "filters": "array<string>", "info": "map<string,string>", "format": "array<string>", "samples": "array<map<string,string>>", "gts": "array<string>"}


def blocks(rows: DataFrame, header: list[str]) -> DataFrame:
    """place, data: BGZF blocks of sorted rows (chrom, pos, ref, alts and those of FIELDS that are there); with the header's before and END_BLOCK after they are a BCF file.

    place is (task, block in it), so the order of sorted partitions is the order of the file and nothing is collected. Contigs
    and keys must be in the header: see missing_definitions() and encodable().
    """
    names, strings = dictionaries("\n".join(header))
    contig_at, string_at, kinds = {c: i for i, c in enumerate(names)}, {s: i for i, s in enumerate(strings)}, types(header)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                data = b"".join(record(dict(zip(part.schema.names, r, strict=True)), contig_at, string_at, kinds) for r in zip(*map(_values, part.columns), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([bgzf(data)], pa.binary())], names=["data"])

    there = [c for c in FIELDS if c in rows.columns]
    packed = rows.select("chrom", "pos", "ref", "alts", *(F.col(c).cast(FIELDS[c]) for c in there)).mapInArrow(pack, "data binary")
    return packed.select(F.monotonically_increasing_id().alias("place"), "data")


def _named(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def missing_definitions(rows: DataFrame, header: list[str]) -> list[str]:
    """Definitions, as text of any number, of the FILTER, INFO and FORMAT keys of rows that a header lacks; a file has few keys."""
    have = {(m[1], m[2]) for x in header if (m := re.match(r"##(FILTER|INFO|FORMAT)=<ID=([^,>]+)", x))} | {("FILTER", "PASS")}
    keys = [F.transform(c, partial(_named, kind)) for kind, name, c in (("FILTER", "filters", F.col("filters")), ("INFO", "info", F.map_keys("info")), ("FORMAT", "format", F.col("format"))) if name in rows.columns]
    if not keys:
        return []
    found = rows.select(F.explode(F.concat(*(F.coalesce(k, F.array().cast("array<struct<kind:string,key:string>>")) for k in keys))).alias("k")).distinct().select("k.*").collect()
    lines = []
    for r in sorted((r["kind"], r["key"]) for r in found):
        if r not in have:
            lines.append(f'##FILTER=<ID={r[1]},Description="not defined in the input">' if r[0] == "FILTER" else f'##{r[0]}=<ID={r[1]},Number=.,Type=String,Description="not defined in the input">')
    return lines
