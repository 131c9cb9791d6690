"""Packing by concatenate and cut: prefix sums over partition totals give global offsets, fixed windows cut the stream.

The documents, in the order in which their table is read, form one endless stream of token ids. Pass one tokenizes and
writes (part, seq, doc_id, ids) to the shared folder; the totals of the parts (one number for each part, as in zipWithIndex)
give each part its offset, a running sum in each part gives each document its own. Pass two cuts at multiples of the
window in DataFrame functions: a document that crosses a boundary gives a boundary record on both sides.

Defined results: null and empty texts are a document of the end id alone; repeated rows are packed once for each row; an
empty table gives no piece; other columns are ignored. Only the last sequence is padded.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.bpe import byte_chars
from strandloom.llm.common import given_back, slices, written

#: Bytes of text that are cut together; the arrays over them take some 30 times as many.
SLICE_BYTES = 4 << 20
#: The tokenizer's contractions; beside them its pieces are letters in a row, one digit, or other characters in a row.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
#: Totals of parts that are broadcast at most: 16 bytes each.
MOST_BROADCAST = 1_000_000
_coders: dict[str, "WordCoder"] = {}


class WordCoder:
    """The tokenizers library over the distinct pieces of a slice of texts.

    A slice's code points are classed, lower-cased and cut into the tokenizer's pieces in array steps; each distinct piece is coded
    once by the library's model and ids are dealt back by piece number. Texts that hold a special token go to the library whole,
    those that are not in normal form through its normalizer first. Nothing
    is kept from slice to slice, so memory is bounded by SLICE_BYTES or one longer text.
    """

    SPACE, LETTER, DIGIT, OTHER = 1, 2, 3, 4

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.kinds = [(self.SPACE, regex.compile(r"\p{White_Space}")), (self.LETTER, regex.compile(r"\p{L}")), (self.DIGIT, regex.compile(r"\p{N}"))]
        self.stand_in = {b: c for c, b in byte_chars().items() if b != ord("\n")}
        self.kind, self.lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)

    def learn(self, points: np.ndarray) -> None:
        """Class and lower case of code points that were not met before; a lower case of several characters is left to the normalizer."""
        for p in points.tolist():
            c, low = chr(p), self.lib.normalizer.normalize_str(chr(p))
            self.kind[p] = next((k for k, r in self.kinds if r.match(c)), self.OTHER)
            self.lower[p] = ord(low) if len(low) == 1 and self.kind[p] != self.SPACE else p

    def plain(self, text: str) -> bool:
        """Whether the normal form of a text is that of its characters one by one."""
        return text.isascii() or unicodedata.is_normalized("NFC", text) and "\u0130" not in text

    def coded(self, pieces: pa.Array) -> pa.Array:
        """Ids of each of some pieces in normal form, little-endian unsigned 32-bit in binary."""
        tokenize, flat, size = self.lib.model.tokenize, [], []
        for piece in "\n".join(pieces.to_pylist()).encode().decode("latin-1").translate(self.stand_in).split("\n"):
            ids = [t.id for t in tokenize(piece)] if piece else []
            flat += ids
            size.append(len(ids))
        offsets = np.concatenate([[0], np.cumsum(size[: len(pieces)], dtype=np.int64) * 4])
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.array(flat, "<u4"))])

    def pieces(self, text: str) -> tuple[pa.Array, np.ndarray]:
        """(the pieces of a text in normal form, the code point at which each starts)."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        if not kind.all():
            self.learn(np.unique(points[kind == 0]))
            kind = self.kind[points]
        points = self.lower[points]
        first = np.ones(len(points), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT)
        quote = np.flatnonzero((points == ord("'")) & first)
        follow = lambda i: points[np.minimum(quote + i, len(points) - 1)] * (quote + i < len(points))
        one, two = follow(1), follow(2)
        for tail in CONTRACTIONS:
            at = quote[(one == ord(tail[0])) & (two == ord(tail[1]) if len(tail) > 1 else True)]
            first[at + 1] = False
            end = at + 1 + len(tail)
            first[end[end < len(points)]] = True
        word = kind != self.SPACE
        places = np.flatnonzero(first & word)
        points, starts = points[word], np.flatnonzero(first[word])
        del kind, first, word
        starts = np.append(starts, len(points))
        if len(points) and points.max() > 0x7F:
            width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            upto = np.cumsum(width, dtype=np.int64 if len(points) > 1 << 29 else np.int32)
            starts = np.where(starts > 0, upto[starts - 1], 0)
            del width, upto
        data = points.tobytes()
        del points
        return pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data.decode("utf-32-le").encode())), places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); null is empty."""
        rows = [t or "" for t in texts.to_pylist()]
        whole = [i for i, t in enumerate(rows) if any(s in t for s in self.special)]
        if whole:  # at these rows the library's ids stand between those of the rest
            cuts, out = [0, *(x for i in whole for x in (i, i + 1)), len(rows)], []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if k % 2:
                    ids = np.array(self.lib.encode(rows[a], add_special_tokens=False).ids, np.uint32)
                    out.append((ids, np.array([len(ids)], np.int64)))
                elif a < b:
                    out.append(self.encode(pa.array(rows[a:b], pa.large_string())))
            return tuple(np.concatenate(x) for x in zip(*out))
        rows = [t if self.plain(t) else self.lib.normalizer.normalize_str(t) for t in rows]
        starts = np.cumsum([0, *(len(t) + 1 for t in rows)])
        pieces, places = self.pieces(" ".join(rows))
        of_row = np.searchsorted(places, starts)
        del rows, places
        met = pieces.dictionary_encode()
        del pieces
        out = self.coded(met.dictionary).take(met.indices)
        upto = np.frombuffer(out.buffers()[1], np.int64)[: len(out) + 1] >> 2 if len(out) else np.zeros(1, np.int64)
        ids = np.frombuffer(out.buffers()[2], np.uint32)[: upto[-1]] if upto[-1] else np.empty(0, np.uint32)
        return ids, np.diff(upto[of_row])


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """(part, at, doc_id, n, ids): at counts the tokens before the document in its part; ids is binary, little-endian unsigned 32 bit, end_id last."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        code, part, at = coder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for small in slices(batch, "text", SLICE_BYTES):
                ids, n = code.encode(small.column("text"))
                ids = np.insert(ids, np.cumsum(n), np.uint32(end_id)).astype("<u4", copy=False)
                n = n + 1
                upto = at + np.cumsum(n)
                bounds = np.concatenate([[0], np.cumsum(n) * 4]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(upto - n), small.column("doc_id"), pa.array(n), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])],
                    names=["part", "at", "doc_id", "n", "ids"],
                )
                at = int(upto[-1])
        given_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"part int, at long, doc_id {kind}, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset, boundary (the document goes on in the next window).

    The driver holds one number for each task of the scan, never one for each row; no row is shuffled.
    """
    stored = written(tokenized(docs, tokenizer, end_id))
    totals = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("n").alias("n")).collect())
    upto = np.cumsum([n for _, n in totals], dtype=np.int64)
    before = [(p, int(u) - n) for (p, n), u in zip(totals, upto, strict=True)]
    side = docs.sparkSession.createDataFrame(before, "part int, before long")
    side = F.broadcast(side) if len(before) <= MOST_BROADCAST else side  # a row for each scan task
    placed = stored.join(side, "part").withColumn("at", F.col("at") + F.col("before"))
    # A document's ids are cut inside its row, so each id is copied once.
    pieces = F.expr(f"""explode(transform(sequence(at div {window}, (at + n - 1) div {window}), s -> named_struct('sequence_id', s,
      'start', greatest(0L, s * {window} - at), 'stop', least(n, (s + 1) * {window} - at),
      'ids', substring(ids, cast(4 * greatest(0L, s * {window} - at) + 1 as int), cast(4 * (least(n, (s + 1) * {window} - at) - greatest(0L, s * {window} - at)) as int)))))""")
    return placed.select("doc_id", "n", "at", pieces.alias("p")).select(
        "doc_id",
        F.col("p.start").cast("long").alias("start"),
        F.expr("p.stop - p.start").cast("long").alias("length"),
        "p.ids",
        F.col("n").alias("doc_tokens"),
        F.col("p.sequence_id").cast("long").alias("sequence_id"),
        F.expr(f"at + p.start - p.sequence_id * {window}").cast("long").alias("offset"),
        F.expr("p.stop < n").alias("boundary"),
    )
