"""Substring dedup: content-defined chunks by a gear rolling hash, matched across documents by digest.

A cut lies where the gear hash of the last 16 bytes is the smallest within REACH bytes on both sides (of equal ones the first),
so chunks are the same wherever the same passage stands, whatever was inserted before it. Where no such place comes for
MOST_CHUNK bytes, as in periodic text, the last smallest hash within them is cut at. Blocks of documents send the digests of
their distinct chunks to buckets; a bucket finds the chunks that several documents hold and the smallest doc_id of each, and
answers in the same order. A run of such chunks of at least `least` words is a repeated passage; the smallest doc_id keeps it.
Words of over LONG_WORD bytes, as in scripts and lines without blanks, count as one for each WORD_BYTES bytes.

A passage loses a part of a chunk at both ends. So that this hides no passage of WHOLE_WORDS = 50 words, whatever their
length, digests of `least` words in a row travel as well: in any 50 words there are 50 - least + 1 such windows, and of each
so many windows in a row the ones of the smallest hash are sent, hence one at least of those in any 50 words. `least` trades
the number of windows against the length of what is reported around a chance repeat.

Repeats inside one document are left alone. 64-bit digests are enough: at 30 GB chance makes two windows equal once in some 100 runs.

Defined results: null and empty texts have no chunk; a null doc_id neither keeps nor loses passages; rows that share a doc_id
are one document; ties can't arise, the smallest doc_id keeps a passage; other columns, whatever their names, pass through
dedup() unchanged; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bucket_cuts, free_name, given_back, joined, mix, pack_ints, pack_u64, runs, scan_parts, span_hashes, unpack_ints, unpack_u64, word_spans

GEAR = (mix(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: A 64-bit number for each byte, for the digests.
DIGEST_KEY = mix(np.arange(5000, 5256, dtype=np.uint64))
REACH, LEAST_CHUNK, MOST_CHUNK, LEAST_WORDS = 16, 16, 64, 35
WHOLE_WORDS, LONG_WORD, WORD_BYTES = 50, 30, 6
#: Zero bytes around each text of a slice: as many as a cut looks at on either side.
PAD = bytes(REACH + 16)
SLICE, SEGMENT = 1 << 22, 1 << 20


def gear(b: np.ndarray) -> np.ndarray:
    """Gear hashes of the 16 bytes that end at each byte (fewer at the start)."""
    h = GEAR[b]
    for s in (1, 2, 4, 8):
        moved = h[:-s] << np.uint32(s)
        h = h.copy()
        h[s:] += moved
    return h


def sliding(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best (minimum or maximum) of every n in a row of x."""
    of, out = 1, x
    while 2 * of <= n:
        out, of = best(out[:-of], out[of:]), 2 * of
    return best(out[: len(x) - n + 1], out[n - of :]) if of < n else out


def minima(b: np.ndarray) -> np.ndarray:
    """Where chunks start: characters whose gear hash is the smallest within REACH on both sides, the first of equal ones."""
    out = []
    for at in range(0, len(b), SEGMENT):
        a, z = max(0, at - len(PAD)), min(len(b), at + SEGMENT + len(PAD))
        if z - a <= 2 * REACH:
            break
        h = gear(b[a:z])
        h[(b[a:z] & 0xC0) == 0x80] = 0xFFFFFFFF  # never inside a character
        least = sliding(h, 2 * REACH + 1, np.minimum)
        found = np.flatnonzero(h[REACH:-REACH] == least) + REACH
        before = sliding(h, REACH, np.minimum)
        found = found[h[found] < before[found - REACH]] + a + 1  # the hash ends at this byte, the cut comes after it
        out.append(found[(found >= at) & (found < at + SEGMENT)])
    found = np.concatenate([np.empty(0, np.int64), *out])
    return found[(b[np.minimum(found, len(b) - 1)] & 0xC0) != 0x80]


def forced(b: np.ndarray, start: int, stop: int) -> list[int]:
    """Cuts in a stretch without a smallest hash: the last smallest one within reach, so that a period repeats its chunks."""
    out = []
    while stop - start > MOST_CHUNK:
        able = np.flatnonzero((b[start + LEAST_CHUNK : start + MOST_CHUNK + 1] & 0xC0) != 0x80)[::-1]
        lo = max(0, start + LEAST_CHUNK - 16)
        h = gear(b[lo : start + MOST_CHUNK])[start + LEAST_CHUNK - 1 - lo :]
        start += LEAST_CHUNK + int(able[h[able].argmin()])
        out.append(start)
    return out


@dataclass
class Slice:
    """Some texts of a table, one after another with PAD around each, and what travels of them; rows are those of the table."""

    b: np.ndarray
    row: np.ndarray  # of each chunk
    start: np.ndarray
    stop: np.ndarray
    digest: np.ndarray
    w_row: np.ndarray  # of each chosen window of words
    w_start: np.ndarray
    w_stop: np.ndarray
    w_digest: np.ndarray
    words: np.ndarray  # starts of all words
    text_start: dict[int, int]


def slices(column: pa.ChunkedArray, able: np.ndarray, least: int) -> Iterator[Slice]:
    """The texts of the rows that are able, some SLICE bytes at a time."""
    data, bounds = joined(column)
    rows = np.flatnonzero(able & (np.diff(bounds) > 0))
    filled = np.concatenate([[0], np.cumsum(np.diff(bounds)[rows])])
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(filled, filled[i] + SLICE)))
        yield sliced([data[bounds[r] : bounds[r + 1]].tobytes() for r in rows[i:j]], rows[i:j], least)
        i = j


def sliced(texts: list[bytes], rows: np.ndarray, least: int) -> Slice:
    b = np.frombuffer(PAD + PAD.join(texts) + PAD, np.uint8)
    first = np.cumsum([len(PAD), *(len(t) + len(PAD) for t in texts)])[:-1]
    end = first + np.array([len(t) for t in texts], np.int64)
    at = minima(b)
    text = np.searchsorted(first, at, "right") - 1
    at = at[(text >= 0) & (at > first[text]) & (at < end[text])]
    start, stop = np.sort(np.concatenate([first, at])), np.sort(np.concatenate([at, end]))
    long = np.flatnonzero(stop - start > MOST_CHUNK)
    if len(long):
        more = [x for k in long.tolist() for x in forced(b, int(start[k]), int(stop[k]))]
        start, stop = np.sort(np.concatenate([start, more])).astype(np.int64), np.sort(np.concatenate([stop, more])).astype(np.int64)
    of = lambda x: rows[np.searchsorted(first, x, "right") - 1]
    # A padding byte is no white space, so that spans are taken from the texts' own bounds.
    inside = np.sort(np.concatenate([first, end]))
    w_start, w_stop, n = word_spans(b, np.concatenate([[0], inside, [len(b)]]))
    keep = np.repeat(np.arange(len(n)) % 2 == 1, n)  # spans between texts are padding
    w_start, w_stop, n = w_start[keep], w_stop[keep], n[1::2]
    at = chosen(runs(span_hashes(b, w_start, w_stop, DIGEST_KEY), least), n, least)
    begins = w_start[at[0]]
    return Slice(b, of(start), start, stop, span_hashes(b, start, stop, DIGEST_KEY), of(begins), begins, w_stop[at[0] + least - 1], at[1], w_start, dict(zip(rows.tolist(), first.tolist(), strict=True)))


def chosen(h: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, digests) of the windows that travel: of every WHOLE_WORDS - least + 1 in a row of one text those of the smallest hash."""
    many = WHOLE_WORDS - least + 1
    if len(h) < many or many < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.cumsum(n)
    left = np.repeat(ends, n)[: len(h)] - np.arange(len(h))  # words from here to the end of the text
    m = sliding(h, many, np.minimum)
    m[left[: len(m)] < WHOLE_WORDS] = 0  # not all of one text
    bar = sliding(np.concatenate([np.zeros(many - 1, np.uint64), m, np.zeros(many - 1, np.uint64)]), many, np.maximum)
    at = np.flatnonzero(h == bar[: len(h)])
    return at, h[at]


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(ends in bytes, digests) of a text's chunks."""
    for s in slices(pa.chunked_array([pa.array([text], pa.string())]), np.array([True]), LEAST_WORDS):
        return s.stop - len(PAD), s.digest
    return np.empty(0, np.int64), np.empty(0, np.uint64)


def n_words(raw: bytes, least: int) -> int:
    """Words of a passage, long ones by their length; at `least` words it need not look further."""
    found = raw.split()
    return len(found) if len(found) >= least else sum(len(w) // WORD_BYTES if len(w) > LONG_WORD else 1 for w in found)


def _united(doc: int, runs: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint spans of runs, and of what only `more` covers; spans that touch are one where the first doc is itself in both or in neither."""
    spans, k = list(runs), 0
    at = 0
    for a, b, first in more:  # by start
        a = max(a, at)
        while k < len(runs) and runs[k][1] <= a:
            k += 1
        i = k
        while a < b:
            if i < len(runs) and runs[i][0] <= a:
                a, i = max(a, runs[i][1]), i + 1
                continue
            stop = min(b, runs[i][0]) if i < len(runs) else b
            spans.append((a, stop, first))
            a = at = stop
    out: list[tuple[int, int, int]] = []
    for a, b, first in sorted(spans):
        joins = out and out[-1][1] == a and (out[-1][2] == doc) == (first == doc) and ((a, b, first) not in runs or out[-1] not in runs)
        if joins:
            out[-1] = (out[-1][0], b, out[-1][2])
        else:
            out.append((a, b, first))
    return out


def _distinct(docs: list[int | None], column: pa.ChunkedArray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct digests of a block, the smallest document of each, and whether it has several."""
    able = np.array([d is not None for d in docs], bool)
    ids = np.array([d or 0 for d in docs], np.int64)
    parts = [(np.concatenate([s.digest, s.w_digest]), ids[np.concatenate([s.row, s.w_row])]) for s in slices(column, able, least)]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
    digest, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((doc, digest))
    digest, doc = digest[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
    end = np.append(start[1:], len(digest)) - 1
    return digest[start], doc[start], (doc[start] != doc[end]).astype(np.uint8)


def repeated(docs: list[int | None], column: pa.ChunkedArray, keys: np.ndarray, owners: tuple[np.ndarray, np.ndarray], least: int) -> list[list[tuple[int, int, int]]]:
    """For each text the (start, stop, first doc) of its repeated passages in code points, cut where the first doc stops or starts to be itself."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    ids = np.array([d or 0 for d in docs], np.int64)
    for s in slices(column, np.array([d is not None for d in docs], bool), least):
        at = np.searchsorted(keys, s.digest)
        many, first = owners[0][at] > 0, owners[1][at]
        own = first == ids[s.row]
        new = np.concatenate([[True], s.row[1:] != s.row[:-1]])
        begin = np.flatnonzero(many & (new | ~np.concatenate([[False], many[:-1]])))
        end = np.flatnonzero(many & (np.append(new[1:], True) | ~np.append(many[1:], False)))
        # Words of each run: those that start in it, and the rest of one at its start.
        a, b = s.start[begin], s.stop[end]
        i, j = np.searchsorted(s.words, a), np.searchsorted(s.words, b)
        cut = np.ones(len(a), bool)
        met = i < len(s.words)
        cut[met] = s.words[i[met]] != a[met]
        n = j - i + (cut & ((s.b[a] != 32) & (s.b[a] - np.uint8(9) > 4)))
        for k in np.flatnonzero((n < least) & (b - a >= least * WORD_BYTES)).tolist():
            n[k] = n_words(s.b[a[k] : b[k]].tobytes(), least)
        by_row: dict[int, tuple[list, list]] = {}
        for k in np.flatnonzero(n >= least).tolist():
            x, y = int(begin[k]), int(end[k]) + 1
            parts = [x, *(np.flatnonzero(own[x + 1 : y] != own[x : y - 1]) + x + 1).tolist(), y]
            by_row.setdefault(int(s.row[x]), ([], []))[0].extend((int(s.start[p]), int(s.stop[q - 1]), int(first[p])) for p, q in zip(parts, parts[1:], strict=False))
        at = np.searchsorted(keys, s.w_digest)
        for k in np.flatnonzero(owners[0][at] > 0).tolist():
            by_row.setdefault(int(s.w_row[k]), ([], []))[1].append((int(s.w_start[k]), int(s.w_stop[k]), int(owners[1][at[k]])))
        point = np.concatenate([[0], np.cumsum((s.b & 0xC0) != 0x80)])
        for row, (whole, more) in by_row.items():
            base = point[s.text_start[row]]
            out[row] = [(int(point[x] - base), int(point[y] - base), f) for x, y, f in _united(docs[row], whole, more)]
    return out


def _with_spans(docs: DataFrame, fn, schema: str, least: int) -> DataFrame:
    """Run fn(table, spans of each row) over blocks of documents, after chunk digests met in buckets."""
    parts = 2 * scan_parts(docs)
    name = free_name(docs, "__block")
    blocked = docs.withColumn(name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))  # by text too: null and repeated ids are many blocks

    def keys(t: pa.Table) -> pa.Table:
        digest, doc, many = _distinct(t.column("doc_id").to_pylist(), t.column("text"), least)
        edge = bucket_cuts(digest, parts)
        full = np.flatnonzero(np.diff(edge)).tolist()
        block = t.column(name)[0].as_py()
        cut = [(edge[b], edge[b + 1]) for b in full]
        out = pa.table({"block": pa.array([block] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()), "keys": pa.array([pack_u64(digest[a:b]) for a, b in cut], pa.binary()), "docs": pa.array([pack_ints(doc[a:b]) for a, b in cut], pa.binary()), "many": pa.array([many[a:b].tobytes() for a, b in cut], pa.binary())})
        del digest, doc, many
        given_back()
        return out

    def owners(t: pa.Table) -> pa.Table:
        got = [unpack_u64(b) for b in t.column("keys").to_pylist()]
        doc = np.concatenate([unpack_ints(b) for b in t.column("docs").to_pylist()])
        many = np.concatenate([np.frombuffer(b, np.uint8) for b in t.column("many").to_pylist()])
        distinct, where = np.unique(np.concatenate(got), return_inverse=True)
        lo, hi, any_many = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min), np.zeros(len(distinct), np.uint8)
        np.minimum.at(lo, where, doc)
        np.maximum.at(hi, where, doc)
        np.maximum.at(any_many, where, many)
        several = ((lo != hi) | (any_many > 0)).astype(np.uint8)
        split = np.split(where, np.cumsum([len(g) for g in got])[:-1])
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "many": pa.array([several[w].tobytes() for w in split], pa.binary()), "docs": pa.array([pack_ints(np.where(several[w] > 0, lo[w], 0)) for w in split], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        ids = left.column("doc_id").to_pylist()
        found = (np.frombuffer(b"".join(right.column("many").to_pylist()), np.uint8), np.concatenate([np.empty(0, np.int64), *map(unpack_ints, right.column("docs").to_pylist())]))
        digest = _distinct(ids, left.column("text"), least)[0]
        out = fn(left, repeated(ids, left.column("text"), digest, found, least))
        del digest, found
        given_back()
        return out

    slim = blocked.select("doc_id", "text", name)  # the columns of passages(), whose shuffle is then used twice
    sent = slim.groupBy(name).applyInArrow(keys, "block int, bucket int, keys binary, docs binary, many binary")
    told = sent.groupBy("bucket").applyInArrow(owners, "block int, bucket int, many binary, docs binary")
    return blocked.groupBy(name).cogroup(told.groupBy("block")).applyInArrow(finish, schema)


def passages(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start, stop, first_doc_id, is_first, n_chars, n_words: every passage that stands in several documents, in code points."""

    def fn(t: pa.Table, spans: list[list[tuple[int, int, int]]]) -> pa.Table:
        flat = [(d, a, b, f, x[a:b]) for d, x, of in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), spans, strict=True) for a, b, f in of]
        col = lambda i, kind: pa.array([r[i] for r in flat], kind)
        return pa.table({"doc_id": col(0, pa.int64()), "start": col(1, pa.int64()), "stop": col(2, pa.int64()), "first_doc_id": col(3, pa.int64()), "is_first": pa.array([r[0] == r[3] for r in flat], pa.bool_()), "n_chars": pa.array([r[2] - r[1] for r in flat], pa.int64()), "n_words": pa.array([len(r[4].split()) for r in flat], pa.int64())})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(docs, fn, "doc_id long, start long, stop long, first_doc_id long, is_first boolean, n_chars long, n_words long", least)


def dedup(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The documents without the passages that a smaller doc_id keeps; rows and columns stay, n_chars follows the text where it is there."""
    names = docs.columns

    def fn(t: pa.Table, spans: list[list[tuple[int, int, int]]]) -> pa.Table:
        ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
        for k, of in enumerate(spans):
            at, kept = 0, []
            for a, b, f in of:
                if f != ids[k]:
                    kept.append(texts[k][at:a])
                    at = b
            if at:
                texts[k] = "".join([*kept, texts[k][at:]])
        out = t.select(names).set_column(names.index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in names:
            old = t.column("n_chars").to_pylist()
            new = [len(x) if of and x is not None else o for x, of, o in zip(texts, spans, old, strict=True)]
            out = out.set_column(names.index("n_chars"), "n_chars", pa.array(new, t.schema.field("n_chars").type))
        return out

    return _with_spans(docs, fn, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), least)
