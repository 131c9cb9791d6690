"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse as an incremental byte-to-text machine.

Merges are tried by rank, so whether a rule fires depends on what follows only through rules of lower rank that take its
right part first. Following those chains through the merge list gives the sufficient lookahead: the most bytes after a
token's end that can still change it. The encoder holds a buffer, runs BPE over it and emits each token that ends at least
that far before the buffer's end; what was emitted never changes, and the rest alone codes as it does in the whole text.
Memory is bounded by the block and the lookahead, however long a run of letters or a text is.

Defined results: a null text is empty (no token, empty text); special tokens found in a text become their ids, as in the
library; repeated rows, ties and other columns have no effect on a row's result; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from strandloom.llm.common import map_arrow

#: The public byte-level BPE pre-tokenizer pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_CHARS = 1 << 17
CACHE = 300_000
#: Pre-tokens beyond so many bytes go through the windowed transducer; shorter ones are one window.
WINDOW = 4096
#: A pair that no rule merges.
NEVER = (1 << 62, -1)


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """A vocabulary file: ids of byte strings, ranks of pairs of ids, special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_chars()
        raw = {t: bytes(map(to_byte.__getitem__, t)) for t in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in ids.items():
            self.text[i] = raw[t]
        for t, i in self.special.items():
            self.text[i] = t.encode()
        self.decimal = list(map(str, range(len(self.text))))
        self.of_byte = [0] * 256
        for i in ids.values():
            if len(self.text[i]) == 1:
                self.of_byte[self.text[i][0]] = i
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((ids[a], ids[b]), (r, ids[a + b]))
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Longest chain, in bytes, of rules of falling rank each of which can take the right part of the one before."""
        ends: dict[int, list[int]] = {}  # a token and all tokens that close it when it is built by its first rule
        deepest: dict[int, int] = {}  # by left part, over the rules so far
        most = 0
        for (a, b), (_, made) in self.rank.items():
            spine = ends.setdefault(b, [b])
            reach = len(self.text[b]) + max((deepest.get(s, 0) for s in spine), default=0)
            deepest[a] = max(deepest.get(a, 0), reach)
            ends.setdefault(made, [made, *spine])
            most = max(most, reach)
        return most + max(map(len, self.text))

    def merge(self, data: bytes) -> list[int]:
        """BPE of one window: the leftmost pair of lowest rank first."""
        ids, rank = [self.of_byte[b] for b in data], self.rank
        if len(ids) > 64:
            return self._merge_long(ids)
        ranks = [rank.get(pair, NEVER) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) is not NEVER:
            at, made = ranks.index(best), best[1]
            ids[at : at + 2] = [made]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get((ids[at - 1], made), NEVER)
            if at < len(ranks):
                ranks[at] = rank.get((made, ids[at + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list: a window's cost is its length times a logarithm."""
        import heapq

        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if r := rank.get((made, ids[after[i]])):
                    heapq.heappush(heap, (r[0], i, made, ids[after[i]], r[1]))
            if before[i] >= 0 and (r := rank.get((ids[before[i]], made))):
                heapq.heappush(heap, (r[0], before[i], ids[before[i]], made, r[1]))
        return [t for t in ids if t >= 0]


class Transducer:
    """One pre-token as a stream of bytes: push() returns the tokens that can no longer change, finish() the rest."""

    def __init__(self, model: Model) -> None:
        self.model, self.held = model, b""

    def push(self, data: bytes) -> list[int]:
        self.held += data
        if len(self.held) < WINDOW + self.model.lookahead:
            return []
        ids, end, safe = self.model.merge(self.held), 0, len(self.held) - self.model.lookahead
        for k, t in enumerate(ids):
            if end + len(self.model.text[t]) > safe:
                break
            end += len(self.model.text[t])
        self.held = self.held[end:]
        return ids[:k]

    def finish(self) -> list[int]:
        held, self.held = self.held, b""
        return self.model.merge(held) if held else []


class Run:
    """A pre-token that has filled most of a block, as an open stream: letters, digits, signs or white space."""

    def __init__(self, model: Model, last: str) -> None:
        kind = next(k for k in (r"\s", r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]") if regex.match(k, last))
        self.blank, self.more, self.bytes = kind == r"\s", regex.compile(f" ?{kind}*+"), Transducer(model)
        self.kept = ""

    def push(self, text: str) -> tuple[list[int], str, bool]:
        """(final ids, text beyond the run, whether the run has ended)."""
        text, self.kept = self.kept + text, ""
        end = self.more.match(text).end()
        self.more = regex.compile(self.more.pattern.removeprefix(" ?"))  # a blank may stand at the start of the run alone
        if self.blank and end:  # the last of white space belongs to what follows, if anything does
            if end == len(text):
                end, self.kept = end - 1, text[-1]
            else:
                end -= 1
        ids = [i for k in range(0, end, WINDOW) for i in self.bytes.push(text[k : min(end, k + WINDOW)].encode("utf-8", "surrogatepass"))]
        if end + len(self.kept) == len(text):
            return ids, "", False
        return ids + self.bytes.finish(), text[end:], True

    def finish(self) -> list[int]:
        """The text ends here."""
        return self.bytes.push(self.kept.encode()) + self.bytes.finish()


class Encoder:
    """Texts to ids, block by block. Cached pieces are (ids as bytes); the cache is bounded."""

    def __init__(self, path: str) -> None:
        self.model = Model(path)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.model.special, key=len, reverse=True)))) if self.model.special else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of one whole pre-token."""
        out = self.words.get(word)
        if out is None:
            data = word.encode("utf-8", "surrogatepass")
            if len(data) > 64:
                t = Transducer(self.model)
                ids = [i for k in range(0, len(data), WINDOW) for i in t.push(data[k : k + WINDOW])] + t.finish()
                return np.array(ids, "<u4").tobytes()
            if len(self.words) >= CACHE:
                self.words.clear()
            out = self.words[word] = np.array(self.model.merge(data), "<u4").tobytes()
        return out

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a blank and a piece that neither starts nor ends with white space: its pre-tokens are its own."""
        if not piece or piece[0].isspace() or piece[-1].isspace() or len(piece) > 64:
            return None
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        out = self.pieces[piece] = b"".join(map(self._word, self.pattern.findall(" " + piece)))
        return out

    def _closed(self, text: str) -> bytes:
        """Ids of text that starts and ends at pre-token borders.

        There is always a border before the blank of a piece that starts with no white space. Stretches of pieces that
        can't be cached are cut by the pattern.
        """
        first, *pieces = text.split(" ")
        known, out, rest = self.pieces, [], [first]
        for piece in pieces:
            got = known.get(piece)
            if got is None:
                got = self._piece(piece)
            if got is None:
                rest = [*rest, piece] if rest else ["", piece]
                continue
            if rest:
                out.extend(map(self._word, self.pattern.findall(" ".join(rest))))
                rest = []
            out.append(got)
        if rest:
            out.extend(map(self._word, self.pattern.findall(" ".join(rest))))
        return b"".join(out)

    def _plain(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """Text without special strings. What follows can still change the end of a block, so that is held back."""
        held, run = "", None
        for block in blocks:
            held += block
            if run is not None:
                ids, held, ended = run.push(held)
                yield np.array(ids, "<u4").tobytes()
                if not ended:
                    continue
                run = None
            cut = held.rfind(" ")
            while cut > 0 and (held[cut - 1].isspace() or cut + 1 >= len(held) or held[cut + 1].isspace()):
                cut = held.rfind(" ", 0, cut)
            if cut > 0:
                yield self._closed(held[:cut])
                held = held[cut:]
            if len(held) > BLOCK_CHARS // 2:
                spans = [m.span() for m in self.pattern.finditer(held)]
                if spans[-1][1] - spans[-1][0] > BLOCK_CHARS // 4:  # a run of one class that may go on
                    cut, run = spans[-1][0], Run(self.model, held[-1])
                elif len(spans) > 3:  # contractions and white space look ahead by no more than this
                    cut = spans[-3][0]
                else:
                    continue
                yield b"".join(self._word(held[a:b]) for a, b in spans if b <= cut)
                held = held[cut:]
        if run is not None:
            ids, held, _ = run.push(held)
            ids += run.finish()
            yield np.array(ids, "<u4").tobytes()
        if held:
            yield self._closed(held)

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Ids in pieces, little-endian unsigned 32 bit."""
        text, at = text or "", 0
        cuts = [(m.start(), m.end(), self.model.special[m[0]]) for m in self.special.finditer(text)] if self.special and any(s in text for s in self.model.special) else []
        for start, end, token in [*cuts, (len(text), len(text), None)]:
            yield from self._plain(text[i : min(i + BLOCK_CHARS, start)] for i in range(at, start, BLOCK_CHARS))
            if token is not None:
                yield np.array([token], "<u4").tobytes()
            at = end


class Decoder:
    """Ids to text: each id gives its bytes, the UTF-8 machine holds at most three of them back."""

    def __init__(self, model: Model) -> None:
        self.text, self.machine = model.text, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join(map(self.text.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int) of every text."""

    def fn(cols: dict[str, list]) -> dict[str, list]:
        code = encoder(tokenizer)
        return {"doc_id": cols["doc_id"], "ids": [np.frombuffer(b"".join(code.encode(t)), "<u4").astype(np.int32).tolist() for t in cols["text"]]}

    return map_arrow(docs.select("doc_id", "text"), fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids are an empty text."""

    def fn(cols: dict[str, list]) -> dict[str, list]:
        out = []
        for ids in cols["ids"]:
            d = Decoder(encoder(tokenizer).model)
            out.append(d.push(ids or []) + d.finish())
        return {"doc_id": cols["doc_id"], "text": out}

    return map_arrow(coded.select("doc_id", "ids"), fn, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, digests fed block by block."""

    def fn(cols: dict[str, list]) -> dict[str, list]:
        code = encoder(tokenizer)
        decimal = code.model.decimal.__getitem__
        counts, coded, back = [], [], []
        for text in cols["text"]:
            n, of_ids, of_text, d = 0, hashlib.sha256(), hashlib.sha256(), Decoder(code.model)
            for block in code.encode(text):
                if block:
                    ids = np.frombuffer(block, "<u4").tolist()
                    of_ids.update(("," * bool(n) + ",".join(map(decimal, ids))).encode())
                    of_text.update(d.push(ids).encode())
                    n += len(ids)
            of_text.update(d.finish().encode())
            counts.append(n), coded.append(of_ids.hexdigest()), back.append(of_text.hexdigest())
        return {"doc_id": cols["doc_id"], "n_tokens": counts, "ids_sha256": coded, "decoded_sha256": back}

    return map_arrow(docs.select("doc_id", "text"), fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
