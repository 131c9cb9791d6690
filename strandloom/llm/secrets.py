"""Secret scans: patterned secrets, and a token-efficiency test for random strings.

Prose has long tokens under a public vocabulary, random strings short ones: a candidate whose characters per token stay
under a limit is reported, after known digests (those the caller lists, and those that a name such as sha256 or commit stands
before) and identifiers (UUIDs, dates, words with long tokens) are set aside. Candidates have 16 characters or more, of letters or
of digits alone 20: shorter words of prose and card numbers can have as few characters for a token.

Defined results: null and empty texts have no span; a text is scanned whole, however long; repeated rows each get their
spans; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import accumulate

from pyspark.sql import DataFrame

from strandloom.llm.common import map_arrow

#: The base patterns. Only A-Z and a-z fold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: A candidate of the efficiency test has MIN_CHARS characters, or LEAST_ALONE of letters or of digits alone.
MIN_CHARS, LEAST_ALONE, MAX_RATIO = 16, 20, 2.2
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
#: Names that tell that a digest follows, at the end of the text before a candidate or at a candidate's start.
NAMED = re.compile(r"""(?:sha-?\d{0,3}|md5|crc-?32|blake\w{0,2}|checksum|digest|etag|commit|integrity|fingerprint)["']?\x20?[:=_-]?\x20?["']?\Z""", re.IGNORECASE)
NAMED_START = re.compile(r"(?:sha-?\d{0,3}|md5|crc-?32|blake\w{0,2}|checksum|digest|etag|commit|integrity|fingerprint)[=_-]", re.IGNORECASE)
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
IDENTIFIER = re.compile(r"(?:[A-Za-z]{2,}\d{0,4}|\d{1,8}(?=[_/+=-]))(?:[_/+=-]+(?:[A-Za-z]{2,}\d{0,4}|\d{1,8}))*[_/+=-]*\Z")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_codings: dict[str, object] = {}


def coding(path: str):
    """A tiktoken encoding from a file of ranks."""
    if path not in _codings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _codings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _codings[path]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterned secrets, in code points; matches that are too short are passed over whole."""
    spans = [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def of_words(s: str, path: str, max_ratio: float) -> bool:
    """Whether s is an identifier whose words have long tokens themselves."""
    if not IDENTIFIER.match(s):
        return False
    found = WORD.findall(s)
    if not found:  # numbers between marks
        return True
    return sum(map(len, found)) >= max_ratio * sum(len(coding(path).encode_ordinary(w)) for w in found)


def is_known(text: str, start: int, s: str, known: frozenset[str]) -> bool:
    """Whether a candidate is a digest that the caller knows or that its name stands before."""
    return s.lower() in known or bool(NAMED_START.match(s)) or bool(NAMED.search(text[max(0, start - 24) : start]))


def random_spans(text: str, path: str, max_ratio: float = MAX_RATIO, known: frozenset[str] = frozenset()) -> list[tuple[int, str, int]]:
    """Strings whose characters per token are under max_ratio and that are neither known digests nor identifiers."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if len(s) < LEAST_ALONE and (s.isalpha() or s.isdigit()):
            continue
        if len(s) < max_ratio * len(coding(path).encode_ordinary(s)) and not UUID.match(s) and not of_words(s, path, max_ratio) and not is_known(text, m.start(), s, known):
            out.append((m.start(), "random", m.end()))
    return out


def uncovered(span: tuple[int, str, int], base: list[tuple[int, str, int]], text: str, path: str) -> list[tuple[int, str, int]]:
    """What base spans leave of a random string; marks alone and single words of one token, such as a name before a password, are none."""
    at, out = span[0], []
    for a, _, b in [*sorted(base), (span[2], "", span[2])]:
        stop = min(a, span[2])
        if at < stop:
            out.append((at, stop))
        at = max(at, b)
    if out == [(span[0], span[2])]:
        return [span]
    kept = []
    for a, b in out:
        piece = text[a:b].strip("_/+=-")
        if piece and not (piece.isalpha() and len(coding(path).encode_ordinary(piece)) == 1):
            kept.append((a, span[1], b))
    return kept


def all_spans(text: str | None, path: str, known: frozenset[str] = frozenset()) -> tuple[list, list]:
    """(base spans, all spans); what a base span covers of a random string is not told twice."""
    if not text:
        return [], []
    base, more, lo = base_spans(text), [], 0
    reach = list(accumulate((s[2] for s in base), max))  # the furthest end so far: what ends before a random string is passed over for good
    for r in random_spans(text, path, known=known):
        while lo < len(base) and reach[lo] <= r[0]:
            lo += 1
        met, k = [], lo
        while k < len(base) and base[k][0] < r[2]:
            met += [base[k]] if base[k][2] > r[0] else []
            k += 1
        more += uncovered(r, met, text, path)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, tokenizer: str, known: frozenset[str] = frozenset()) -> DataFrame:
    """known: digests, in lower-case hex, that are no secrets. doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans (kind:start:end, comma-joined)."""

    def fn(cols: dict[str, list]) -> dict[str, list]:
        found = [all_spans(t, tokenizer, known) for t in cols["text"]]
        count = {f"n_{k}": [sum(s[1] == k for s in spans) for _, spans in found] for k in KINDS}
        return {"doc_id": cols["doc_id"], **count, "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(s) for _, s in found]}

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return map_arrow(docs.select("doc_id", "text"), fn, schema)


def redact(docs: DataFrame, tokenizer: str, mark: str = "[SECRET]", known: frozenset[str] = frozenset()) -> DataFrame:
    """The documents with each span replaced by mark; columns and rows stay, n_chars follows the text where it is there."""

    def fn(cols: dict[str, list]) -> dict[str, list]:
        for i, text in enumerate(cols["text"]):
            spans = all_spans(text, tokenizer, known)[1]
            if not spans:
                continue
            out, at = [], 0
            for a, _, b in spans:
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            cols["text"][i] = "".join([*out, text[at:]])
            if "n_chars" in cols:
                cols["n_chars"][i] = len(cols["text"][i])
        return cols

    return map_arrow(docs, fn, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
