"""Media columns: AVI motion-JPEG as bytes in a column, to timed clips.

Writing: a payload becomes 8-bit grey frames of 16 x 16 blocks, each block flat at one payload byte. Quantised by 8, its DC
coefficient is that byte less 128 exactly, so baseline JPEG stores it without loss. The Huffman tables give a difference of
category s a code of 9 - s bits, so every block takes ten bits with its end-of-block code, and a frame is coded and decoded
by whole-array operations. Reading: RIFF chunks and the idx1 index give the frames, each is decoded as a JPEG intra frame to
the pixels of its first component (any baseline grey or colour file, with restart intervals too), and shots are cut where the
difference of neighbouring frames' histograms stands out of the differences before it. Frames with this module's own header
hold flat blocks of even code length, so their pixels are known from the blocks, which decode together as arrays.

Defined results: a null text is empty; an empty text is one block of 64 zero bytes; equal texts give equal bytes; frames may
differ in size; a frame that can't be decoded (cut short, not baseline, no JPEG) counts as equal to the one before; a file
without a frame that can be decoded, and bytes that are no AVI file, give no clips; repeated rows and other columns change
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import map_arrow

SIDE, FRAME_BYTES, FPS = 16, 256, 25


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header() -> bytes:
    """Start of every frame: quantisation by 8, one grey component, and tables with one DC code of each length 1 to 9 (categories 8 to 0) and the end-of-block code alone."""
    dqt = _segment(0xDB, bytes([0]) + bytes([8] * 64))
    sof = _segment(0xC0, struct.pack(">BHHB", 8, 8 * SIDE, 8 * SIDE, 1) + bytes([1, 0x11, 0]))
    dc = _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    ac = _segment(0xC4, bytes([0x10] + [1] + [0] * 15) + bytes([0]))
    sos = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + dqt + sof + dc + ac + sos


HEADER = _header()
_diff = np.arange(-255, 256)
_cat = np.array([int(abs(d)).bit_length() for d in _diff])
_code = np.array([((1 << (8 - s)) - 1) << 1 if s < 9 else 0 for s in _cat])  # 8-s ones, then a zero
TO_BITS = ((_code << _cat | np.where(_diff < 0, _diff + (1 << _cat) - 1, _diff)) << 1).astype(np.uint16)
FROM_BITS = np.full(1024, 999, np.int16)
FROM_BITS[TO_BITS] = _diff
_SHIFTS = np.arange(9, -1, -1, dtype=np.uint16)
_POWERS = (1 << _SHIFTS).astype(np.uint16)


def frames_of(payload: np.ndarray) -> list[bytes]:
    """JPEG frames of a payload of bytes, FRAME_BYTES in each, the last filled up with zeros."""
    out = []
    for at in range(0, len(payload), FRAME_BYTES << 10):  # bounded memory for very long payloads
        part = payload[at : at + (FRAME_BYTES << 10)]
        grid = np.zeros((-(-len(part) // FRAME_BYTES), FRAME_BYTES), np.int16)
        grid.reshape(-1)[: len(part)] = part
        bits = TO_BITS[np.diff(grid, axis=1, prepend=np.int16(128)) + 255]
        coded = np.packbits((bits[:, :, None] >> _SHIFTS & 1).astype(np.uint8).reshape(len(grid), -1), axis=1)
        out += [HEADER + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in coded]
    return out


def avi(payload: bytes) -> bytes:
    """An AVI file of motion-JPEG frames; the payload's length stands in an INFO chunk."""
    frames = frames_of(np.frombuffer(payload, np.uint8))
    side = 8 * SIDE
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, 0, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    body = b"AVI " + hdrl + info + chunk(b"LIST", b"movi" + b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


# --- reading ----------------------------------------------------------------------------------------------------------


def chunks(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(tag, start, end) of the RIFF chunks in a range; cut short where the file is."""
    while start + 8 <= end:
        tag, n = bytes(data[start : start + 4]), struct.unpack_from("<I", data, start + 4)[0]
        yield tag, start + 8, min(start + 8 + n, end)
        start += 8 + n + n % 2


def riff(data: bytes) -> dict:
    """Frame ranges by the idx1 index (by the movi list where there is none), frames per second, payload length where told."""
    view, out = memoryview(data), {"frames": [], "fps": float(FPS), "payload": None}
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return out
    movi, index = None, []
    for tag, a, b in chunks(view, 12, len(data)):
        kind = bytes(view[a : a + 4]) if tag == b"LIST" else b""
        if kind == b"hdrl":
            for t, x, _ in chunks(view, a + 4, b):
                if t == b"avih" and x + 4 <= len(data) and (us := struct.unpack_from("<I", view, x)[0]):
                    out["fps"] = 1e6 / us
        elif kind == b"INFO":
            for t, x, y in chunks(view, a + 4, b):
                if t == b"ICMT" and bytes(view[x : x + 8]) == b"payload=":
                    told = bytes(view[x + 8 : y]).rstrip(b"\0")
                    out["payload"] = int(told) if told.isdigit() else None
        elif kind == b"movi":
            movi = (a, b)
        elif tag == b"idx1":
            index = [struct.unpack_from("<4sIII", view, k) for k in range(a, b - 15, 16)]
    if movi and index:
        first = index[0][2]
        base = movi[0] if first < movi[0] else 0  # offsets count from the list or from the file
        out["frames"] = [(base + o + 8, base + o + 8 + n) for t, _, o, n in index if t[2:] in (b"dc", b"db")]
    elif movi:
        out["frames"] = [(a, b) for t, a, b in chunks(view, movi[0] + 4, movi[1]) if t[2:] in (b"dc", b"db")]
    return out


#: The order of a block's coefficients: diagonals, up and down in turn.
ZIGZAG = np.array([8 * i + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_u = np.arange(8)
#: Cosine basis, one row for each frequency.
DCT = np.cos((2 * _u[None, :] + 1) * _u[:, None] * np.pi / 16) * np.where(_u[:, None] == 0, np.sqrt(1 / 8), 0.5)


class Bits:
    """The bits of a scan between two restart markers; beyond its end come zeros, up to a limit."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.most = data + bytes(8), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 5], "big") >> (40 - n - (self.at & 7)) & (1 << n) - 1

    def take(self, n: int) -> int:
        out = self.peek(n) if n else 0
        self.at += n
        if self.at > self.most:
            raise ValueError("the frame is cut short")
        return out

    def symbol(self, table: np.ndarray) -> int:
        entry = int(table[self.peek(16)])
        if not entry:
            raise ValueError("no such code")
        self.take(entry >> 8)
        return entry & 255

    def number(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def decode(jpeg: bytes) -> np.ndarray:
    """Pixels (rows, columns) of a baseline JPEG's first component; ValueError if it can't be decoded."""
    try:
        return _decode(jpeg)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("not a whole JPEG") from e


def _decode(jpeg: bytes) -> np.ndarray:
    at, quant, tables, comps, restart, high, wide = 2, {}, {}, [], 0, 0, 0
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while jpeg[at + 1] != 0xDA:
        marker, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + n]
        if jpeg[at] != 0xFF or n < 2:
            raise ValueError("no marker where one belongs")
        if marker == 0xDB:
            while body:
                size = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body, f">u{size}", 64, 1).astype(np.int64)
                body = body[1 + 64 * size :]
        elif marker == 0xC4:
            while body:
                table, code, k = np.zeros(1 << 16, np.uint16), 0, 17
                for length, c in enumerate(body[1:17], 1):
                    for _ in range(c):
                        table[code << 16 - length : code + 1 << 16 - length] = length << 8 | body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = table
                body = body[k:]
        elif marker in (0xC0, 0xC1) and body[0] == 8:
            high, wide = struct.unpack_from(">HH", body, 1)
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        at += 2 + n
    n = struct.unpack_from(">H", jpeg, at + 2)[0]
    sos = jpeg[at + 4 : at + 2 + n]
    chosen = {sos[1 + 2 * i]: (tables[sos[2 + 2 * i] >> 4], tables[0x10 | sos[2 + 2 * i] & 15]) for i in range(sos[0])}
    if not comps or not high or not wide or len(chosen) != len(comps):
        raise ValueError("no frame of one scan")
    runs, data = [], bytearray()
    at += 2 + n
    while True:  # up to the end marker; stuffed zeros go, restart markers part the runs
        k = jpeg.find(b"\xff", at)
        data += jpeg[at : k if k >= 0 else len(jpeg)]
        if k < 0 or k + 1 >= len(jpeg) or jpeg[k + 1] not in (0, *range(0xD0, 0xD8)):
            break
        if jpeg[k + 1]:
            runs.append(Bits(bytes(data)))
            data = bytearray()
        else:
            data.append(255)
        at = k + 2
    runs.append(Bits(bytes(data)))
    one = len(comps) == 1  # a scan of one component is not interleaved
    hm, vm = (1, 1) if one else (max(c[1] for c in comps), max(c[2] for c in comps))
    across, down = -(-wide // (8 * hm)), -(-high // (8 * vm))
    ch, cv = (1, 1) if one else comps[0][1:3]
    grid = np.zeros((down * cv, across * ch, 64), np.int64)
    bits, last = runs[0], {}
    for mcu in range(across * down):
        if mcu == 0 or restart and mcu % restart == 0:
            bits, last = runs[mcu // restart if restart else 0], dict.fromkeys((c[0] for c in comps), 0)
        for c, hs, vs, _ in comps:
            dc, ac = chosen[c]
            for b in range(1 if one else hs * vs):
                last[c] += bits.number(bits.symbol(dc) & 15)
                first = c == comps[0][0]
                block = grid[mcu // across * cv + b // ch, mcu % across * ch + b % ch] if first else None
                if first:
                    block[0] = last[c]
                k = 1
                while k < 64:
                    rs = bits.symbol(ac)
                    if not rs & 15 and rs != 0xF0:
                        break
                    k += rs >> 4
                    v = bits.number(rs & 15)
                    if first and rs & 15:
                        block[k] = v
                    k += 1
    flat = np.zeros_like(grid)
    flat[:, :, ZIGZAG] = grid * quant[comps[0][3]]
    pixels = DCT.T @ flat.reshape(*grid.shape[:2], 8, 8) @ DCT + 128
    whole = np.rint(pixels).clip(0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(down * cv * 8, across * ch * 8)
    return whole[: -(-high * cv // vm), : -(-wide * ch // hm)]


def own_blocks(raw: list[bytes]) -> np.ndarray:
    """Levels of the flat blocks, FRAME_BYTES for each of the frames with this module's header."""
    out = [np.zeros((0, FRAME_BYTES), np.uint8)]
    for at in range(0, len(raw), 1024):
        scans = b"".join(f[len(HEADER) : -2].replace(b"\xff\x00", b"\xff") for f in raw[at : at + 1024])
        bits = np.unpackbits(np.frombuffer(scans, np.uint8)).reshape(-1, FRAME_BYTES, 10)
        out.append((FROM_BITS[bits @ _POWERS].astype(np.int32).cumsum(axis=1) + 128).astype(np.uint8))
    return np.concatenate(out)


def histograms(grey: np.ndarray) -> np.ndarray:
    """Shares of 16 grey levels in each row of pixels, or of blocks that are flat and of one size."""
    level = (np.arange(len(grey))[:, None] * 16 + (grey.astype(np.int64) >> 4)).ravel()
    return np.bincount(level, minlength=16 * len(grey)).reshape(-1, 16) / max(1, grey.shape[1])


def frame_histograms(raw: list[bytes]) -> np.ndarray:
    """One row for each frame, from the first that can be decoded on; one that can't repeats the row before."""
    rows: list[np.ndarray] = []
    for f in raw:
        try:
            rows.append(histograms(decode(f).reshape(1, -1))[0])
        except ValueError:
            if rows:
                rows.append(rows[-1])
    return np.array(rows).reshape(-1, 16)


def shots(hist: np.ndarray, sigma: float = 3.0, least: float = 0.25, window: int = 12) -> list[tuple[int, int]]:
    """[start, end) of the shots of frames' histograms. A cut lies where the difference of two (0 to 1) is at least `least` and
    beyond the mean by sigma standard deviations of the `window` differences before it."""
    n = len(hist)
    if n < 2:
        return [(0, n)] if n else []
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    s1, s2 = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff**2)])
    k = np.arange(len(diff))
    lo = np.maximum(0, k - window)
    m = np.maximum(1, k - lo)
    mean = (s1[k] - s1[lo]) / m
    sd = np.sqrt(np.maximum(0, (s2[k] - s2[lo]) / m - mean**2))
    cuts = (np.flatnonzero((diff >= least) & (diff > mean + sigma * sd)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n], strict=True))


def payload_of(text: str | None) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def describe(data: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    """(payload read back, clips in milliseconds) of one file; only files of this module have a payload."""
    index = riff(data)
    raw = [data[a:b] for a, b in index["frames"]]
    if raw and index["payload"] is not None and all(f.startswith(HEADER) for f in raw):
        grey = own_blocks(raw)
        stored, hist, late = grey.tobytes()[: index["payload"]], histograms(grey), 0
    else:
        stored, hist = b"", frame_histograms(raw)
        late = len(raw) - len(hist)  # frames before the first that can be decoded
    return stored, [(1000 * (a + late) / index["fps"], 1000 * (b + late) / index["fps"]) for a, b in shots(hist)]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as an AVI file in a binary column."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), lambda c: {"doc_id": c["doc_id"], "media": [avi(payload_of(t)) for t in c["text"]]}, f"doc_id {kind}, media binary")


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_ms, end_ms: a row for each shot of each file; null media has none."""

    def fn(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "clips": [[{"start_ms": a, "end_ms": b} for a, b in (describe(m)[1] if m else [])] for m in cols["media"]]}

    kind = media.schema["doc_id"].dataType.simpleString()
    found = map_arrow(media.select("doc_id", "media"), fn, f"doc_id {kind}, clips array<struct<start_ms double, end_ms double>>")
    return found.select("doc_id", F.posexplode("clips").alias("clip", "at")).select("doc_id", "clip", "at.start_ms", "at.end_ms")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256 (read back), tail_crc32, media_bytes, media_sha256, feature (clip ends in ms)."""

    def fn(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for text in cols["text"]:
            data = avi(payload_of(text))
            back, found = describe(data)
            for k, v in zip(out, (len((text or "").encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"clips={len(found)};" + ",".join(f"{b:.0f}" for _, b in found)), strict=True):
                out[k].append(v)
        return {"doc_id": cols["doc_id"], **out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(docs.select("doc_id", "text"), fn, schema)
