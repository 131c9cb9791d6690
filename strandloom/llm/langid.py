"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text's UTF-8 bytes are cut into windows that overlap; in each a forward and a backward GRU read the bytes, and a softmax
over both states labels every position. The MARGIN positions at either end of a window are there for context alone and are
labelled in its neighbours, so every position has read at least so many bytes on both sides. A document's probabilities are
the mean over all its positions. Training takes batches from all windows of whole texts of a bounded sample of labelled
documents (at most `per_lang` of each language, `most_langs` languages and `most_bytes` bytes, chosen by a hash of id and text); prediction reads every byte of every document.

Defined results: null texts and texts without a letter are `und` with score 0; without any labelled document all are `und`;
equal texts get equal results; ties go to the first language in order; other columns are never read; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import crc_mod, free_name, given_back

HIDDEN, CORE, MARGIN, PAD = 8, 96, 16, 256
TRAIN_WINDOW = 64
#: Bounds of the sample that training sees: documents of each language, languages (the most frequent), and bytes of all texts.
PER_LANG, MOST_LANGS, SAMPLE_BYTES = 600, 64, 24 << 20
BATCH, STEPS, RATE = 256, 260, 0.02
UND = "und"


@dataclass
class Net:
    """Parameters: per direction the input table (256 bytes and padding, by gate z, r, n) and the recurrent matrix; then the output layer."""

    langs: list[str]
    p: dict[str, np.ndarray]

    @staticmethod
    def new(langs: list[str], seed: int = 1) -> "Net":
        g, h = np.random.default_rng(seed), HIDDEN
        p = {f"{k}{d}": g.normal(0, s, shape).astype(np.float32) for d in "fb" for k, s, shape in (("W", 0.3, (257, 3 * h)), ("U", 0.3, (h, 3 * h)), ("O", 0.3, (h, len(langs))))}
        return Net(langs, p | {"c": np.zeros(len(langs), np.float32)})


def _run(p: dict[str, np.ndarray], d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, B, H) of one direction over windows x (T, B); `keep` gets what backpropagation needs."""
    h_size, (t_size, b_size) = HIDDEN, x.shape
    table, u = p["W" + d], p["U" + d]
    out = np.empty((t_size, b_size, h_size), np.float32)
    h = np.zeros((b_size, h_size), np.float32)
    for t in range(t_size) if d == "f" else range(t_size - 1, -1, -1):
        gx, gh = table[x[t]], h @ u
        zr = gx[:, : 2 * h_size] + gh[:, : 2 * h_size]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr[:, :h_size], zr[:, h_size:]
        n = r * gh[:, 2 * h_size :]
        n += gx[:, 2 * h_size :]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((t, h, z, r, n, gh[:, 2 * h_size :]))
        h = n + z * (h - n)
        out[t] = h
    return out


def positions(p: dict[str, np.ndarray], x: np.ndarray, keep: dict | None = None, margin: int = 0) -> tuple[np.ndarray, dict]:
    """Probabilities (T, B, languages) of every position but for a margin at both ends."""
    states = {d: _run(p, d, x, None if keep is None else keep.setdefault(d, [])) for d in "fb"}
    inner = slice(margin, len(x) - margin)
    logits = states["f"][inner] @ p["Of"] + states["b"][inner] @ p["Ob"] + p["c"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits, states


def gradients(p: dict[str, np.ndarray], x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the positions that are not padding, and its gradients through time."""
    keep: dict = {}
    prob, states = positions(p, x, keep)
    t_size, b_size = x.shape
    mask = (x != PAD).astype(np.float32)
    total = max(mask.sum(), 1)
    target = prob[:, np.arange(b_size), label]
    loss = float(-(np.log(target + 1e-9) * mask).sum() / total)
    dl = prob * (mask / total)[:, :, None]
    dl[:, np.arange(b_size), label] -= mask / total
    g = {"c": dl.sum(axis=(0, 1))}
    for d in "fb":
        w, u, h_size = p["O" + d], p["U" + d], HIDDEN
        g["O" + d] = states[d].reshape(-1, h_size).T @ dl.reshape(-1, dl.shape[2])
        dout = dl @ w.T
        du, dh = np.zeros_like(u), np.zeros((b_size, h_size), np.float32)
        dgx = np.empty((t_size, b_size, 3 * h_size), np.float32)
        for t, h, z, r, n, ghn in reversed(keep[d]):
            dh = dh + dout[t]
            dan = dh * (1 - z) * (1 - n * n)
            daz = dh * (h - n) * z * (1 - z)
            dar = dan * ghn * r * (1 - r)
            dgx[t] = np.concatenate([daz, dar, dan], axis=1)
            dgh = np.concatenate([daz, dar, dan * r], axis=1)
            du += h.T @ dgh
            dh = dh * z + dgh @ u.T
        g["U" + d] = du
        flat, at = dgx.reshape(-1, 3 * h_size), x.reshape(-1)
        g["W" + d] = np.stack([np.bincount(at, flat[:, k], 257) for k in range(3 * h_size)], axis=1).astype(np.float32)
    return loss, g


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 1) -> Net:
    """Adam over batches with as many windows of each language; windows (n, length) of byte values and PAD."""
    net, rng = Net.new(langs, seed), np.random.default_rng(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    by = [np.flatnonzero(labels == k) for k in range(len(langs))]
    for step in range(1, steps + 1):
        take = np.concatenate([rng.choice(b, BATCH // len(by) + 1) for b in by])
        _, g = gradients(net.p, np.ascontiguousarray(windows[take].T), labels[take])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = RATE * (1 - 0.9 * step / steps)
        for k, v in g.items():
            v = v / max(1.0, norm)
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            net.p[k] = (net.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def windows_of(data: np.ndarray, core: int = CORE, margin: int = MARGIN) -> np.ndarray:
    """All bytes as rows of `core`, with a margin of their neighbours on both sides; PAD where there are none."""
    n = -(-len(data) // core)
    out = np.full(n * core + 2 * margin, PAD, np.int16)
    out[margin : margin + len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(out, core + 2 * margin)[::core][:n] if n else np.empty((0, core + 2 * margin), np.int16)


def pooled(net: Net, texts: list[str], batch: int = 2048) -> np.ndarray:
    """(texts, languages): mean probabilities over all positions of each text."""
    cut = [windows_of(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    rows = np.concatenate(cut) if cut else np.empty((0, CORE + 2 * MARGIN), np.int16)
    total, length = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
    for at in range(0, len(rows), batch):
        x = np.ascontiguousarray(rows[at : at + batch].T)
        prob, _ = positions(net.p, x, margin=MARGIN)
        real = x[MARGIN:-MARGIN] != PAD
        prob *= real[:, :, None]
        summed = prob.sum(axis=0)
        for k in range(len(net.langs)):
            total[:, k] += np.bincount(owner[at : at + batch], summed[:, k], len(texts))
        length += np.bincount(owner[at : at + batch], real.sum(axis=0), len(texts))
    return total / np.maximum(length, 1)[:, None]


def drawn(known: DataFrame, counts: dict[str, int], per_lang: int, most_bytes: int) -> DataFrame:
    """(lang, text) of at most per_lang rows and most_bytes bytes for each language of counts: the rows of smallest hash.

    The hash is of doc_id and text, so rows without or of one doc_id are drawn like all others; equal rows stay or go together, as
    far as the bounds allow. Rows beyond a generous share are left out before the ranking, whose limit each task applies to its own
    rows first; a text longer than most_bytes is not drawn.
    """
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, 2 * (per_lang + 50) / n) * 2**30)))))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    hashed = known.where(F.col("lang").isin(*counts)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"), size.alias("n")).where((F.pmod("h", F.lit(2**30)) < share[F.col("lang")]) & (F.col("n") <= most_bytes))
    order = Window.partitionBy("lang").orderBy("h")
    first = hashed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang)
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("lang", F.coalesce("text", F.lit("")).alias("text"))


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS, most_bytes: int = SAMPLE_BYTES) -> Net | None:
    """A net from labelled documents outside the held-out fold: per_lang of each of the most_langs most frequent languages, and most_bytes of text in all."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.coalesce(crc_mod("doc_id", folds), F.lit(-1)) != held_out))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not counts:
        return None
    texts = sorted((r["lang"], bytes(r["text"])) for r in drawn(known, counts, per_lang, most_bytes // len(counts)).select("lang", F.col("text").cast("binary").alias("text")).collect())
    cut = [windows_of(np.frombuffer(t, np.uint8), TRAIN_WINDOW, 0) for _, t in texts]
    x, label = np.concatenate([np.empty((0, TRAIN_WINDOW), np.int16), *cut]), np.repeat([lang for lang, _ in texts], [len(c) for c in cut])
    if not len(x):
        return None
    langs = sorted(set(label.tolist()))
    return train(x, np.searchsorted(langs, label), langs)


def identify(docs: DataFrame, net: Net | None, keep: list[str], lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The columns `keep` of docs, with the predicted language and its probability under the given names."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"{lang_name} string, {score_name} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(len(keep)).to_pylist()
                lang, score = [UND] * len(texts), [0.0] * len(texts)
                able = [k for k, t in enumerate(texts) if net is not None and t and any(map(str.isalpha, t))]
                if able:
                    prob = pooled(net, [texts[k] for k in able])
                    for k, row in zip(able, prob, strict=True):
                        lang[k], score[k] = net.langs[int(row.argmax())], float(min(1.0, row.max()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, lang_name, score_name])
        given_back()

    return docs.select(*(f"`{c}`" for c in keep), F.col("text").alias(free_name(docs, "text"))).mapInArrow(run, schema)
