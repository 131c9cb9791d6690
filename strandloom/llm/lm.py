"""Language-model scores by deleted interpolation of uniform, unigram and bigram maximum-likelihood estimates.

log10 P(w | h) = log10(l0(b) / (V + 1) + l1(b) c(w) / N + l2(b) c(h w) / c(h)), b being the bucket of the context's frequency
(its bit length). The weights of each bucket are learned by expectation-maximisation on one fold of the training documents,
with that fold's counts deleted from the estimates; the scores use the counts of all training documents.

Blocks of documents send their distinct unigrams and bigrams (64-bit hashes, with counts) to buckets; the buckets add up
over all blocks and answer in the same order, so each key travels once for each block that holds it, not for each token.
EM sees a histogram of held-out tokens over (context bucket, rounded log ratios): at most some 10^5 cells, whatever the
corpus; counts and scores are exact but for n-grams whose 64-bit hashes collide.

Defined results: a null text is empty and has the end token alone; a null doc_id is a training document; rows that share a
doc_id each count and are scored each; without training documents every count is 0; without held-out tokens the weights
are DEFAULT; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import RUN, bucket_cuts, crc_mod, expanded, given_back, mix, pack_counts, pack_ints, pack_narrow, pack_u64, scan_parts, squeezed, unpack_counts, unpack_ints, unpack_narrow, unpack_u64, word_hashes, written

END = np.uint64(0x656E64)
BLOCKS_A_PART = 6
DEFAULT = (0.1, 0.5, 0.4)
LEAST_WEIGHT = 1e-5
STEPS, GRID = 60, 4.0


def keys_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unigram keys, bigram keys of each token with the one before, tokens of each text); the first token's context is the end."""
    h, n = word_hashes(data, bounds)
    flat = np.insert(h, np.cumsum(n), END)
    before = np.concatenate([[END], flat])[: len(flat)]  # a text's first token follows another text's end
    return mix(flat), mix(before * RUN + flat + np.uint64(1)), n + 1


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, the place of each key among them): np.unique in half its memory."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    places = np.empty(len(keys), np.int32)
    places[order] = np.cumsum(first, dtype=np.int32) - 1
    return keys[first], places


def _distinct(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: sorted distinct keys, training counts, counts in the deleted fold, and where each token's unigram and bigram stand; tokens of each text."""
    uni, bi, n = keys_of(*expanded(t.column("text").to_pylist()))
    fold = np.repeat(t.column("fold").to_numpy(), n)
    keys_1, uni = _places(uni)
    keys_2, bi = _places(bi)
    keys, place = _places(np.concatenate([keys_1, keys_2]))
    uni, bi = place[: len(keys_1)][uni], place[len(keys_1) :][bi]
    count = lambda mask: np.bincount(uni[mask], minlength=len(keys)) + np.bincount(bi[mask], minlength=len(keys))
    return keys, count(fold >= 0), count(fold == 1), uni, bi, n


def counted(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, fold, n, and packed counts of each token: c1, c2; and one row for each block, fold null,
    whose n is the number of word types it answers for and whose c1 holds its cells for EM: those of the tokens of its
    deleted documents, by counts without the deleted fold.

    fold: -1 held out, 0 training, 1 training and deleted for EM.
    """
    parts = BLOCKS_A_PART * scan_parts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocked = squeezed(docs.select("doc_id", "text", "fold")).select("doc_id", "text", "fold", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("block"))  # by text too: null and repeated ids are many blocks

    def send(t: pa.Table) -> pa.Table:
        given_back()  # of the group before, here and below
        keys, train, deleted, uni, _, _ = _distinct(t)
        single = np.zeros(len(keys), np.int64)
        single[uni] = 1
        edge = bucket_cuts(keys, parts)
        full = np.flatnonzero(np.diff(edge)).tolist()
        col = lambda f, x: pa.array([f(x[edge[b] : edge[b + 1]]) for b in full], pa.binary())
        return pa.table({"block": pa.array([t.column("block")[0].as_py()] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()), "keys": col(pack_u64, keys), "train": col(pack_counts, train * 2 + single), "deleted": col(pack_counts, deleted)})

    def add(t: pa.Table) -> pa.Table:
        given_back()
        got = [unpack_u64(b) for b in t.column("keys").to_pylist()]
        keys, where = _places(np.concatenate(got))
        train = np.concatenate([unpack_counts(b) for b in t.column("train").to_pylist()])
        total = np.bincount(where, train >> 1, len(keys)).astype(np.int64)
        deleted = np.concatenate([unpack_counts(b) for b in t.column("deleted").to_pylist()])
        fold = np.bincount(where, deleted, len(keys)).astype(np.int64)
        first = np.full(len(keys), len(where))
        np.minimum.at(first, where, np.arange(len(where)))
        told = (first[where] == np.arange(len(where))) & (train & 1 > 0) & (total[where] > 0)  # each word type is answered for once
        split = np.cumsum([len(g) for g in got])[:-1]
        col = lambda parts: pa.array([pack_counts(p) for p in parts], pa.binary())
        asked = [w[d > 0] for w, d in zip(np.split(where, split), np.split(deleted, split), strict=True)]  # only a block with deleted tokens of a key needs its count in the fold
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "total": col(np.split(total[where] * 2 + told, split)), "fold_total": col(fold[w] for w in asked)})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        given_back()
        right = right.sort_by("bucket")
        total = np.concatenate([unpack_counts(b) for b in right.column("total").to_pylist()])
        _, _, deleted, uni, bi, n = _distinct(left)
        count = total >> 1
        rest = count.copy()
        rest[deleted > 0] -= np.concatenate([unpack_counts(b) for b in right.column("fold_total").to_pylist()])
        folds, ends = left.column("fold").to_pylist(), np.cumsum(n)
        told = np.repeat(left.column("fold").to_numpy(), n) == 1
        cells = cells_of(rest[uni][told], rest[bi][told])
        spans = list(zip((ends - n).tolist(), ends.tolist(), strict=True))
        col = lambda at: [pack_narrow(count[at[a:b]]) for a, b in spans]
        out = {"doc_id": left.column("doc_id").to_pylist(), "fold": folds, "n": n.tolist(), "c1": col(uni), "c2": col(bi)}
        types = {"doc_id": left.schema.field("doc_id").type, "fold": pa.int32(), "n": pa.int64()}
        last = {"n": int((total & 1).sum()), "c1": pack_ints(cells.T.ravel())}
        return pa.table({k: pa.array([*v, last.get(k)], types.get(k, pa.binary())) for k, v in out.items()})

    sent = blocked.groupBy("block").applyInArrow(send, "block int, bucket int, keys binary, train binary, deleted binary")
    answered = sent.groupBy("bucket").applyInArrow(add, "block int, bucket int, total binary, fold_total binary")
    return blocked.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, fold int, n long, c1 binary, c2 binary")


def buckets_of(context: np.ndarray) -> np.ndarray:
    """Bit length of a context's count."""
    return np.frexp(context.astype(np.float64))[1]


def contexts(c1: np.ndarray) -> np.ndarray:
    """Counts of the contexts: the token before; the end, which is the last token, before the first."""
    return np.concatenate([c1[-1:], c1[:-1]])


def expectation_maximisation(cells: list[tuple[int, int, int, int]], n: int, v: int) -> np.ndarray:
    """Weights (bucket, 3) from cells (bucket, rounded log of c2 / c(h), rounded log of c1, tokens); NONE is a zero count."""
    weights = np.tile(np.array(DEFAULT), (64, 1))
    weights[0] = [DEFAULT[0], 1 - DEFAULT[0], 0]
    if cells:
        b, q2, q1, k = np.array(cells, np.int64).T
        f = np.stack([np.full(len(b), 1 / (v + 1)), np.where(q1 == NONE, 0, 2.0 ** (q1 / GRID) / max(n, 1)), np.where(q2 == NONE, 0, 2.0 ** (q2 / GRID))], axis=1)
        for _ in range(STEPS):
            part = weights[b] * f
            part *= (k / part.sum(axis=1))[:, None]
            new = np.stack([np.bincount(b, part[:, i], 64) for i in range(3)], axis=1)
            seen = new.sum(axis=1) > 0
            weights[seen] = new[seen] / new[seen].sum(axis=1, keepdims=True)
    weights = np.maximum(weights, LEAST_WEIGHT)
    weights[0, 2] = 0  # a context never seen has no bigrams
    return weights / weights.sum(axis=1, keepdims=True)


NONE = -(10**6)


def cells_of(c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """(cells, 4): context bucket, rounded log of c2 / c(h), rounded log of c1, tokens. The tokens are those of whole texts, so each first one follows an end."""
    ch = contexts(c1)
    with np.errstate(divide="ignore", invalid="ignore"):
        q2 = np.where(c2 > 0, np.rint(GRID * np.log2(c2 / np.maximum(ch, 1))), NONE)
        q1 = np.where(c1 > 0, np.rint(GRID * np.log2(c1)), NONE)
    found, count = np.unique(np.stack([buckets_of(ch), q2, q1], axis=1).astype(np.int64), axis=0, return_counts=True)
    return np.column_stack([found, count])


def learned(codes: DataFrame, n: int, v: int) -> np.ndarray:
    """The weights, from the deleted fold; the driver receives a histogram of bounded size."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("c1").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in unpack_ints(packed).reshape(4, -1)], names=["b", "q2", "q1", "k"])

    found = codes.where("fold is null").select("c1").mapInArrow(cells, "b long, q2 long, q1 long, k long").groupBy("b", "q2", "q1").agg(F.sum("k").alias("k"))
    return expectation_maximisation([tuple(r) for r in found.collect()], n, v)


def score(docs: DataFrame, held_out: int = 2, folds: int = 7, deleted: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (this model), both log10 of the text's probability.

    Training documents are those whose crc32(doc_id as text) mod folds is not held_out; of them, those with `deleted` serve EM.
    """
    rest = F.coalesce(crc_mod("doc_id", folds), F.lit(-1))
    fold = F.when(rest == held_out, -1).when(rest == deleted, 1).otherwise(0).cast("int")
    codes = written(counted(docs.select("doc_id", "text", fold.alias("fold"))))
    sums = codes.agg(*(F.sum(F.when(F.expr(e), F.col("n")).otherwise(0)).alias(k) for k, e in (("n", "fold >= 0"), ("rest", "fold = 0"), ("v", "fold is null")))).first()
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)
    weights = learned(codes, int(sums["rest"] or 0), v)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, base, own = [], [], []
            for a, b, tokens in zip(batch.column("c1").to_pylist(), batch.column("c2").to_pylist(), batch.column("n").to_pylist(), strict=True):
                c1, c2 = unpack_narrow(a, tokens), unpack_narrow(b, tokens)
                ch = contexts(c1)
                w = weights[buckets_of(ch)]
                known.append(int((c1 > 0).sum()))
                base.append(float(np.log10((c1 + 1) / (n + v + 1)).sum()))
                own.append(float(np.log10(w[:, 0] / (v + 1) + w[:, 1] * c1 / max(n, 1) + w[:, 2] * c2 / np.maximum(ch, 1)).sum()))
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f == -1 for f in batch.column("fold").to_pylist()], pa.bool_()), batch.column("n"), pa.array(known, pa.int64()), pa.array([n] * k, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return codes.where("fold is not null").mapInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
