"""Clustering, whitening and id files against plain versions, and their edge cases."""

import hashlib
import io
import math
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from strandloom.llm import bitplane, elkan, packing, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, own string"
NAN, INF = float("nan"), float("inf")


def made(n=300, width=64, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (7, width))
    rows = [(i, (base[i % 7] + rng.normal(0, 0.3, width)).astype(np.float32).tolist(), 0, "x", "o") for i in range(n)]
    bad = [(9001, None, 0, "x", "o"), (9002, [], 0, "x", "o"), (9003, [NAN] * 64, 0, "x", "o"), (9004, [None] + [0.0] * 63, 0, "x", "o"), (9005, [INF] + [0.0] * 63, 0, "x", "o"), (9006, [-INF] + [0.0] * 63, 0, "x", "o")]
    return rows + bad + [(None, rows[0][1], None, None, None), (3, rows[3][1], 0, "x", "o"), (3, rows[5][1], 0, "x", "o"), (7777, rows[9][1], 0, "x", "o")]


def plain_clusters(rows, k=16, rounds=3, width=64):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    hashed = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    at = [x for _, x in hashed[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for r in range(rounds + 1):
        own = [min((far(x, c), j) for j, c in enumerate(at)) for _, x in kept]
        if r < rounds:
            for j in range(len(at)):
                mine = [x for (_, x), (_, c) in zip(kept, own) if c == j]
                if mine:
                    at[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted(((i is None, i or 0), x, c, d) for (i, x), (d, c) in zip(kept, own)), at


def test_op11_against_plain_rounds(spark):
    rows = made()
    got, at = elkan.cluster(spark.createDataFrame(rows, SCHEMA))
    want, centers = plain_clusters(rows)
    assert at.tolist() == centers
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], int(r["distance"])) for r in got.collect()) == sorted((i, c, d) for i, _, c, d in want)
    told = elkan.report(spark.createDataFrame(rows, SCHEMA)).collect()
    total = sum(d for *_, d in want)
    assert {r["inertia"] for r in told} == {total} and sum({r["cluster"]: r["cluster_inertia"] for r in told}.values()) == total
    assert {r["cluster"]: r["centroid_sha256"] for r in told}.items() <= dict(enumerate(elkan.digests(at))).items()


def test_bounds_skip_distances_and_keep_ties():
    rng = np.random.default_rng(1)
    base = rng.integers(-400, 400, (8, 64))
    x = base[rng.integers(0, 8, 2000)] + rng.integers(-9, 9, (2000, 64))
    x[:50] = 0
    at = np.vstack([base, base[:1], np.where(np.arange(64) == 0, 5, 0), np.where(np.arange(64) == 0, -5, 0)])  # a copy, and two at one distance of the rows of zeros
    own, upper, lower = np.zeros(2000, np.int64), np.full(2000, np.inf), np.zeros((2000, len(at)))
    before, total = None, 0
    for _ in range(4):
        own, upper, lower, n = elkan.Centroids(at, before).assign(x, own, upper.astype(float), lower)
        total += n
        d2 = ((x[:, None] - at[None]) ** 2).sum(-1)
        assert (own == d2.argmin(axis=1)).all() and (upper.astype(float) ** 2 >= d2[np.arange(2000), own]).all() and (lower**2 <= d2 + 1e-6).all()
        before, at = at, np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else at[j] for j in range(len(at))])
    assert total < 0.5 * 4 * 2000 * len(at) and (own[:50] == own[0]).all()


def test_op11_small_large_and_empty(spark):
    few = [(1, [0.5] * 64, 0, "", ""), (2, [1.5] * 64, 0, "", ""), (3, [3.0e38] * 64, 0, "", ""), (4, [-3.0e38] * 64, 0, "", "")]
    got = {r["vec_id"]: r for r in elkan.report(spark.createDataFrame(few, SCHEMA)).collect()}
    assert len(got) == 4 and all(r["distance"] == 0 for r in got.values()) and len({r["cluster"] for r in got.values()}) == 4
    assert elkan.report(spark.createDataFrame([], SCHEMA)).collect() == [] and elkan.report(spark.createDataFrame(made(10)[10:16], SCHEMA)).collect() == []
    wide = [(i, [float((-1) ** i * 2.0**90)] + [0.0] * 63, 0, "", "") for i in range(20)]
    told = elkan.report(spark.createDataFrame(wide, SCHEMA), k=1).collect()
    assert all(r["distance"] is None and r["inertia"] is None for r in told)  # beyond a long


def test_op13_against_fractions(spark):
    rows = made(60, 5)
    rows = [r for r in rows if r[1] is None or len(r[1]) != 64]
    rows += [(100, [], 0, "", ""), (101, [0.25], 0, "", "")]
    got, fit = whitening.whiten(spark.createDataFrame(rows, SCHEMA), most=16)
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (5 - len(v))) for i, v, *_ in rows if v is not None]
    fits = sorted({tuple(x) for _, x in kept})
    n, sums = len(fits), [sum(c) for c in zip(*fits)]
    cov = [[sum((Fraction(x[i]) - Fraction(sums[i], n)) * (Fraction(x[j]) - Fraction(sums[j], n)) for x in fits) / n for j in range(5)] for i in range(5)]
    assert fit.n == n and np.allclose(np.array(cov, float) @ fit.vectors, fit.vectors * fit.values, rtol=1e-12, atol=1e-9) and fit.identity_error < 1e-9
    out = got.collect()
    assert len(out) == 5 * len(kept)
    by = {}
    for r in out:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    for i, x in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c, r in by[i, dev].items():
            want = sum(float(Fraction(x[j]) - Fraction(sums[j], n)) * fit.vectors[j, c - 1] for j in range(5)) / math.sqrt(fit.values[c - 1])
            assert abs(want - r["whitened"]) < 1e-9 and r["n"] == n and abs(r["explained"] - fit.values[c - 1] / sum(float(cov[j][j]) for j in range(5))) < 1e-12


def test_op13_exact_totals_and_edges(spark):
    assert [sum(v << 32 * k for k, v in enumerate(whitening.limbs(x))) for x in (0, 1, -1, 2**32, -(2**32), -(2**70) + 5, 2**140 + 9)] == [0, 1, -1, 2**32, -(2**32), -(2**70) + 5, 2**140 + 9]
    for scale in (3, 10**6, 10**12):
        y = np.random.default_rng(2).integers(-scale, scale, (50, 4))
        assert (whitening.cross(y).astype(object) == y.astype(object).T @ y.astype(object)).all()
    same = [(i, [0.5] * 64, 0, "", "") for i in range(5)]
    out = whitening.whiten(spark.createDataFrame(same, SCHEMA))[0].collect()
    assert len(out) == 80 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in out)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA))[0].count() == 0
    huge = [(i, [float(v)] * 3, 0, "", "") for i, v in enumerate((1e37, -1e37, 0.0))]
    got = whitening.whiten(spark.createDataFrame(huge, SCHEMA))[0].collect()
    assert len(got) == 9 and all(math.isfinite(r["whitened"]) for r in got if r["component"] == 1)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 65_535, 65_536, 65_537, 200_000):
        for most in (1, 256, 49_408, 2**32):
            ids = rng.integers(0, most, n, dtype=np.uint32)
            assert (bitplane.from_planes(bitplane.planes(ids, bitplane.KINDS[kind]), n, bitplane.KINDS[kind]) == ids).all()
    docs = [rng.integers(0, 2**32 if i % 2 else 300, n, dtype=np.uint32) for i, n in enumerate((0, 5, 70_000, 0, 200_000, 65_536, 1))]
    out = io.BytesIO()
    file = bitplane.PlaneWriter(out, bitplane.KINDS[kind])
    for d in docs:
        file.add(d)
    told = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([len(d) for d in docs])], names=["doc_id", "n_tokens"])
    kept = io.BytesIO()
    with pa.ipc.new_stream(kept, told.schema) as s:
        s.write_batch(told)
    file.close(kept.getvalue())
    back = bitplane.PlaneFile(pa.BufferReader(out.getvalue()))
    assert [d.tolist() for d in back.rows()] == [d.tolist() for d in docs] and len(back.index) == -(-sum(map(len, docs)) // bitplane.CHUNK)
    with pytest.raises(ValueError):
        bitplane.PlaneFile(pa.BufferReader(b"x" * 100))


def test_op12_order_starts_and_edges(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(5, "some words here", "x"), (None, "no id", "x"), (-3, None, "x"), (5, "some words here", "x"), (5, "", "x"), (10**15, "漢字 ümlaut " * 3000, "x"), (None, "no id too", "x"), *((i, f"row {i}", "x") for i in range(100, 150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    ids = packing.tokenized(bitplane.ordered(docs, 5), path, end_id=2)
    for kind in bitplane.KINDS:
        for _ in range(2):  # a second write takes the place of the first
            bitplane.write(ids, f"{tmp_path}/{kind}", kind)
        got = sorted(bitplane.read(spark, f"{tmp_path}/{kind}").collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
        at, lib = 0, packing.coder(path).lib
        for r in got:
            assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
        assert sorted(bytes(r["ids"]) for r in got) == sorted(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t, _ in rows)
        assert not [p for p in (tmp_path / kind).iterdir() if p.name.startswith("_attempts")]
    bitplane.write(spark.createDataFrame([], "doc_id long, ids binary"), f"{tmp_path}/none")
    assert bitplane.read(spark, f"{tmp_path}/none").count() == 0
    bitplane.write(spark.createDataFrame([("a", None), (None, b"\1\0\0\0")], "doc_id string, ids binary").coalesce(1), f"{tmp_path}/keys")
    assert [(r["doc_id"], r["n_tokens"]) for r in bitplane.read(spark, f"{tmp_path}/keys", "string").orderBy("start", "n_tokens").collect()] == [("a", 0), (None, 1)]


def test_whole_and_matrix():
    assert vectors.matrix(pa.array([[1, 2], [3], []], pa.list_(pa.int64())), 3).tolist() == [[1, 2, 0], [3, 0, 0], [0, 0, 0]]
    assert vectors.widest(np.array([-(2**63)])) == 2**63 and vectors.widest(np.array([])) == 0
