"""The pipeline over a hundred rows against plain versions of its stages, each on the stage's own input."""

import collections
import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from strandloom.llm import langid, secrets
from strandloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def corpus():
    """Real rows, exact and near copies, shared passages, secrets, texts without letters, repeated rows in bulk and rows without an id."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(70) for _ in range(4)]
    rows = []
    for i in range(60):
        body = text(rng.randint(1, 120))
        if i % 5 == 0:
            body += " " + shared[i // 5 % 4] + " " + text(10)
        if i % 9 == 0:
            body += " password = x9Qz7Lw2Vb8Tn4Rk6Yp1Jd"
        rows.append((i, body, "en" if i % 3 else None, "s", len(body)))
    rows += [(100 + i, rows[i][1], "en", "s", rows[i][4]) for i in range(6)]  # copies
    rows += [(200 + i, rows[10 + i][1] + " end", "en", "s", rows[10 + i][4] + 4) for i in range(6)]  # near copies
    rows += [(300 + i, t, "en", "s", len(t or "")) for i, t in enumerate([None, "", "12 !! 34", " \n ", "one", "one"])]
    rows += [rows[20]] * 25 + [(None, "row without an id " + text(20), "en", "s", 5)] * 3
    return rows


def grams(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_every_stage_against_a_plain_version(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    inputs, frames = [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        inputs.append([tuple(r) for r in docs.collect()])
        frames.append(docs)
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    inputs.append([tuple(r) for r in docs.collect()])

    # 1: letters and a score above the limit; a null lang takes the prediction
    net = langid.fit(frames[0])
    want = collections.Counter()
    for i, t, lang, s, n in inputs[0]:
        if t and any(map(str.isalpha, t)):
            p = langid.pooled(net, [t])[0]
            if p.max() >= corpus_pipeline.LEAST_SCORE:
                want[i, t, lang or net.langs[int(p.argmax())], s, n] += 1
    assert collections.Counter(inputs[1]) == want and want

    # 2: of linked texts the smallest doc_id, by all pairs
    texts = {i: t for i, t, *_ in inputs[1] if i is not None}
    sets, root = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    stay = {i for i in texts if find(i) == i}
    assert {r[0] for r in inputs[2]} == stay | {None} and len(stay) < len(texts)
    assert collections.Counter(r for r in inputs[2] if r[0] is None) == collections.Counter(r for r in inputs[1] if r[0] is None)
    assert max(collections.Counter(r[0] for r in inputs[2] if r[0] is not None).values()) == 1

    # 3: no document goes; what is left of a text is a part of it; a run of 50 words that documents share stands once at most, the first keeps its text
    before, after = {r[0]: r[1] for r in inputs[2] if r[0] is not None}, {r[0]: r[1] for r in inputs[3] if r[0] is not None}
    assert set(before) == set(after) and len(inputs[2]) == len(inputs[3])
    owners = collections.defaultdict(set)
    for i, t in before.items():
        w = t.split()
        for k in range(len(w) - 49):
            owners[tuple(w[k : k + 50])].add(i)
    sharing = {i for of in owners.values() if len(of) > 1 for i in of}
    for i, t in after.items():
        rest = iter(before[i])
        assert all(c in rest for c in t)  # what is left, in order
        if i not in sharing:
            assert t == before[i]
    assert any(after[i] != before[i] for i in sharing)
    left = collections.Counter(k for t in after.values() for k in {tuple(t.split()[j : j + 50]) for j in range(len(t.split()) - 49)})
    assert all(n == 1 for n in left.values())

    # 4: spans of the plain scan replaced
    path = tokenizer("byte_bpe_50k.tiktoken")
    want = collections.Counter()
    for i, t, lang, s, n in inputs[3]:
        spans, at, out = secrets.all_spans(t, path)[1], 0, ""
        for a, _, b in spans:
            out += (t[at:a] + "[SECRET]") if a >= at else ""
            at = max(at, b)
        want[i, out + t[at:] if spans else t, lang, s, len(out + t[at:]) if spans else n] += 1
    assert collections.Counter(inputs[4]) == want and any("[SECRET]" in r[1] for r in inputs[4])

    # 5: windows are full and gapless, and each row's ids are the library's
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    total = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in inputs[4])
    assert sum(r["length"] for r in out) == total and max(r["sequence_id"] for r in out) == (total - 1) // 2048
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s, of in by.items():
        assert np.array_equal(np.cumsum([0, *(n for _, n in sorted(of))])[:-1], [o for o, _ in sorted(of)])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"]) for r in out if r["start"] == 0) == sorted((i is None, i or 0, len(lib.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in inputs[4])
