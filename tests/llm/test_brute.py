"""Queries that SQL cannot express against plain versions of them, and edge cases of names, ids and skew."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from strandloom.llm import common, langid, lm, media, merkle, ngram_join, packing, queries, secrets, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    """(rows, folder): 120 rows of the small table, with nulls, an empty text and a repeated row."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(120).collect()]
    rows += [(100_001, None, "en", None, None), (100_002, "", None, "s", 0), (None, "no id here", None, None, 10), rows[3], (100_003, "12 !! 34", "en", "s", 8), (100_004, "a" * 5000 + " é" * 300, "en", "s", 5600)]
    return rows, folder(spark, tmp_path_factory.mktemp("sample"), rows)


def test_shots_are_cut_where_histograms_change():
    rng = np.random.default_rng(0)
    grey = np.concatenate([rng.integers(0, 60, (20, 256)), rng.integers(120, 250, (20, 256)), rng.integers(0, 60, (5, 256))])
    assert media.shots(media.histograms(grey)) == [(0, 20), (20, 40), (40, 45)]
    assert media.shots(media.histograms(grey[:0])) == [] and media.riff(b"not a file")["frames"] == []


def test_op2_against_a_plain_network(spark, sample):
    """Byte by byte in plain loops, with the same parameters."""
    rows, path = sample
    net = langid.fit(spark.read.parquet(f"{path}/documents.parquet"))
    p, h = {k: v.astype(float) for k, v in net.p.items()}, langid.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(window, d):
        out, s = [None] * len(window), np.zeros(h)
        for t in range(len(window)) if d == "f" else range(len(window) - 1, -1, -1):
            a, b = p["W" + d][window[t]], s @ p["U" + d]
            z, r = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
            s = (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :]) + z * s
            out[t] = s
        return out

    def told(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        data, total = text.encode(), np.zeros(len(net.langs))
        for at in range(0, len(data), langid.CORE):
            window = [data[i] if 0 <= i < len(data) else langid.PAD for i in range(at - langid.MARGIN, at + langid.CORE + langid.MARGIN)]
            f, b = states(window, "f"), states(window, "b")
            for t in range(langid.MARGIN, langid.MARGIN + min(langid.CORE, len(data) - at)):
                e = np.exp(f[t] @ p["Of"] + b[t] @ p["Ob"] + p["c"])
                total += e / e.sum()
        return net.langs[int(total.argmax())], float(total.max() / len(data))

    got = collections.Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 4)) for r in queries.op2_langid(spark, path).collect())
    short = [r for r in rows if r[1] is None or len(r[1]) < 3000]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert sum(got.values()) == len(rows)
    for r in short[:40] + short[-5:]:
        lang, score = told(r[1])
        assert any(k[:3] == (r[0], held(r[0]), lang) and abs(k[3] - score) < 1e-3 for k in got), (r[0], lang, score)


def test_op3_pieces_of_each_document(spark, sample):
    from tokenizers import Tokenizer

    rows, path = sample
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter((i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, *_ in rows)
    got = queries.op3_packing(spark, path).collect()
    left = collections.Counter()
    # Pieces of one row follow each other in the stream.
    order = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    at = {}
    for r in order:
        at.setdefault(r["doc_id"], []).append(r)
    for i, pieces in at.items():
        whole = []
        for r in pieces:
            if r["start"] == 0:
                whole.append([])
            assert r["start"] == sum(x["length"] for x in whole[-1])
            whole[-1].append(r)
        for parts in whole:
            fits = [ids for j, ids in want if j == i and len(ids) == parts[0]["doc_tokens"] and all(zlib.crc32(np.array(ids[x["start"] : x["start"] + x["length"]], "<u4").tobytes()) == x["ids_crc32"] for x in parts)]
            assert fits and sum(x["length"] for x in parts) == len(fits[0])
            left[i, fits[0]] += 1
    assert left == want


def test_op6_counts_and_digests(spark, sample):
    from tokenizers import Tokenizer

    rows, path = sample
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.no_truncation()
    lib.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter(tuple(r[k] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in queries.op6_bpe(spark, path).collect()) == want


def test_op5_against_every_run_of_fifty_words(spark, tmp_path):
    """Every document that shares 50 words in a row with another is reported over them; what is reported stands in its first document."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(rng.randint(45, 120)) for _ in range(25)]
    texts = {i: " ".join(x for _ in range(rng.randint(1, 4)) for x in (line(rng.randint(1, 90)), rng.choice(shared) if rng.random() < 0.4 else "")) for i in range(150)}
    path = folder(spark, tmp_path, [(i, t, "en", "s", len(t)) for i, t in texts.items()])
    got = collections.defaultdict(list)
    for r in queries.op5_substring(spark, path).collect():
        got[r["doc_id"]].append(r)
    words = {i: [(m.start(), m.end()) for m in re.finditer(r"\S+", t)] for i, t in texts.items()}
    runs = collections.defaultdict(set)
    for i, t in texts.items():
        for k in range(len(words[i]) - 49):
            runs[" ".join(t[a:b] for a, b in words[i][k : k + 50])].add(i)
    for i, t in texts.items():
        covered = np.zeros(len(t) + 1, bool)
        for r in got[i]:
            covered[r["start"] : r["stop"]] = True
            assert r["first_doc_id"] <= i and r["is_first"] == (r["first_doc_id"] == i) and r["n_chars"] == r["stop"] - r["start"]
            if not r["is_first"] and r["n_words"] > 20:
                assert " ".join(t[r["start"] : r["stop"]].split()[2:-2]) in " ".join(texts[r["first_doc_id"]].split())
        for k in range(len(words[i]) - 49):
            a, b = words[i][k][0], words[i][k + 49][1]
            if len(runs[" ".join(t[x:y] for x, y in words[i][k : k + 50])]) > 1:
                assert covered[a:b].mean() > 0.5
        # Spans that touch are one run, cut where the first document changes; a run has 35 words at least.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8)])))
        assert all(len(t[x:y].split()) >= 35 for x, y in zip(edge[::2], edge[1::2], strict=True))


def test_op9_base_against_sql(spark, sample, tmp_path):
    """Counts and digests of the base spans by DuckDB's own regular expressions."""
    import duckdb

    rows, _ = sample
    odd = ["password: 'abcdefgh1' Token=abc secret==== AKIA" + "A1" * 8, "é" * 9 + "0a" * 20 + " API_KEY: x.y/z+w==1 apikey=12345678 passwd:short", "x" * 100_000 + " token = deadbeefdeadbeefdeadbeefdeadbeef", "AKIAAKIA" * 3 + " SECRET  :  aaaaaaaa\tpassword:\taaaaaaaa", "password=" * 40 + "12345678"]
    path = folder(spark, tmp_path, [*rows, *((200_000 + k, t, "en", "s", len(t)) for k, t in enumerate(odd))])
    got = {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in queries.op9_secrets(spark, path).collect()}
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
    value = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    con = duckdb.connect()
    q = lambda s: s.replace("'", "''")
    # Starts of the matches: lengths of the pieces between them, which are what splitting at the pattern leaves.
    sql = f"""with d as (select doc_id, coalesce(text,'') as t from '{path}/documents.parquet/*.parquet'),
      k as (select doc_id, 0 as o, 'assign' as kind, t, regexp_extract_all(t, '{q(assign)}') as m, regexp_extract_all(t, '{q(value)}', 1) as v, 8 as least, '{q(assign)}' as p from d
        union all select doc_id, 1, 'access', t, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), 16, 'AKIA[A-Z0-9]+' from d
        union all select doc_id, 2, 'hex', t, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), 32, '[0-9a-f]+' from d),
      g as (select *, string_split_regex(t, p) as gap from k),
      s as (select doc_id, o, kind, least, unnest(range(1, len(m)+1)) as i, m, v, gap from g),
      e as (select doc_id, o, kind, len(v[i]) as n, least, list_sum(list_transform(gap[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))),0) as a, len(m[i]) as k from s),
      f as (select * from e where n >= least)
      select d.doc_id, count(*) filter (f.kind='assign') as n_assign, count(*) filter (f.kind='access') as n_access, count(*) filter (f.kind='hex') as n_hex,
        sha256(coalesce(string_agg(f.kind||':'||cast(cast(a as bigint) as varchar)||':'||cast(cast(a+k as bigint) as varchar), ',' order by a, o),'')) as h from (select distinct doc_id, t from d) d left join (select distinct * from f) f on f.doc_id is not distinct from d.doc_id group by d.doc_id"""
    assert got == set(con.execute(sql).fetchall())


def test_op9_recall_on_random_strings():
    """By alphabet and length; letters alone from 20 on."""
    path, rng, lower, upper, digits = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(8), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for letters in (lower + upper + digits, lower + digits, upper + "234567", digits + "ABCDEF", digits + "abcdef", lower + upper + digits + "+/", lower, lower + upper):
        for n in (16, 17, 19, 20, 24, 32, 36, 40):
            if n >= 20 or not letters.isalpha():
                found = sum(bool(secrets.all_spans("key " + "".join(rng.choice(letters) for _ in range(n)) + " end", path)[1]) for _ in range(200)) / 200
                assert found >= 0.9, (letters, n, found)


def test_op9_known_digests_and_identifiers():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    told = lambda text, **k: [text[a:b] for a, _, b in secrets.random_spans(text, path, **k)]
    digest = "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B"
    assert told(f"see {digest}") == [digest] and not told(f"see {digest}", known=frozenset({digest.lower()}))
    for before in ("sha1: ", "SHA-256=", "commit ", 'digest": "', "md5:", "checksum="):
        assert not told(before + digest), before
    for s in ("2024-01-01_2024-12-31_export", "2024-01-01-2024-12-31", "1234-5678-9012-3456", "release_2024_notes_final", "550e8400-e29b-41d4-a716-446655440000"):
        assert not told(f"a {s} b"), s
    assert not told("4041894974608795 antionthentionly")


def test_op9_many_spans_in_one_text(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    text = " ".join(f"token=abcdefgh{i} x9Qz7Lw2Vb8Tn4Rk6Yp1Jd{i}" for i in range(6000))
    began = time.time()
    base, spans = secrets.all_spans(text, path)
    assert len(base) == 6000 and len(spans) == 12_000 and time.time() - began < 20
    rows = spark.createDataFrame([(1, "token=abcdefgh"), (1, "token=abcdefgh")], "doc_id long, text string")
    assert [r["n_assign"] for r in secrets.scan(rows, path).collect()] == [1, 1]


def test_names_that_clash_pass_through(spark):
    from pyspark.sql import functions as F

    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(60))
    names = ["__block", "__text", "text_", "lang_pred", "lang_score", "version", "row", "LANG_PRED_", "component_id", "bucket"]
    rows = [(i, f"{text} number {'abcdefgh'[i]}" if i < 6 else "entirely other words follow " * 5, "en", "s", 9, *(i * 100 + k for k in range(len(names)))) for i in range(8)]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", `{n}` long" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert all(r[n] == r["doc_id"] * 100 + k for r in out.collect() for k, n in enumerate(names)), name
    assert ngram_join.join(docs).columns == ["doc_id", "n_shingles", "component_id"]
    assert {r["first_doc_id"] for r in substring.passages(docs.withColumn("start", F.lit(1))).collect()} <= set(range(8))
    assert langid.identify(docs, None, ["doc_id", "__text"]).columns == ["doc_id", "__text", "lang_pred", "score"]


def test_rows_that_share_an_id_keep_each_text(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (1, b, "en", "s", 2), (1, b, "de", "s", 3), (2, b, "en", "s", 4), (3, a + " more", "en", "s", 5), (None, a, "en", "s", 6), (4, None, None, None, None)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["lang"]) for r in kept if r["text"]) == sorted([(1, a, "en"), (1, b, "de"), (0, a, "en")])
    assert {r["doc_id"] for r in kept} == {None, 1, 4}


def test_templates_take_time_in_proportion(spark):
    """Documents of 300 shared and 45 own words: Jaccard 0.75, so nothing links, and no two of them may be compared."""
    shared = [f"t{i}" for i in range(300)]
    took = {}
    for n in (500, 4000):
        rows = [(i, " ".join(shared[:150] + [f"own{i}x{k}" for k in range(45)] + shared[150:])) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        began = time.time()
        assert all(r["component_id"] == r["doc_id"] for r in ngram_join.join(df).collect())
        took[n] = time.time() - began
    assert took[4000] < 3 * took[500] + 20, took


def test_components_with_heavy_nodes(spark, monkeypatch):
    from strandloom.llm import graph

    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(30)] + [(399, 1000), (5000, 5001)]
    monkeypatch.setattr(graph, "HEAVY", 20)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(400), *range(1000, 1031)]} | {5000: 5000, 5001: 5000}


def test_sparse_ids_of_fingerprints(spark):
    rng = random.Random(1)
    ids = sorted({rng.randint(-(2**62), 2**62) for _ in range(300)})
    rows = [(i, f"text {i}") for i in ids]
    got = {r["k"]: r["next_k"] for r in merkle.next_ids(spark.createDataFrame([(i,) for i in ids] * 2, "k long")).collect()}
    assert got == {b: a for a, b in zip(ids, ids[1:], strict=False)} | {ids[0]: ids[-1]}
    assert merkle.edited(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


def test_empty_tables_and_single_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    empty = spark.createDataFrame([], DOCS)
    from strandloom.llm import bpe

    assert lm.score(empty).count() == bpe.round_trip(empty, path).count() == ngram_join.join(empty).count() == merkle.edited(empty).count() == 0
    one = spark.createDataFrame([(5, None, None, None, None)], DOCS)
    (r,) = lm.score(one).collect()
    assert (r["n_tokens"], r["n_known"]) == (1, int(zlib.crc32(b"5") % 7 != 2)) and math.isfinite(r["score"])
    assert [tuple(r) for r in ngram_join.join(one).collect()] == [(5, 0, 5)]


def test_word_hashes_over_segments():
    words = ["Ab", "ab", "x" * 300_000, "é", "ab", "y\x0bz"] * 3
    text = "  " + "\n".join(words) + "\t"
    data = np.frombuffer((text + "ab").encode(), np.uint8)
    h, n = common.word_hashes(data, np.array([0, len(data) - 2, len(data), len(data)]))
    assert n.tolist() == [21, 1, 0] and h[0] == h[1] == h[4] == h[21] and len(set(h.tolist())) == 5
    assert common.runs(h[:21], 7)[0] == common.runs(h[:21], 7)[7] and len(common.runs(h, 30)) == 0


def test_shared_folder_is_an_error_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_op2_sample_is_bounded(spark):
    """Rows without an id, of one id, of one text, many languages and long texts: never more than the bounds."""
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as doc_id", "if(id % 50 = 1, 'the same words', concat('some words number ', id)) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    got = collections.Counter(r["lang"] for r in langid.drawn(rows, counts, 600, 1 << 20).collect())
    assert set(got) == {"en", "de"} and all(500 <= n <= 600 for n in got.values())
    assert sum(len(r["text"]) for r in langid.drawn(rows, counts, 600, 3000).where("lang = 'en'").collect()) <= 3000
    one = spark.range(5000).selectExpr("cast(null as long) as doc_id", "'always this text' as text", "'en' as lang")
    assert langid.drawn(one, {"en": 5000}, 600, 1 << 20).count() <= 600
    many = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('l', id % 500) as lang")
    assert len(langid.fit(many, most_langs=5, per_lang=4).langs) == 5
    long = spark.createDataFrame([(1, "x" * 100_000, "en"), (3, "short text", "en")], "doc_id long, text string, lang string")
    assert [r["text"] for r in langid.drawn(long, {"en": 2}, 600, 50_000).collect()] == ["short text"]


def test_op10_rows_without_an_id(spark):
    """Many rows without an id, and many of one id: all get their fingerprints, and one of them stands for each as the next."""
    rows = [(None, f"text without an id {i % 50}") for i in range(3000)] + [(7, f"text of seven {i}") for i in range(3000)] + [(1, "first"), (9, "last one here")]
    got = merkle.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows)
    one = {r["doc_id"]: r for r in got if r["doc_id"] in (1, 9)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    seven = min((t for i, t in rows if i == 7), key=digest)
    lone = min({t for i, t in rows if i is None}, key=digest)
    assert one[9]["edited_sha256"] == digest("last one here"[:-4] + seven[:4]) and one[1]["edited_sha256"] == digest("first"[:-1] + lone[:1])
    assert len({r["fingerprint"] for r in got if r["doc_id"] is None}) == 50
