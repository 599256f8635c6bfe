"""Exact top-k search, fill-in-the-middle and importance resampling against brute force, on odd tables too."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from sparkrag.llm import infill, queries, resample, topk

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_topk", "op12_infill", "op13_resample"])
def test_same_as_sql(spark, name):
    assert compare(spark, connect(DIR), name, queries.QUERIES[name], queries.ORACLE_SQL[name], DIR) == ""


# ---- exact top-k search


def by_hand(rows, k, step):
    fine = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in dict.fromkeys((i, v) for i, v in fine if i % step == 0):
        found = [(-max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(qv, v)))), i) for i, v in fine if i != q and len(v) == len(qv)]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


SMALL = "vec_id long, embedding array<float>, score string, rank string, query string, block int, state string, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", 1, "d", 2) for i, v in rows], SMALL)


def searched(spark, rows, **more):
    return sorted(tuple(r) for r in topk.top_k(table(spark, rows).repartition(3), F.col("vec_id") % 7 == 0, **more).collect())


def vectors(rng, n, dims, far=1.0):
    return [[float(np.float32(rng.uniform(-far, far))) for _ in range(dims)] for _ in range(n)]


@pytest.mark.parametrize(("k", "bins", "blocks"), [(5, 512, (512, 8192)), (3, 4, (2, 5)), (1, 16, (3, 3)), (400, 64, (512, 8192))])
def test_search_equals_brute_force(spark, k, bins, blocks):
    rng = random.Random(k)
    v = vectors(rng, 120, 6)
    rows = list(enumerate(v)) + [(200 + i, v[3]) for i in range(60)] + [(i, [0.0] * 6) for i in range(300, 330)]
    rows += [(401, None), (402, [1.0, None] + [0.0] * 4), (403, [math.nan] * 6), (404, [math.inf] + [0.0] * 5), (None, v[0]), (406, [0.5, 0.5]), (413, [0.5, 0.25]), (420, []), (427, [])]
    assert searched(spark, rows, k=k, bins=bins, query_block=blocks[0], candidate_block=blocks[1]) == by_hand(rows, k, 7)


def test_repeated_rows_and_ids(spark):
    rows = [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 1.0])]
    assert searched(spark, rows, k=3) == [(7, 1, 1, 32768), (7, 2, 1, 32768), (7, 3, 2, 32768)]


@pytest.mark.parametrize("far", [1e3, 1e9, 3e30])
def test_great_components_are_exact(spark, far):
    rows = list(enumerate(vectors(random.Random(1), 30, 5, far)))
    assert searched(spark, rows, k=4) == by_hand(rows, 4, 7)


def test_search_of_nothing(spark):
    assert searched(spark, [(8, [1.0])]) == [] and searched(spark, [(7, [1.0])]) == []
    assert topk.top_k(table(spark, [(7, [1.0])]).where("false"), F.col("vec_id") % 7 == 0).collect() == []


# ---- fill in the middle


def cut_by_hand(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def odd_texts(rng):
    texts = ["".join(rng.choice(["a", "b", "é", "日", "🙂", "\n", "\n\n", " ", "<", "<P", "S>", ">", "M>"]) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    return texts + [None, "", "\n", "\n\n", "no line end", "<P>", "x<S>\ny", "a\n<M>", "line\n" * 9000, "long line " * 9000, "é\n" * 5000 + "日"] + ["same\ntext"] * 5


@pytest.mark.parametrize(("rate", "spm", "chunk", "block"), [(100, 50, 1 << 13, 8 << 20), (70, 30, 1, 100), (100, 0, 7, 1000), (0, 50, 16, 1 << 20)])
def test_infill_equals_a_plain_version(spark, rate, spm, chunk, block):
    rows = list(enumerate(odd_texts(random.Random(chunk))))
    if chunk == 1:
        rows = [r for r in rows if len(r[1] or "") < 1000]
    rows += [rows[5], (None, "a\nb\nc")]
    docs = spark.createDataFrame([(i, t, "n", "form", "out") for i, t in rows], "doc_id long, text string, n string, form string, output string").repartition(3)
    made = infill.infill(docs, rate=rate, spm=spm, chunk=chunk, block_bytes=block)
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted((cut_by_hand(i, t, rate=rate, spm=spm) for i, t in rows), key=key)
    assert sorted((tuple(r) for r in made.collect()), key=key) == want
    texts = {(i, t or "") for i, t in rows}
    assert {tuple(r) for r in made.select("doc_id", infill.restored(F.col("output"), F.col("form"))).collect()} == texts


def test_chunks_in_pieces_count_the_same():
    rng = random.Random(8)
    texts = [t or "" for t in odd_texts(rng)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for chunk, piece in ((5, 16), (64, 64), (1 << 13, 1 << 22)):
        c = infill.Chunks(data, offsets, chunk, piece)
        for i, n in enumerate(c.n_units().tolist()):
            units = re.findall(r"[^\n]*\n|[^\n]+", texts[i])
            assert n == len(units)
            for r in {0, n, n // 2, min(1, n)}:
                head = "".join(units[:r])
                assert c.place(i, r, n) == (int(offsets[i]) + len(head.encode()), len(head))


def test_infill_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert infill.digest(infill.infill(docs.where("false"))).collect() == []


# ---- importance resampling


def features_by_hand(text, order=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def drawn_by_hand(rows, target, buckets, percent, least):
    count = lambda fs: Counter(zlib.crc32(f.encode()) % buckets for f in fs)
    s, t = count(f for _, x in rows for f in features_by_hand(x)[1]), count(f for x in target for f in features_by_hand(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out, able = [], []
    for i, x in rows:
        w, fs = features_by_hand(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in (zlib.crc32(f.encode()) % buckets for f in fs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(fs), weight, score))
        able += [(-score, i is None, i or 0)] if len(w) >= least else []
    rank = {k: r for r, k in enumerate(sorted(able)[: percent * len(able) // 100], 1)}
    return [(*o, rank.get((-o[3], o[0] is None, o[0] or 0)) if len(features_by_hand(x)[0]) >= least else None) for o, (_, x) in zip(out, rows)]


def some_texts(rng, n):
    vocabulary = ["".join(rng.choice("abcxyzÄß日0") for _ in range(rng.randint(1, 9))) for _ in range(90)] + ["Q" * 70, "é" * 60, "x" * 47, "x" * 48, "x" * 49]
    return ["".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.choice((0, 1, 2, 3, 25, 60)))) for _ in range(n)]


@pytest.mark.parametrize(("percent", "buckets"), [(5, 10_000), (60, 97)])
def test_draw_equals_brute_force(spark, percent, buckets):
    rng = random.Random(percent)
    rows = list(enumerate(some_texts(rng, 300) + [None, "", " ", "word " * 4000])) + [(None, "a b " * 30)]
    target = some_texts(rng, 20) + [None, ""]
    docs = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, rank int, score string, row int").repartition(5)
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, buckets=buckets)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(drawn_by_hand(rows, target, buckets, percent, 20), key=key)


def test_windows_hash_the_same():
    rng = random.Random(3)
    raw = [t.encode() for t in some_texts(rng, 60) + ["ab", "cd", "", "ef"]]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    want = [Counter(zlib.crc32(f.encode()) % 10_000 for f in features_by_hand(t.decode())[1]) for t in raw]
    for window in (1, 2, 3, 50, 1 << 16):
        got = [Counter() for _ in raw]
        words, parts = resample.hashed(data, offsets, window=window)
        for text, bucket in parts:
            for t, b in zip(text.tolist(), bucket.tolist()):
                got[t][b] += 1
        assert got == want and words.tolist() == [len(features_by_hand(t.decode())[0]) for t in raw]
    assert resample.hashed(np.zeros(0, np.uint8), np.zeros(4, np.int64))[0].tolist() == [0, 0, 0]


def test_tournament_merges():
    rng = random.Random(6)
    for n in (0, 1, 2, 3, 7, 16):
        sources = [sorted((rng.randint(0, 9), i, j) for j in range(rng.randint(0, 12))) for i in range(n)]
        tree = resample.Tournament(sources)
        want = list(heapq.merge(*sources))
        assert [tree.pop() for _ in range(len(want) + 1)] == [*want, None]


@pytest.mark.parametrize(("n", "size", "heads"), [(1, 8, 4), (999, 16, 1 << 17), (3000, 8192, 1 << 17), (1500, 50, 10), (2999, 1, 1 << 17)])
def test_ranks_equal_a_sort(spark, n, size, heads):
    """Most rows share one score; ranges, pieces and runs are smaller than the draw."""
    rng = random.Random(n)
    rows = [(rng.choice((5, 5, 5, rng.randint(-50, 50))), rng.randint(0, 1500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "score long, doc_id long, row long").repartition(4)
    want = [r for _, _, r in sorted((-s, d, r) for s, d, r in rows)][:n]
    assert [r.row for r in resample.ranked(df, n, size, heads).orderBy("rank").collect()] == want


def test_draw_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a " * 50)], "doc_id long, text string")
    assert resample.resample(docs.where("false"), docs).collect() == []
    assert [r["rank"] for r in resample.resample(docs, docs.where("false")).collect()] == [None]
