import io
import json
import random
import sqlite3
import time
import zipfile
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sparkrag.config import Chunk, Retrieve, Settings, tightened
from sparkrag.engine import Engine
from sparkrag.functions import text as X
from sparkrag.operators import archive, chunking, citations, evaluate, feedback, fts, fts_batch, nearest, retrieval, store, sync, tasks
from sparkrag.sources import loaders


def test_token_estimate(spark):
    assert spark.createDataFrame([("字" * 300,)], "t string").select(X.token_estimate(F.col("t"))).first()[0] == 100


def plain_fixed(text, cfg):
    import re

    parts = [s.strip() for s in re.sub(r"([。！？.!?][\t\n\f\r ]*|\n+)", "\\1\x01", text).split("\x01")]
    out, buf = [], ""
    for s in filter(None, parts):
        both = f"{buf} {s}" if buf else s
        if buf and len(both) // 3 > cfg.max_tokens:
            out.append(buf)
            buf = s
        else:
            buf = both
    out += [buf] if buf else []
    if len(out) >= 2 and len(out[-1]) // 3 < cfg.min_tokens:
        out[-2:] = [out[-2] + " " + out[-1]]
    return out


def test_fixed_chunks_equal_a_plain_version(spark):
    rng, cfg = random.Random(1), Chunk(min_tokens=20, max_tokens=50)
    texts = ["".join(rng.choice("abc 。.!?\n字 ") for _ in range(rng.randint(0, 900))) for _ in range(60)] + ["", "。", "x" * 500]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.fixed(F.col("t"), cfg).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: plain_fixed(t, cfg) for i, t in enumerate(texts)}


def test_structure_keeps_fences_and_breadcrumbs():
    fence = "```\n" + "\n".join(f"line {i} of code" for i in range(50)) + "\n```"
    chunks = chunking.structure_chunks(f"# Guide\n\n{fence}\n\nAfter.", Chunk(min_tokens=1, max_tokens=50))
    assert sum(fence in c for c in chunks) == 1
    with_path = chunking.structure_chunks("# Guide\n## Setup\nInstall it.", Chunk(breadcrumb=True))
    assert with_path[0].startswith("[Guide > Setup]\n")


def test_semantic_breaks_at_a_turn(spark):
    rows = [(0, i, f"s{i}.", [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "d int, o int, s string, v array<double>")
    got = [r.text for r in chunking.semantic(df, "d", "o", "s", "v", Chunk(percentile=90)).orderBy("ordinal").collect()]
    assert got == ["s0. s1. s2.", "s3. s4. s5."]


def test_match_equals_sqlite(spark):
    texts = ["Café au lait", "red apple pie", "the red car and the apple", "apple apple banana", "你好世界 hello", "red wine", "hello world", "pie crust recipe"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='unicode61')")
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", list(enumerate(texts, 1)))
    index = fts.indexed(spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string"), "id", "text").cache()
    for q in ("cafe", "apple", "red apple", "red OR hello", "apple NOT banana", "ap*", '"red apple"', "^red", "NEAR(red apple, 3)", "(red OR hello) NOT wine", "你好", "text:pie"):
        want = {i: -s for i, s in con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (q,))}
        got = {r.chunk_id: r.score for r in fts.bm25(index, q).collect()}
        assert got.keys() == want.keys(), q
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want), q
    for q in ("what?", "a'b", "x.y", "", "red AND", "(red"):
        with pytest.raises(fts.MatchError):
            fts.parse(q)


GOLDEN = [("redis-cache", "redis-guide", [1.0, 0.0, 0.0]), ("mysql-index", "mysql-guide", [0.0, 1.0, 0.0]), ("kubernetes-rollout", "kubernetes-guide", [0.0, 0.0, 1.0]), ("redis-cluster", "redis-guide", [0.9, 0.1, 0.0])]


def test_golden_metrics_are_one(spark):
    rows = [(i, name, src, v) for i, (name, src, v) in enumerate(GOLDEN)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, source string, embedding array<double>")
    index, out = fts.indexed(chunks, "chunk_id", "text"), None
    for case, q in enumerate(([1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0])):
        found = retrieval.retrieve(chunks, chunks, index, "how is it?", q, Retrieve(top_k=3, candidate_multiplier=2))
        pos = found.orderBy(F.desc("final_score"), "chunk_id").select("chunk_id", "source").collect()
        part = [(case, i + 1, r.chunk_id, r.source) for i, r in enumerate(pos)]
        out = (out or []) + part
    results = spark.createDataFrame(out, "case_id int, pos int, chunk_id long, source string")
    targets = spark.createDataFrame([(c, f"t{c}", k, None, 1) for c, k in enumerate((0, 1, 2))], "case_id int, target string, chunk_id long, source string, grade int")
    m = evaluate.macro(evaluate.case_metrics(targets.select("case_id").distinct(), results, targets)).first()
    assert (m.recall_at_k, m.mrr, m.ndcg) == (1.0, 1.0, 1.0)


def test_metrics_of_graded_targets(spark):
    results = spark.createDataFrame([(0, 1, 9, "a"), (0, 2, 1, "b"), (0, 3, 2, "c")], "case_id int, pos int, chunk_id long, source string")
    targets = spark.createDataFrame([(0, "x", 1, None, 2), (0, "y", 2, None, 1)], "case_id int, target string, chunk_id long, source string, grade int")
    m = evaluate.case_metrics(targets.select("case_id").distinct(), results, targets).first()
    assert m.recall == 1.0 and m.rr == 0.5 and 0 < m.ndcg < 1
    assert evaluate.failures({"recall": 0.9}, {"recall": 1.0}, {"recall": 0.05}) == ["recall"]


def test_knn_of_another_dimension_is_empty(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, embedding array<double>")
    assert retrieval.knn(v, [1.0, 0.0, 0.0], 5).count() == 0


def test_sync_revisions_and_queue(spark):
    old = spark.createDataFrame([("s", "a", "h1", 2), ("s", "b", "h2", 1)], "source string, k string, content_hash string, revision long")
    new = spark.createDataFrame([("s", "a", "h1"), ("s", "c", "h3")], "source string, k string, content_hash string")
    d = sync.diff(old, new, ["source", "k"])
    assert {r.k: r["class"] for r in d.collect()} == {"a": "unchanged", "b": "deleted", "c": "added"}
    assert {r.k: r.revision for r in sync.promoted(old, d, ["source", "k"]).collect()} == {"a": 3, "c": 1}


def test_tasks_are_durable_and_claimed_once(spark, tmp_path):
    a, b = (tasks.Tasks(store.Store(spark, str(tmp_path / "s"))) for _ in range(2))  # two drivers
    t = a.submit("s", "h", 0, "key")
    assert b.submit("s", "h", 0, "key") == t
    with pytest.raises(store.Conflict, match="idempotency_conflict"):
        b.submit("s", "other", 0, "key")
    with pytest.raises(store.Conflict, match="active_task_conflict"):
        b.submit("s", "h2", 0)
    for i in range(6):
        a.submit(f"s{i}", "h", 0)
    seen = b.list  # b looked before a claimed
    b.list = lambda **k: [x for x in seen() if k.get("state") in (None, "queued")] or seen(**k)
    stale = b.list(state="queued")
    first = a.claim("a")
    b.list = lambda **k: stale
    second = b.claim("b")
    b.list = seen
    assert (first["id"], second["id"]) == (1, 2)  # the task that another was first to claim is passed over
    got = [x["id"] for _ in range(4) for x in (a.claim("a"), b.claim("b")) if x]
    assert sorted(got) == [3, 4, 5, 6, 7]
    renewed = a.renew(first, 100.0)
    with pytest.raises(store.Conflict):
        a.finish(first)  # an older state of its own
    late = time.time() + 10_000
    assert b.recover() == 0 and b.recover(late) == 7 and b.recover(late) == 0
    with pytest.raises(store.Conflict):
        a.finish(renewed, {"n": 1})  # the former owner
    fresh = tasks.Tasks(store.Store(spark, str(tmp_path / "s")))  # after a restart
    assert fresh.get(1)["state"] == "failed" and fresh.get(1)["error"] == "interrupted" and fresh.submit("s", "h", 0, "key")["id"] == 1
    again = fresh.retry(1, 4)
    assert (again["attempt"], again["parent"], again["base"]) == (2, 1, 4)
    assert fresh.cancel(again["id"])["state"] == "cancelled"
    third = fresh.retry(again["id"], 5)
    done = fresh.finish(fresh.claim("c"), {"n": 3})
    assert done["id"] == third["id"] and a.get(third["id"])["report"] == {"n": 3} and [x["id"] for x in a.list("s")] == [1, 8, 9]
    for bad in (third["id"], 1):
        with pytest.raises(store.Conflict):
            fresh.cancel(bad)
    fresh.attempts = 2
    with pytest.raises(store.Conflict, match="retry_limit"):
        fresh.retry(again["id"], 5)
    with pytest.raises(KeyError):
        fresh.get(99)


def test_syncs_run_as_tasks(spark, tmp_path):
    e = small(spark, tmp_path)
    frame = lambda *rows: spark.createDataFrame(list(rows), "document_id string, text string")
    one = frame(("a", "Cats sleep."), ("b", "Dogs bark."))
    t = e.submit_sync("wiki", one, key="k")
    assert e.submit_sync("wiki", one.orderBy(F.desc("document_id")), key="k")["id"] == t["id"]
    with pytest.raises(store.Conflict, match="idempotency_conflict"):
        e.submit_sync("wiki", frame(("a", "Other.")), key="k")
    done = e.run_sync("driver")
    assert done["state"] == "succeeded" and done["report"]["documents"] == {"added": 2} and e.run_sync("driver") is None
    e.submit_sync("wiki", frame(("", "no id")))
    assert e.run_sync("driver")["state"] == "failed"
    # a driver that dies after it published: the task is found done; one that dies before: failed, and retried
    e.submit_sync("wiki", frame(("a", "Cats run.")))
    real, e.tasks.finish = e.tasks.finish, lambda *a, **k: None
    e.run_sync("driver")
    e.tasks.finish = real
    other = small(spark, tmp_path)
    late = time.time() + 10_000
    assert other.recover_syncs(late) == 0 and other.tasks.get(3)["state"] == "succeeded" and other.tasks.get(3)["report"]["revision"] == 2
    other.submit_sync("wiki", frame(("a", "Cats jump.")))
    assert e.tasks.claim("driver")["id"] == 4 and other.recover_syncs(late) == 1
    other.tasks.retry(4, 2)
    assert other.run_sync("other")["report"]["chunks"] == {"changed": 1} and [r.text for r in other.store.table("chunks").collect()] == ["Cats jump."]
    n = len(list((tmp_path / "store" / "parts").glob("s[tn]a*-*")))
    assert other.store.clear_staging(3600) == 0 and other.store.clear_staging(0, time.time() + 10) == n > 0
    assert other.store.table("chunks").count() == 1 and other.baseline("wiki").revision == 3


def test_sync_of_a_source(spark, tmp_path):
    asked = tmp_path / "asked"  # written by the workers

    def model(texts):
        with asked.open("a") as f:
            f.writelines(t + "\n" for t in texts)
        return retrieval.hash_embedder(32)(texts)

    e = Engine(spark, str(tmp_path / "store"), model, Settings(embedding=Settings().embedding.__class__(dims=32)))
    e.ingest(spark.createDataFrame([("wiki", "An old row."), ("wiki#part", "A part stays."), ("other", "Another source.")], "source string, text string"))

    def sync_of(rows, **given):
        return e.sync_source("wiki", spark.createDataFrame(rows, "document_id string, text string"), **given)

    def ids():
        return {r.document_id: r.chunk_id for r in e.baseline("wiki").chunks.collect()}

    first = sync_of([("a", "Redis is a cache."), (" b ", "MySQL has indexes.\r\n"), ("c", "Kafka is a log.")], expect=0)
    assert first == {"source": "wiki", "revision": 1, "documents": {"added": 3}, "chunks": {"added": 3}}
    texts = {r.text for r in e.store.table("chunks").collect()}
    assert "An old row." not in texts and {"A part stays.", "Another source.", "MySQL has indexes."} <= texts
    before = ids()
    asked.write_text("")
    second = sync_of([("a", "Redis is a cache."), ("b", "MySQL has new indexes."), ("d", "Go is a language.")], expect=1)
    assert second["documents"] == second["chunks"] == {"unchanged": 1, "changed": 1, "added": 1, "deleted": 1}
    assert sorted(asked.read_text().splitlines()) == ["Go is a language.", "MySQL has new indexes."]
    after = ids()
    assert after["a"] == before["a"] and after["b"] != before["b"] and set(after) == {"a", "b", "d"}
    assert {r.document_id: r.revision for r in e.baseline("wiki").documents.collect()} == {"a": 2, "b": 2, "d": 1}
    assert {r.chunk_id for r in e.store.table("chunks").where("source = 'wiki'").collect()} == set(after.values())
    assert sum(r.n for r in e.integrity().collect()) == 0
    assert e.retrieve("language", 1).first().text == "Go is a language."
    version = e.store.version
    with pytest.raises(store.Conflict):
        sync_of([("a", "x")], expect=1)
    for rows in ([("", "x")], [("a", "x"), ("a ", "y")]):
        with pytest.raises(loaders.LoadError):
            sync_of(rows)
    assert e.store.version == version
    assert sync_of([("a", "Redis is a cache.")], identity="another model")["chunks"] == {"changed": 1, "deleted": 2}
    assert sync_of([])["documents"] == {"deleted": 1} and e.store.table("chunks").where("source = 'wiki'").isEmpty()
    assert e.delete_source("wiki") == 1 and e.baseline("wiki").revision == 0
    e.reset()
    assert e.store.table("chunks").isEmpty()


def test_loaders(spark, tmp_path):
    assert loaders.visible_text("<html><head><title>x</title></head><body><script>a</script><nav>m</nav><article>Hello <b>world</b></article><footer>f</footer></body></html>") == "Hello world"
    assert loaders.canonical_json('{"z":1.50,"a":{"b":true,"c":null,"d":[]},"q":"x\\n\\u00e9\\u0001"}') == '{\n"a": {\n"b": true,\n"c": <nil>,\n"d": [\n\n]\n},\n"q": "x\\né\\x01",\n"z": 1.50\n}'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:t>Hello</w:t><w:t> DOCX</w:t></w:document>')
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.txt").write_bytes("﻿hello\r\nworld".encode())
    (tmp_path / "c.json").write_text("{bad")
    (tmp_path / "d.png").write_bytes(b"x")
    got = {r.source: (r.text, r.error) for r in loaders.files(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("Hello DOCX", None), "b.txt": ("hello\nworld", None), "c.json": (None, "extraction_failed"), "d.png": (None, "unsupported")}
    assert (tightened(10, 100), tightened(10, 4), tightened(10, 0)) == (10, 4, 10)
    assert loaders.ignored("a/b.log", [("", "*.log"), ("", "!a/b.log")]) is False
    assert loaders.ignored("x/build/y.py", [("", "build/")]) is True
    with pytest.raises(loaders.LoadError):
        loaders.kind_of({"text": "a", "url": "b"})


def test_repository_walk_never_lists_what_is_ignored(spark, tmp_path):
    from dataclasses import replace

    from sparkrag.config import Connectors

    root = tmp_path / "repo"
    for path, text in {
        "a.md": "# Title", "src/b.py": "x = 1", "src/.gitignore": "*.log\n!keep.log\n/only/\n", "src/x.log": "no", "src/keep.log": "yes", "src/only/z.py": "no", "src/sub/only/z.py": "yes",
        ".gitignore": "# rules\nbuild/\n*.tmp\n", "build/deep/c.py": "no", "d.tmp": "no", ".git/config": "no", "page.html": "<b>raw</b>", "pic.png": "no", "empty.txt": "", "big.txt": "y" * 5000, "data.json": "[1]", "bad.json": "{",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "link.md").symlink_to(root / "a.md")
    limits = replace(Connectors(), file_bytes=4000)
    got = {r.source: (r.text, r.error) for r in loaders.repository(spark, str(root), "r.git", "0123456789abcdef", [("", "page.h*")], limits).collect()}
    assert got == {f"r.git#{p}": t for p, t in {"a.md": ("# Title", None), "src/b.py": ("x = 1", None), "src/keep.log": ("yes", None), "src/sub/only/z.py": ("yes", None), "data.json": ("[\n1\n]", None), "bad.json": (None, "extraction_failed")}.items()}
    (root / "build" / "deep").chmod(0)  # whoever lists it fails
    n = len(loaders.walked(spark, str(root), limits=limits))
    assert n == 8
    for bad, message in ((replace(limits, files=9), "file limit"), (replace(limits, total_bytes=20), "byte limit"), (replace(limits, documents=4), "document limit")):
        with pytest.raises(loaders.LoadError, match=message):
            loaders.repository(spark, str(root), "r.git", "0", limits=bad)
    with pytest.raises(loaders.LoadError, match="no supported"):
        loaders.repository(spark, str(root / ".git"), "r.git", "0")


def test_histograms_of_a_stream_equal_a_batch(spark, tmp_path):
    from sparkrag.streaming import stream

    schema = "ts timestamp, kind string, value double"
    rng = random.Random(4)
    rows = [(f"2026-01-01 {h:02}:{rng.randint(0, 59):02}:00", rng.choice("ab"), rng.choice([0.004, 0.005, 0.3, 2.0, 11.0, None])) for h in (0, 1, 2) for _ in range(40)]
    frame = lambda x: spark.createDataFrame(x, "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (rows[:70], rows[70:] + rows[:5]):  # late rows of windows that are still open
        frame(part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    q = stream.histograms(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), "ts", "kind", "value", late="5 hours").writeStream.format("memory").queryName("hist").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    shown = lambda df: sorted((str(r.start), r.kind, r.n, round(r.total or 0, 6), r.at_most) for r in df.collect())
    whole = frame(rows + rows[:5])
    want = shown(stream.histograms(whole, "ts", "kind", "value"))
    assert shown(spark.table("hist")) == want
    parts = [stream.histograms(frame(x), "ts", "kind", "value") for x in (rows[:70], rows[70:] + rows[:5])]
    assert shown(stream.merged(parts[0].unionByName(parts[1]), "kind")) == want
    assert stream.BUCKETS[0] == 0.005 and all(x[4] == sorted(x[4]) for x in want)


def test_excerpts_and_fingerprints(spark):
    assert X.redact_excerpt("https://example.test/path?token=secret#fragment password=hunter2", 200) == "[REDACTED] [REDACTED]"
    assert X.redact_excerpt("  see  https://x.org/a?page=1#f and a_word_of_forty_characters_that_is_no_secret_ ", 256) == "see  https://x.org/a and a_word_of_forty_characters_that_is_no_secret_"
    assert X.redact_excerpt("cafe\u0301 x", 4) == "café" and X.redact_excerpt("x", 0) == ""
    df = spark.createDataFrame([(" café   redis ",), ("café redis",)], "q string").select(X.fingerprint(F.col("q"), b"k").alias("f")).collect()
    assert df[0].f == df[1].f


def test_labels(spark):
    v = citations.validated(F.lit("a [2] b [9] c [2]"), F.array(F.lit(1), F.lit(2)))
    r = spark.range(1).select(v["valid"].alias("v"), v["invalid"].alias("i"), v["missing"].alias("m")).first()
    assert (r.v, r.i, r.m) == ([2], [9], False)


def test_engine_end_to_end(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), settings=Settings(embedding=Settings().embedding.__class__(dims=32)))
    assert e.retrieve("anything").count() == 0
    docs = spark.createDataFrame([("repo.git#a", "Redis is a cache."), ("repo.git#b", "MySQL has indexes."), ("other", "Redis is a cache.")], "source string, text string")
    assert e.ingest(docs) == 2
    assert e.ingest(docs.where("source = 'other'")) == 0
    assert e.retrieve("redis cache", 1).first().text.startswith("Redis")
    assert sum(r.n for r in e.integrity().collect()) == 0
    v = e.store.version
    assert e.rebuild() == v + 1 and e.store.rollback() == v + 2
    assert e.delete_source("repo.git") == 1
    m = store.export_archive(e.store.table("chunks"), str(tmp_path / "a.zip"), {"dims": 32})
    back = store.read_archive(spark, str(tmp_path / "a.zip"), e.store.table("chunks").schema)
    assert back.count() == m["rows"] == 1
    with pytest.raises(store.Conflict):
        e.store.publish({}, expect=1)


def nearest_by_hand(rows, queries, k):
    import math

    out = []
    for q, qv in queries:
        found = sorted((round(math.dist(qv, v), 9), i) for i, v in rows if v is not None and len(v) == len(qv) and all(x is not None and math.isfinite(x) for x in v))
        out += [(q, i, pos, d) for pos, (d, i) in enumerate(found[:k], 1)]
    return sorted(out)


def agree(found, want):
    got = sorted((r.query_id, r.chunk_id, r.pos, r.distance) for r in found.collect())
    return [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want))


def grouped_rows(rng, dims=5):
    """Twelve clusters, one point that holds a third of the rows, ties, and rows of other kinds."""
    spots = [[rng.uniform(-9, 9) for _ in range(dims)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in spots[i % 12]]) for i in range(600)] + [(1000 + i, spots[0]) for i in range(300)]
    rows = [(i, [float(f"{x:.4f}") for x in v]) for i, v in rows]
    return rows, [(5000, None), (5001, [1.0]), (5002, [float("nan")] * dims), (5003, [float("inf")] * dims)]


def test_nearest_by_blocks_equal_brute_force(spark):
    rng = random.Random(2)
    rows, odd = grouped_rows(rng)
    queries = [(i, v) for i, v in rows[::40]] + [(9000, [50.0] * 5), (9001, [1.0]), (9002, [1.0, 2.0])]
    schema = "chunk_id long, embedding array<double>"
    table, asked = spark.createDataFrame(rows + odd, schema).repartition(3), spark.createDataFrame(queries, "query_id long, qv array<double>")
    for k, block in ((4, 256), (350, 7)):
        assert agree(nearest.scan(table, asked, k, block=block), nearest_by_hand(rows + odd, queries, k))
    assert nearest.scan(table.where("false"), asked, 3).isEmpty() and nearest.scan(table, asked.where("false"), 3).isEmpty()


def test_groups_with_bounds_equal_the_scan_and_skip_groups(spark, tmp_path):
    rng = random.Random(3)
    rows, odd = grouped_rows(rng)

    def keep(name, df):
        path = str(tmp_path / f"{name}-{rng.random()}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    table = spark.createDataFrame(rows + odd, "chunk_id long, embedding array<double>").repartition(3)
    index = nearest.build(table, 5, keep)
    groups = index.groups.count()
    assert index.groups.agg(F.sum("n")).first()[0] == len(rows)
    queries = [(i, v) for i, v in rows[::30]] + [(9000, [50.0] * 5), (9001, [1.0])]
    asked = spark.createDataFrame(queries, "query_id long, qv array<double>")
    for k in (1, 10, 400, 2000):
        want = nearest_by_hand(rows, [q for q in queries if len(q[1]) == 5], k)
        assert agree(nearest.search(index, asked, k, keep), want)
        bound = spark.createDataFrame([(q, d) for q, d in {(q, max(w[3] for w in want if w[0] == q)) for q, *_ in want}], "query_id long, upto double")
        read = nearest.probes(index, asked, k, bound).count() / (groups * (len(queries) - 1))
        print(f"k={k}: {read:.2f} of {groups} groups read")
        assert read < 0.35 if k <= 10 else read <= 1
    assert nearest.search(nearest.build(table.where("false"), 5, keep), asked, 3, keep).isEmpty()


def small(spark, tmp_path, name="store", dims=16, model=None):
    return Engine(spark, str(tmp_path / name), model, Settings(embedding=Settings().embedding.__class__(dims=dims)))


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, text string")


def test_stream_ingest_once(spark, tmp_path):
    from sparkrag.streaming.stream import ingest

    src = tmp_path / "in"
    rows_of(spark, ("s", "One fish. Two birds."), ("t", "One fish. Two birds.")).coalesce(1).write.json(str(src))
    e = small(spark, tmp_path)

    def run(checkpoint):
        q = ingest(spark.readStream.schema("source string, text string").json(str(src)), e, str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run("cp")
    assert e.store.table("chunks").count() == 1 and e.retrieve("fish", 1).first().text == "One fish. Two birds."
    assert sum(r.n for r in e.integrity().collect()) == 0
    rows_of(spark, ("u", "Three cats.")).coalesce(1).write.mode("append").json(str(src))
    run("cp")
    v = e.store.version
    e.delete_source("u")
    assert e.store.manifest()["meta"] == {"epoch:ingest": 1}  # later versions keep it
    run("other")  # a checkpoint that was lost: its batch 0 is known
    assert e.store.version == v + 1 and e.store.table("chunks").count() == 1


def test_retrieval_options(spark, tmp_path):
    from dataclasses import replace

    e = small(spark, tmp_path, dims=32)
    e.ingest(rows_of(spark, *((f"s{i}", t) for i, t in enumerate(("Cats sleep long.", "Dogs bark loudly.", "Birds sing early.", "Fish swim deep.")))))
    base = e.settings
    e.settings = replace(base, retrieve=replace(base.retrieve, dynamic_top_k=True))
    assert e.retrieve("cats", 4, used=base.retrieve.window - base.retrieve.reserve - 900).count() == 2 and e.retrieve("cats", 4, used=10**9).count() == 1 and e.retrieve("cats", 4).count() == 4
    assert retrieval.room(3, 0) == 3 and retrieval.room(3, 171_000) == 2
    # forms of a question: each chunk as its best form scores it
    e.llm = lambda prompt: "birds sing\nfish swim\n"
    assert {r.source for r in e.retrieve("animals", 2, rewrite="multi_query").collect()} == {"s2", "s3"}
    want = {}
    for q in ("birds sing", "fish swim"):
        for r in e.retrieve(q, 4).collect():
            want[r.source] = max(want.get(r.source, 0), round(r.final_score, 6))
    assert {r.source: round(r.final_score, 6) for r in e.retrieve("animals", 4, rewrite="multi_query").collect()} == want
    e.llm = lambda prompt: 1 / 0
    assert e.retrieve("dogs bark", 1, rewrite="hyde").first().source == "s1"
    # a reranking model, and what is left of it where it fails
    e.settings = replace(base, retrieve=replace(base.retrieve, rerank=True, top_k=4))
    fused = [r.source for r in small(spark, tmp_path, dims=32).retrieve("cats", 4).orderBy(F.round("final_score", 9).desc(), "chunk_id").collect()]
    e.reranker = lambda q, texts, n: [(i, 1.0 - i) for i in range(len(texts))][::-1] + [(99, 0.0), (-1, 0.0)]
    assert [r.source for r in e.retrieve("cats").collect()] == fused[::-1]
    for bad in (lambda *a: 1 / 0, lambda *a: [], lambda *a: [(7, 1.0)]):
        e.reranker = bad
        assert {r.source for r in e.retrieve("cats").collect()} == set(fused)


def test_every_strategy_is_dispatched(spark, tmp_path):
    from dataclasses import replace

    texts = ["Red cats sleep. Red cats eat. Blue sea waves. Blue sea salt.", "One line.", "", None]
    docs = spark.createDataFrame([(f"s{i}", t, "x") for i, t in enumerate(texts)] + [("s0", texts[0], "x")], "source string, text string, title string")
    model = lambda batch: [[1.0, 0.0] if "Red" in t else [0.0, 1.0] for t in batch]
    cfg = Chunk(strategy="semantic", percentile=50, min_sentences=2)
    got = chunking.pieces(docs, cfg, lambda c: retrieval.embed(c, model, 2)).collect()
    assert sorted((r.source, r.ord, r.text, r.title) for r in got) == [("s0", 0, "Red cats sleep. Red cats eat.", "x"), ("s0", 1, "Blue sea waves. Blue sea salt.", "x"), ("s1", 0, "One line.", "x")]
    with pytest.raises(ValueError):
        chunking.pieces(docs, cfg)
    with pytest.raises(ValueError):
        chunking.chunk_column(F.col("text"), cfg)
    for strategy in ("fixed", "structure", "agentic", "anything"):
        assert {r.source for r in chunking.pieces(docs, Chunk(strategy=strategy)).collect()} == {"s0", "s1"}
    e = small(spark, tmp_path, dims=2, model=model)
    e.settings = replace(e.settings, chunk=cfg)
    assert e.ingest(docs.where("text <> ''").distinct()) == 3 and e.store.table("vectors").count() == 3


def test_stream_sync_goes_on_after_a_break(spark, tmp_path):
    from sparkrag.streaming import stream

    schema = "source string, document_id string, text string, at long"
    src = tmp_path / "in"
    e, plain = small(spark, tmp_path), small(spark, tmp_path, "plain")
    first = [("a", "1", "Cats sleep.", 1), ("a", "2", "Dogs bark.", 1), ("b", "1", "Birds sing.", 1), ("b", "1", "Birds fly.", 2)]
    second = [("a", "2", None, 3), ("a", "3", "Fish swim.", 3), ("b", "1", "Birds fly.", 3), ("b", "2", "Ants dig.", 3)]

    def run():
        q = stream.sync(spark.readStream.schema(schema).json(str(src)), e, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))

    add(first)
    run()
    add(second)
    real = e.sync_source

    def breaks(source, *a, **k):
        if source == "b":
            raise RuntimeError("the driver dies")
        return real(source, *a, **k)

    e.sync_source = breaks
    with pytest.raises(Exception, match="the driver dies"):
        run()
    v = e.store.version
    e.sync_source = real
    run()
    assert e.store.version == v + 1  # source a was done
    frame = lambda *rows: spark.createDataFrame(list(rows), "document_id string, text string")
    plain.sync_source("a", frame(("1", "Cats sleep."), ("2", "Dogs bark.")))
    plain.sync_source("b", frame(("1", "Birds fly.")))
    plain.sync_source("a", frame(("1", "Cats sleep."), ("3", "Fish swim.")))
    plain.sync_source("b", frame(("1", "Birds fly."), ("2", "Ants dig.")))
    for source in "ab":
        x, y = (sorted((r.document_id, r.content_hash, r.revision) for r in z.baseline(source).documents.collect()) for z in (e, plain))
        assert x == y and e.baseline(source).revision == 2
    x, y = (sorted((r.source, r.text) for r in z.store.table("chunks").collect()) for z in (e, plain))
    assert x == y and sum(r.n for r in e.integrity().collect()) == 0 and e.store.manifest()["counts"] == plain.store.manifest()["counts"]
    assert e.retrieve("fish swim", 1).first().text == "Fish swim."


def test_archives_name_the_part_that_changed(spark, tmp_path):
    e, who = small(spark, tmp_path), {"dims": 16}
    e.ingest(rows_of(spark, *((f"s{i:02}", f"Text number {i} about cats.") for i in range(30))))
    e.delete_source("s07")
    at = str(tmp_path / "archive")
    m = archive.export(e.store, at, who, rows_a_file=10)
    assert m["rows"]["chunks"] == m["rows"]["vectors"] == 29 and archive.problems(spark, at, who) == []
    with pytest.raises(archive.ArchiveError):
        archive.export(e.store, at, who)
    other = small(spark, tmp_path, "other")
    other.ingest(rows_of(spark, *((f"o{i}", f"Other text {i}.") for i in range(50))))
    top = other.store.manifest()["top"]
    archive.restore(other.store, at, who, 16)
    a, b = (sorted(map(tuple, x.store.table("chunks").collect())) for x in (e, other))
    assert a == b and other.store.manifest()["top"] == top == 50 and sum(r.n for r in other.integrity().collect()) == 0
    assert other.store.manifest()["counts"] == e.store.manifest()["counts"]
    assert [r.chunk_id for r in other.retrieve("number 3", 3).collect()] == [r.chunk_id for r in e.retrieve("number 3", 3).collect()]
    # one byte
    files = sorted((tmp_path / "archive" / "vectors").glob("*.parquet"))
    assert len(files) >= 3
    raw = bytearray(files[1].read_bytes())
    raw[len(raw) // 2] ^= 1
    files[1].write_bytes(raw)
    assert archive.problems(spark, at, who) == [f"vectors/{files[1].name}: missing or unreadable"]  # the file system's own sum
    files[1].with_name(f".{files[1].name}.crc").unlink()
    assert archive.problems(spark, at, who) == [f"vectors/{files[1].name}: changed"]
    v = other.store.version
    with pytest.raises(archive.ArchiveError, match=files[1].name):
        archive.restore(other.store, at, who, 16)
    raw[len(raw) // 2] ^= 1
    files[1].write_bytes(raw)
    files[0].rename(files[0].with_name("renamed.parquet"))
    assert sorted(x.rpartition(": ")[2] for x in archive.problems(spark, at, who)) == ["missing or unreadable", "unknown"]
    (tmp_path / "archive" / "vectors" / "renamed.parquet").rename(files[0])
    assert archive.problems(spark, at, {"dims": 8}) == ["another embedding"] and archive.problems(spark, at, who, 10) == ["too large"]
    assert archive.problems(spark, str(tmp_path / "none")) != [] and other.store.version == v
    with pytest.raises(archive.ArchiveError, match="wrong_dimension"):
        archive.restore(other.store, at, who, 17)


def test_ids_are_never_given_twice(spark, tmp_path):
    e = small(spark, tmp_path)
    e.ingest(rows_of(spark, ("a", "Cats sleep."), ("b", "Dogs bark.")))
    given = {r.chunk_id for r in e.store.table("chunks").collect()}
    v = e.store.version
    e.ingest(rows_of(spark, ("c", "Birds sing.")))
    newest = e.store.table("chunks").where("source = 'c'").first().chunk_id
    e.delete_source("c")
    e.ingest(rows_of(spark, ("d", "Fish swim.")))
    assert e.store.table("chunks").where("source = 'd'").first().chunk_id > newest > max(given)
    e.store.rollback()
    e.reset()
    e.ingest(rows_of(spark, ("e", "Ants dig.")))
    assert e.store.table("chunks").first().chunk_id > newest + 1 and e.store.version > v


def test_removal_writes_what_leaves(spark, tmp_path):
    """A sync that changes one chunk of many writes one row of each table; the same store as one that was built anew answers alike."""
    e = small(spark, tmp_path)
    docs = [(f"d{i}", f"Document {i} tells about topic{i % 7} and word{i}.") for i in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "document_id string, text string")
    e.sync_source("wiki", frame(docs))
    before = e.store.manifest()
    docs[17] = ("d17", "Quite another sentence.")
    assert e.sync_source("wiki", frame(docs))["chunks"] == {"unchanged": 299, "changed": 1}
    after = e.store.manifest()
    fresh = {k: [p for p in ps if p not in before["tables"].get(k, [])] for k, ps in after["tables"].items()}
    assert {k: sum(e.store.read([p]).count() for p in ps) for k, ps in fresh.items()} == {"chunks": 1, "vectors": 1, "lengths": 1, "postings": 3, "removed": 1, "sync_sources:wiki": 1, "sync_documents:wiki": 1, "sync_chunks:wiki": 1}
    assert all(set(before["tables"][k]) <= set(after["tables"][k]) for k in store.KEYED)
    assert sum(r.n for r in e.integrity().collect()) == 0 and after["counts"] == {"chunks": 300, "tokens": e.store.table("lengths").agg(F.sum("len")).first()[0]}
    assert e.retrieve("word17").where("bm25_score > 0").isEmpty() and e.retrieve("another", 1).first().text == "Quite another sentence."
    plain = small(spark, tmp_path, "plain")
    plain.sync_source("wiki", frame(docs))
    for q in ("topic3", "document", "another OR word250"):
        a, b = ([(r.text, round(r.final_score, 9)) for r in sorted(x.retrieve(q, 5).collect(), key=lambda r: (-round(r.final_score, 9), r.text))] for x in (e, plain))
        assert [s for _, s in a] == [s for _, s in b]
    folded = e.store.fold()
    assert e.store.manifest()["tables"]["removed"] == [] and e.store.table("chunks", folded).count() == 300 == e.store.read(e.store.manifest()["tables"]["vectors"]).count()


def test_racing_writers_of_a_removal(spark, tmp_path):
    e, other = small(spark, tmp_path), small(spark, tmp_path)
    e.ingest(rows_of(spark, ("a", "Cats sleep."), ("b", "Dogs bark.")))
    start = e.store.version
    real = e.store.publish

    def late(**given):  # another driver publishes between the staging and the mark of this one
        if e.store.version == start:
            other.ingest(rows_of(spark, ("c", "Birds sing.")))
        return real(**given)

    e.store.publish = late
    with pytest.raises(store.Conflict):
        e.delete_source("a")
    e.store.publish = real
    assert e.store.table("chunks").count() == 3 and e.delete_source("a") == 1 and e.store.table("chunks").count() == 2
    ids = [r.chunk_id for r in e.store.read(e.store.manifest()["tables"]["chunks"]).collect()]
    assert len(ids) == len(set(ids)) == 3 and sum(r.n for r in e.integrity().collect()) == 0


def test_small_parts_merge_by_size_class(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "s"))
    sizes = {f"p{i}": 1 for i in range(7)} | {f"q{i}": 5000 for i in range(8)}
    assert store.crowded(list(sizes), sizes) == [f"q{i}" for i in range(8)] and store.crowded([f"p{i}" for i in range(7)] + ["x"], sizes) == []
    # 1,000 batches by the rule alone
    parts, known, n = [], {}, 0
    for i in range(1000):
        parts.append(f"b{i}")
        known[f"b{i}"] = 100
        while g := store.crowded(parts, known):
            n += 1
            parts = [p for p in parts if p not in g] + [f"m{n}"]
            known[f"m{n}"] = sum(known[p] for p in g)
    assert len(parts) <= 4 * store.FAN and sum(known[p] for p in parts) == 100_000
    # and with tables
    schema = "chunk_id long, source string"
    for i in range(12):
        part, gone = s.write("chunks", spark.createDataFrame([(3 * i + k, f"s{i}") for k in range(3)], schema)), s.write("removed", spark.createDataFrame([(3 * i,)], "chunk_id long"))
        held = s.manifest()["tables"]
        s.publish(parts={"chunks": [*held.get("chunks", []), part], "removed": [*held.get("removed", []), gone]}, sizes={part: 3, gone: 1})
        s.tidy()
    m = s.manifest()
    assert len(m["tables"]["chunks"]) == len(m["tables"]["removed"]) == 5 and {r.chunk_id for r in s.table("chunks").collect()} == {3 * i + k for i in range(12) for k in (1, 2)}
    merged = next(p for p in m["tables"]["chunks"] if m["sizes"][p] == 24)
    assert s.read([merged]).count() == 16  # removed rows are gone from what was rewritten
    monkeypatch.setattr(store, "MANY_REMOVED", 10)
    s.tidy()
    m = s.manifest()
    assert m["tables"]["removed"] == [] and len(m["tables"]["chunks"]) == 1 and s.table("chunks").count() == 24


def test_rebuild_goes_on_where_it_was_killed(spark, tmp_path, monkeypatch):
    asked = tmp_path / "asked"

    def model(texts):
        assert len(texts) <= 32
        with asked.open("a") as f:
            f.writelines(t + "\n" for t in texts)
        if any("poison" in t for t in texts) and not (tmp_path / "cured").exists():
            raise RuntimeError("the worker dies")
        return retrieval.hash_embedder(16)(texts)

    e = small(spark, tmp_path, model=model)
    (tmp_path / "cured").touch()
    e.ingest(rows_of(spark, *((f"s{i:02}", f"Text number {i}." + (" poison" if i == 30 else "")) for i in range(40))))
    (tmp_path / "cured").unlink()
    e.delete_source("s05")
    v = e.store.version
    real, e.store.thaw = e.store.thaw, lambda lease=None: None  # a driver that dies does not give its lease back
    with pytest.raises(Exception, match="the worker dies"):
        e.rebuild("one", span=10)
    e.store.thaw = real
    (tmp_path / "cured").touch()
    other = small(spark, tmp_path, model=model)
    with pytest.raises(store.Conflict):
        other.ingest(rows_of(spark, ("x", "No entry.")))
    with pytest.raises(store.Conflict):
        other.rebuild("two", span=10)
    later = time.time() + 3601
    monkeypatch.setattr(store, "time", SimpleNamespace(time=lambda: later))  # the lease runs out
    assert other.store.version == v and not other.store.frozen
    asked.write_text("")
    assert other.rebuild("two", span=10) == v + 1 and not other.store.frozen
    again = asked.read_text().splitlines()
    assert 0 < len(again) < 39  # some ranges were done
    assert other.store.table("vectors").count() == 39 and sum(r.n for r in other.integrity().collect()) == 0
    other.ingest(rows_of(spark, ("x", "Entry.")))
    assert fts.bm25(other._index(), "entry").count() == 1


def test_a_lease_that_was_taken_over_is_no_longer_good(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.publish({"t": spark.range(1)})
    first = s.freeze("one", 0.0)
    second = s.freeze("two")
    assert (first, second) == (1, 2) and s.lease() == 2
    with pytest.raises(store.Conflict):
        s.publish({"t": spark.range(2)}, lease=first)
    s.publish({"t": spark.range(2)}, lease=second)
    s.thaw(second)
    with pytest.raises(store.Conflict):
        s.publish({"t": spark.range(3)}, lease=second)
    assert s.publish({"t": spark.range(3)}) == 3 and not s.frozen


def test_a_probe_finds_a_wrong_index(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(50)]
    assert retrieval.probe(spark.createDataFrame(rows, "chunk_id long, embedding array<float>")) == []
    assert retrieval.probe(spark.createDataFrame([(i, [float("nan")] * 4) for i, _ in rows], "chunk_id long, embedding array<float>"))


def test_headings_keep_their_place():
    text = "### X\n\nfirst\n\n## Y\n\nsecond"
    cfg = Chunk(max_tokens=1, min_tokens=0, breadcrumb=True)
    assert chunking.structure_chunks(text, cfg)[-1].startswith("[X > Y]\n")
    assert chunking.breadcrumb(["A", "", "C"], 3) == "[A >  > C]\n" and chunking.breadcrumb(["A"], 0) == ""
    assert [b.level for b in chunking.markdown_blocks("#\tX\n# Y")] == [0, 1]
    assert [b.atomic for b in chunking.markdown_blocks("1) no list\n\n1. list\n- more")] == [False, True]


def test_agentic_answers(spark):
    text = "alpha one\nalpha two\nbeta one\nbeta two"
    seen = []

    def cut(answer, cfg=Chunk()):
        return spark.createDataFrame([(text,)], "t string").select(chunking.agentic(F.col("t"), lambda p: answer, cfg).alias("c")).first().c

    good = '```json\n{"chunks": [{"start_line": 1, "end_line": 2, "summary": "A"}, {"start_line": 3, "end_line": 99}, {"start_line": 9, "end_line": 8}]}\n```'
    assert cut(good) == ["[摘要] A\nalpha one\nalpha two", "beta one\nbeta two"]
    assert cut(good, Chunk(summaries=False))[0] == "alpha one\nalpha two"
    fixed = spark.createDataFrame([(text,)], "t string").select(chunking.fixed(F.col("t")).alias("c")).first().c
    assert cut("no json") == cut('{"chunks": []}') == fixed
    assert "start_line" in chunking.boundary_prompt("1: x\n", Chunk()) and not seen


def test_fixed_chunks_equal_their_column(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(("word ", "two words. ", "end!\n", "\n\n", "x" * 300 + "。 ", "  ")) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    cfg = Chunk(max_tokens=60, min_tokens=30)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", chunking.fixed(F.col("t"), cfg).alias("c")).collect()
    assert all(r.c == chunking.fixed_chunks(texts[r.k], cfg) for r in rows)


def test_index_equals_token_arrays(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("red", "rod", "blue", "green", "the")) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    plain, index = fts.indexed(docs, "k", "t"), fts.postings(docs, "k", "t")
    for q in ("red", '"red blue"', "r*", '"the gre" *', "^the", "red NOT blue", "red OR (blue the)", "NEAR(red blue, 2)", "nothing", '"red red red"', "NEAR(red the green, 3) OR absent"):
        a, b = (sorted((r.chunk_id, round(r.score, 9)) for r in fts.bm25(x, q).collect()) for x in (plain, index))
        assert a == b, q


def test_many_expressions_in_one_plan_equal_one_by_one(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = ["red", "rod", "rust", "blue", "green", "the", "é", "x1"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) for _ in range(120)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    made = fts.postings(docs, "k", "t")
    index = fts.Index(made.postings.persist(), made.lengths.persist())
    odd = ["red", '"red blue"', "r*", '"the gre" *', "^the", "^the red", "red NOT blue", "red OR (blue the)", "NEAR(red blue, 2)", "nothing", '"red red red"', "NEAR(red the green, 3) OR absent", "red red", "(", "", None, "a:b", "ru* NOT (rod OR x1)", '""', '"" OR red', "NEAR(^red r*, 1)", "É", "(" * 5000, "red OR nothing*"]
    term = lambda: rng.choice([*vocabulary, "r*", '"red the"', "^blue", "NEAR(red x1, 4)", "absent"])
    many = list(dict.fromkeys(f"{term()} {rng.choice(('AND', 'OR', 'NOT', ''))} {term()} {rng.choice(('AND', 'OR', 'NOT'))} ({term()} {term()})" for _ in range(40)))
    asked = spark.createDataFrame(list(enumerate(odd + many)) + [(900, "red")], "query_id long, query string")
    want = []
    for i, q in enumerate(odd + many):
        try:
            rows = fts.bm25(index, q or "", 9).collect()
        except (fts.MatchError, RecursionError):
            continue
        want += [(k, r.chunk_id, round(r.score, 9)) for r in rows for k in ([i, 900] if q == "red" else [i])]
    full = fts.Index(index.postings, index.lengths, fts.dictionary(index.postings).persist(), *spark.createDataFrame([(len(texts),)], "n long").crossJoin(index.lengths.selectExpr("sum(len) s")).first())
    monkeypatch.setattr(fts, "SPAN", 4)
    # peaks of this mean length, and those of an index whose texts were shorter or longer since
    peaked = [replace(full, peaks=fts.peaks(full.postings, full.whole()[1] * f).persist()) for f in (1, 0.5, 2)]
    for x, named in ((index, 1000), (full, 1000), (full, 2), *((p, 1000) for p in peaked), (peaked[0], 2)):
        got = fts_batch.search(x, asked, 9, named).collect()
        assert sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in got) == sorted(want) and all(r["rank"] == -r.score for r in got)


def test_blocks_that_cannot_reach_the_best_rows_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(fts, "SPAN", 16)
    rng = random.Random(9)
    common = [f"w{i}" for i in range(20)]
    texts = [" ".join(rng.choices(common, k=30)) for _ in range(3200)]
    for i in range(640, 672):  # two blocks hold all good texts
        texts[i] = "star star star moon"
    texts[5] = texts[3000] = "star " + texts[7]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "star star w0")], "k long, t string")
    made = fts.postings(docs, "k", "t")
    postings, lengths = made.postings.persist(), made.lengths.persist()
    index = fts.Index(postings, lengths)
    peaked = replace(index, peaks=fts.peaks(postings, index.whole()[1]).persist())
    queries = ["star", "star OR w3", "star AND moon", "moon NOT w1", "w3 AND star", "w1 OR w2 OR absent", "absent", "NEAR(star moon, 2)", "star NOT star"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    key = lambda r: (r.query_id, -1 if r.chunk_id is None else r.chunk_id, round(r.score, 9))
    for limit in (1, 7, 40):
        want, got = (sorted(map(key, fts_batch.search(x, asked, limit).collect())) for x in (index, peaked))
        assert got == want
    exprs = fts_batch.parsed(asked.select(F.col("query").alias("expr")))
    kept = fts_batch.skipping(peaked, exprs, fts_batch._lookup(peaked, exprs, 1000), 7)
    n = {r.expr: r["count"] for r in kept.groupBy("expr").count().collect()}
    assert n["star AND moon"] == 2 and n["w3 AND star"] == 2 and n["moon NOT w1"] == 2 and "absent" not in n  # of 200
    assert n["star"] <= 3 and n["star OR w3"] <= 3
    # what survives reaches the scan as ranges of ids
    few = kept.where("expr = 'star AND moon'")
    assert fts_batch._within(index.postings, few).select("chunk_id").distinct().count() == 32


def test_a_thousand_expressions_are_one_plan(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(400)]
    made = fts.postings(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t")
    index = fts.Index(made.postings.persist(), made.lengths.persist(), None, 400, 16_000)
    pairs = {i: (f"w{i % 300}", f"w{(i * 7 + i // 300) % 300}") for i in range(1000)}
    asked = spark.createDataFrame([(i, " OR ".join(p)) for i, p in pairs.items()], "query_id long, query string")
    found = fts_batch.search(index, asked)
    assert found._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") <= 4  # the postings, at most once for scores and once for frequencies
    want = sum(len({k for k, t in enumerate(texts) if a in t.split() or b in t.split()}) for a, b in pairs.values())
    assert found.count() == want


def test_terms_of_a_text_are_gathered_in_its_row(spark):
    rows = spark.createDataFrame([(1, "b a b  c a b"), (2, ""), (3, None), (4, "x")], "k int, t string")
    got = {r.k: [(p.term, p.positions) for p in r.p or []] for r in rows.select("k", fts.by_term(X.tokens(F.col("t"))).alias("p")).collect()}
    assert got == {1: [("a", [1, 4]), ("b", [0, 2, 5]), ("c", [3])], 2: [], 3: [], 4: [("x", [0])]}


def test_two_writers_do_not_share_files(spark, tmp_path):
    a, b = (store.Store(spark, str(tmp_path / "s")) for _ in range(2))
    rows = lambda n: spark.range(n)
    a.publish({"t": rows(1)})
    # both start from version 1 and write before either marks
    pa_, pb = a.write("t", rows(2)), b.write("t", rows(3))
    assert pa_ != pb and a.publish(parts={"t": [pa_]}, expect=1) == 2
    with pytest.raises(store.Conflict):
        b.publish(parts={"t": [pb]}, expect=1)
    with pytest.raises(store.Conflict):
        b._mark({"version": 2, "tables": {"t": [pb]}}, 2)
    assert a.table("t").count() == 2
    a.publish(append={"t": rows(4)})
    assert a.table("t").count() == 6 and len(a.manifest()["tables"]["t"]) == 2 and a.manifest()["tables"]["t"][0] == pa_
    a.backup("before")
    a.freeze()
    with pytest.raises(store.Conflict):
        b.publish({"t": rows(1)})
    with pytest.raises(store.Conflict):
        b.freeze()
    b.thaw()
    a.compact("t")
    a.publish({"t": rows(0)})
    assert a.table("t").count() == 0 and a.backups() == {"before": 3}
    a.restore("before")
    assert a.table("t").count() == 6


def test_update_writes_one_version(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), settings=Settings(embedding=Settings().embedding.__class__(dims=16)))
    e.ingest(spark.createDataFrame([("a", "Cats sleep."), ("a#x", "Dogs bark."), ("b", "Birds sing.")], "source string, text string"))
    parts = e.store.manifest()["tables"]["chunks"]
    assert e.ingest(spark.createDataFrame([("c", "Fish swim.")], "source string, text string")) == 1
    assert e.store.manifest()["tables"]["chunks"][:1] == parts  # only the new rows were written
    v = e.store.version
    assert e.update_source("a", spark.createDataFrame([("a", "Cats run.")], "source string, text string")) == (2, 1)
    assert e.store.version == v + 1 and sorted(r.text for r in e.store.table("chunks").collect()) == ["Birds sing.", "Cats run.", "Fish swim."]
    assert sum(r.n for r in e.integrity().collect()) == 0 and e.retrieve("cats run", 1).first().text == "Cats run."
    assert {r.term for r in e.store.table("postings").collect()} == {"birds", "sing", "cats", "run", "fish", "swim"}


def test_reviews_of_others_stay(spark):
    c = spark.createDataFrame([("k1", "pending"), ("k2", "pending")], "uniqueness_key string, status string")
    c = feedback.reviewed(feedback.reviewed(c, "k1", "approved", " fine "), "k2", "rejected", "no")
    got = {r.uniqueness_key: (r.status, r.review_note, r.reviewed_at is not None) for r in c.collect()}
    assert got == {"k1": ("approved", "fine", True), "k2": ("rejected", "no", True)}
    for bad in (lambda: feedback.reviewed(c, "k1", "rejected"), lambda: feedback.reviewed(c, "k9", "approved"), lambda: feedback.reviewed(c, "k1", "maybe")):
        with pytest.raises(ValueError):
            bad()


def test_ledger_records_lists_and_exports(spark, tmp_path):
    found = spark.createDataFrame([(1, "docs", 0.5, 0.5, 0.5), (2, "more", 0.9, 0.9, 0.9)], "chunk_id long, source string, vec_score double, bm25_score double, final_score double")
    key = b"k" * 32
    event, cits = feedback.recorded(found, "  cafe\u0301  redis  ", "http", key, excerpt=100)
    e = event.first()
    assert e.query_excerpt == "café  redis" and [(r.rank, r.chunk_id) for r in cits.orderBy("rank").collect()] == [(1, 2), (2, 1)]
    for bad in (("q", " ", key), ("q", "http", b"short")):
        with pytest.raises(ValueError):
            feedback.recorded(found, *bad)
    with pytest.raises(ValueError):
        feedback.recorded(found, "q", "http", key, session="s")
    fb = spark.createDataFrame([("f1", e.id, "citation-error", "", "wrong", None)], "id string, retrieval_id string, kind string, session_id string, note string, supersedes_feedback_id string").withColumn("created_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    links = cits.where("rank = 1").select(F.lit("f1").alias("feedback_id"), F.col("id").alias("citation_id"))
    led = feedback.Ledger(event, cits, fb, links)
    led.candidates = feedback.candidates_of(led)
    assert feedback.listed(led, "pending", "citation-error", "more").count() == 1 and feedback.listed(led, source="docs").count() == 0
    new = fb.withColumn("citation_ids", F.array().cast("array<string>"))
    assert feedback.checked(new, led).first().error == "citations missing"
    with pytest.raises(ValueError):
        feedback.exported(led, feedback.Filter(), 0)
    feedback.export(led, feedback.Filter(), str(tmp_path / "j"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert lines[0]["schema_version"] == "v1" and lines[1]["feedback_id"] == "f1" and lines[1]["note"] == "" and len(lines[1]["citation_ids"]) == 1
    feedback.export(led, feedback.Filter(notes=True), str(tmp_path / "c"), "csv")
    row = spark.read.option("header", "true").csv(str(tmp_path / "c")).first()
    assert row.note == "wrong" and row.created_at.endswith("03:04:05Z")


def test_suites_run_through_retrieval(spark, tmp_path):
    corpus = [{"id": "a", "text": "red apples are sweet", "source": "fruit", "embedding": [1, 0]}, {"id": "b", "text": "green pears are soft", "source": "pears", "embedding": [0, 1]}]
    cases = [{"id": "q1", "query": "red apples", "embedding": [1, 0], "targets": [{"chunk_id": "a", "grade": 2}]}, {"id": "q2", "query": "pears (", "embedding": [0, 1], "targets": [{"source": "pears"}]}]

    def put(**other):
        (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": evaluate.SCHEMA_VERSION, "version": "v", "corpus": "c.jsonl", "cases": "k.jsonl"}))
        (tmp_path / "c.jsonl").write_text("".join(json.dumps(x) + "\n" for x in other.get("corpus", corpus)))
        (tmp_path / "k.jsonl").write_text("".join(json.dumps(x) + "\n" for x in other.get("cases", cases)))
        return evaluate.load(spark, str(tmp_path))

    data = put()
    per, shown = evaluate.run(data)
    m = evaluate.macro(per).first().asDict()
    assert m == {"recall_at_k": 1.0, "mrr": 1.0, "ndcg": 1.0, "source_hit_rate": 0.5}
    text = evaluate.artifact(data, Retrieve(), per, shown)
    assert text == evaluate.artifact(data, Retrieve(), *evaluate.run(data)) and json.loads(text)["cases"][0]["evidence"][0]["chunk_id"] == "a"
    base = {"schema_version": evaluate.SCHEMA_VERSION, "dataset": {"version": "v", **data.digests}, "configuration": {}, "metrics": m | {"mrr": 2.0}}
    (tmp_path / "b.json").write_text(json.dumps(base))
    (tmp_path / "t.json").write_text(json.dumps({"schema_version": evaluate.SCHEMA_VERSION, "max_drop": {"mrr": 0.5}}))
    b, t = evaluate.load_baseline(spark, str(tmp_path / "b.json")), evaluate.load_tolerances(spark, str(tmp_path / "t.json"))
    assert evaluate.gate(data, m, b, t) == ["mrr"]
    bad = [{"corpus": [*corpus, corpus[0]]}, {"corpus": [corpus[0] | {"embedding": [1]}, corpus[1]]}, {"cases": [cases[0] | {"targets": [{"chunk_id": "zz"}]}]}, {"cases": [cases[0] | {"targets": []}]}, {"cases": [cases[0] | {"odd": 1}]}, {"cases": []}, {"cases": [cases[0] | {"targets": [{"chunk_id": "a", "grade": -1}]}]}]
    for other in bad:
        with pytest.raises(evaluate.DatasetError):
            put(**other)


def test_instructions_of_evidence(spark):
    asked = spark.createDataFrame([("q",), ("none",)], "q string")
    rows = spark.createDataFrame([("q", 2, "s", "", "", "", "B"), ("q", 1, "s", "T", "u", "l", "A")], "q string, n int, source string, document_title string, uri string, location string, excerpt string")
    got = {r.q: r.instructions for r in citations.instructions(asked, rows, "q").collect()}
    assert got["q"] == citations.RULE + "[1] source=s title=T uri=u location=l\nA\n[2] source=s\nB\n" and got["none"] == citations.RULE + citations.NO_EVIDENCE
