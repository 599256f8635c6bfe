"""One object for a user's calls: ingest, retrieve, sources, sync, feedback, evaluation, index maintenance."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkrag.config import Settings
from sparkrag.functions.text import trim_ws
from sparkrag.operators import chunking, citations, fts, retrieval, store, sync, tasks
from sparkrag.sources import loaders


class Engine:
    def __init__(self, spark: SparkSession, root: str, embed: Callable[[list[str]], list[list[float]]] | None = None, settings: Settings = Settings(), llm: Callable[[str], str] | None = None, reranker: Callable[[str, list[str], int], list[tuple[int, float]]] | None = None):
        self.spark, self.settings, self.llm, self.reranker = spark, settings, llm, reranker
        self.store = store.Store(spark, root)
        self.model = embed or retrieval.hash_embedder(settings.embedding.dims)
        self._tasks = tasks.Tasks(self.store)

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("chunk_id", retrieval.embed(F.col("text"), self.model, self.settings.embedding.dims, batch=self.settings.embedding.batch).alias("embedding"))

    def _pieces(self, docs: DataFrame) -> DataFrame:
        e = self.settings.embedding
        return chunking.pieces(docs, self.settings.chunk, lambda c: retrieval.embed(c, self.model, e.dims, batch=e.batch), self.llm)

    def _tables(self) -> tuple[DataFrame, DataFrame] | None:
        m = self.store.manifest()
        return tuple(self.store.live(k, self.store.read(m["tables"][k]), m) for k in ("chunks", "vectors")) if m["tables"].get("chunks") else None

    def _checked(self, docs: DataFrame) -> DataFrame:
        for c in ("title", "uri", "location"):
            docs = docs if c in docs.columns else docs.withColumn(c, F.lit(""))
        bad = loaders.problems(docs)
        if not bad.isEmpty():
            raise loaders.LoadError("invalid_request", str(bad.first()))
        return docs

    def ingest(self, docs: DataFrame, **meta) -> int:
        """Documents (source, text and perhaps title, uri, location) into chunks, vectors and full-text index; returns new chunks. One publish, which
        writes the new rows only; meta is kept with it."""
        docs = self._checked(docs)
        start, old = self.store.version, self._tables()
        new = store.ingested(self._pieces(docs), old[0] if old else None)
        return self._append(new, ["source", "ord"], start, **meta)

    def _top(self, start: int) -> int:
        """The highest id ever given; for a store that never recorded it, the highest there is."""
        m = self.store.manifest(start)
        if m["top"] is None and m["tables"].get("chunks"):
            return self.store.read(m["tables"]["chunks"]).agg(F.max("chunk_id")).first()[0] or 0
        return m["top"] or 0

    def _append(self, rows: DataFrame, order: list[str], start: int, gone: DataFrame | None = None, also: Callable[[DataFrame], dict[str, DataFrame]] | None = None, drop: dict[str, list[str]] | None = None, **meta) -> int:
        """Publish chunk rows, which get the next ids in `order`, with their vectors and postings. gone: chunk_ids that leave; also: rows that other tables get,
        made from the numbered ones; drop: parts of other tables from now on. All in one version, which writes in proportion to what comes and leaves."""
        m, top, keep = self.store.manifest(start), self._top(start), self.store
        first, parts, sizes = not m["tables"].get("chunks"), dict(drop or {}), {}

        def add(table: str, df: DataFrame, n: int) -> str:
            path = keep.write(table.partition(":")[0], df)
            parts[table], sizes[path] = [*parts.get(table, m["tables"].get(table, [])), path], n
            return path

        # written once: what follows reads the rows back and does not depend on executors that held them
        staged = keep.read([keep.write("staging", store.numbered(rows, order, top))])
        n = staged.count()
        own = [c for c in ("source", "text", "md5", "document_title", "document_uri", "location", "chunk_id") if c in staged.columns]
        counts = m["counts"] if not first else {"chunks": 0, "tokens": 0}
        if n or first:
            new = keep.read([add("chunks", staged.select(*own), n)])
            add("vectors", self._vectors(new), n)
            index = fts.postings(new, "chunk_id", "text")
            add("postings", index.postings, n)
            lengths = keep.read([add("lengths", index.lengths, n)])
            if counts is not None:
                counts = {"chunks": counts["chunks"] + n, "tokens": counts["tokens"] + (lengths.agg(F.sum("len")).first()[0] or 0)}
        if gone is not None:
            part = keep.write("removed", gone.select("chunk_id").distinct())
            lost = keep.read([part])
            if g := lost.count():
                parts["removed"], sizes[part] = [*m["tables"].get("removed", []), part], g
                if counts is not None:
                    less = keep.table("lengths", start).join(lost, "chunk_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("tokens")).first()
                    counts = {"chunks": counts["chunks"] - less.n, "tokens": counts["tokens"] - (less.tokens or 0)}
        for table, df in (also(staged) if also else {}).items():
            path = add(table, df, 0)
            sizes[path] = keep.read([path]).count()
        keep.publish(parts=parts, sizes=sizes, top=top + n, counts=counts, expect=start, **meta)
        self.tidy()
        return n

    def tidy(self) -> None:
        """Merge small parts of the index and of the baselines' logs."""
        logs = {k: sync.KEYS[kind] for k in self.store.manifest()["tables"] if (kind := k.partition(":")[0]) in sync.KEYS}
        self.store.tidy({k: lambda rows, whole, keys=keys: sync.latest(rows, keys, whole).sortWithinPartitions(*keys) for k, keys in logs.items()})

    def update_source(self, source: str, docs: DataFrame) -> tuple[int, int]:
        """Replace a source and its parts by new documents in one version: (chunks removed, chunks added)."""
        start, old = self.store.version, self._tables()
        docs = self._checked(docs)
        if old is None:
            return 0, self.ingest(docs)
        gone = old[0].where(store.of_source(source)).select("chunk_id")
        kept = store.without_source(old[0], source)
        new = store.ingested(self._pieces(docs), kept)
        n = gone.count()
        return n, self._append(new, ["source", "ord"], start, gone, drop=self._forgotten(start, source))

    def _forgotten(self, start: int, source: str) -> dict[str, list[str]]:
        """No parts for the baselines of a source and its parts."""
        names = (k.partition(":")[::2] + (k,) for k in self.store.manifest(start)["tables"])
        return {k: [] for kind, of, k in names if kind in sync.TABLES and (of == source or of.startswith(source + "#"))}

    def baseline(self, source: str, version: int | None = None) -> sync.Baseline:
        """What the last sync of a source left: revision (0: none), identity, documents and chunks."""
        held = self.store.manifest(version)["tables"]
        found = {k: self.store.read(p) if (p := held.get(f"{k}:{source}")) else self.spark.createDataFrame([], schema) for k, schema in sync.TABLES.items()}
        state = found["sync_sources"].first()
        revision = state.revision if state else 0
        return sync.Baseline(revision, state.identity if state else "", *(sync.state(found[k], keys, revision) for k, keys in sync.KEYS.items()))

    def sync_source(self, source: str, snapshot: DataFrame, expect: int | None = None, identity: str = "", only: DataFrame | None = None, **meta) -> dict:
        """Bring a source to a snapshot (document_id, text and perhaps title, uri, location) in one version; returns its revision and counts by class.

        Blank or repeated ids reject the snapshot as a whole, a revision other than `expect` is a conflict. Only added and changed chunks are embedded,
        the others keep their chunk_id; another identity (of the model; settings are part of it) changes all. The first sync replaces the chunks of exactly
        this source. Revisions of documents and chunks grow by one a sync, changed or not. What is written is in proportion to what changed; the snapshot
        is read three times (ids, documents, chunks), so it should not change meanwhile. only: the document_ids that the snapshot speaks of, where it is not
        of the whole source; those of them it lacks are deleted, other documents stay as they are.
        """
        for c in ("title", "uri", "location"):
            snapshot = snapshot if c in snapshot.columns else snapshot.withColumn(c, F.lit(""))
        bad = sync.violations(snapshot, "document_id")
        if not bad.isEmpty():
            raise loaders.LoadError("invalid_request", str(bad.first()))
        start, tables = self.store.version, self._tables()
        base = self.baseline(source, start)
        if expect is not None and expect != base.revision:
            raise store.Conflict("revision_conflict")
        identity = hashlib.sha256(repr((identity, self.settings.embedding, self.settings.chunk)).encode()).hexdigest()
        other, revision = base.revision > 0 and identity != base.identity, base.revision + 1
        docs = sync.snapshot_documents(snapshot, source)
        pieces = sync.snapshot_chunks(self._pieces(docs))
        report, changed = {}, {}
        if only is not None:
            ids = only.select(trim_ws(F.col("document_id")).alias("document_id")).distinct()
            base = replace(base, documents=base.documents.join(ids, "document_id", "left_semi"), chunks=base.chunks.join(ids, "document_id", "left_semi"))
            if base.revision and identity != base.identity:
                raise store.Conflict("another identity needs a snapshot of the whole source")
        for name, old, new, keys in (("documents", base.documents, docs.select(*sync.DOCUMENT, "content_hash"), sync.DOCUMENT), ("chunks", base.chunks, pieces, sync.CHUNK)):
            seen = Observation()
            kinds = {k: F.count(F.when(F.col("class") == k, 1)).alias(k) for k in ("unchanged", "added", "changed", "deleted")}
            diff = sync.changes(old, new, keys, revision, other).observe(seen, *kinds.values())
            # one pass counts all classes and stages what changed
            changed[name] = self.store.read([self.store.write("staging", diff.where("class <> 'unchanged'"))])
            report[name] = {k: seen.get[k] for k in kinds if seen.get[k]}
        by_chunk = changed["chunks"]
        fresh = store.chunk_rows(by_chunk.where("class in ('added', 'changed')"), *sync.CHUNK[1:], "ord")
        if base.revision or only is not None:
            gone = by_chunk.where("class in ('changed', 'deleted')").select(F.col("old_chunk_id").alias("chunk_id"))
        else:
            gone = tables[0].where(F.col("source") == source).select("chunk_id") if tables else None

        def logs(numbered: DataFrame) -> dict[str, DataFrame]:
            hashed = F.when(F.col("class") != "deleted", F.col("new_hash")).alias("content_hash")
            documents = changed["documents"].select(*sync.DOCUMENT, hashed, "first", "at")
            chunks = by_chunk.join(numbered.select(*sync.CHUNK, "chunk_id"), sync.CHUNK, "left").select(*sync.CHUNK, hashed, "first", "at", "chunk_id")
            return {f"sync_documents:{source}": documents, f"sync_chunks:{source}": chunks}

        state = self.store.write("sync_sources", self.spark.createDataFrame([(revision, identity)], sync.TABLES["sync_sources"]))
        self._append(fresh, ["document_id", "ord"], start, gone, logs, {f"sync_sources:{source}": [state]}, **meta)
        return {"source": source, "revision": revision} | report

    @property
    def tasks(self) -> tasks.Tasks:
        return self._tasks

    def submit_sync(self, source: str, snapshot: DataFrame, base: int | None = None, key: str = "") -> dict:
        """Stage a snapshot and queue its sync against revision `base` (the present one). A replayed key gives its task again, if the snapshot is the same."""
        for c in ("title", "uri", "location"):
            snapshot = snapshot if c in snapshot.columns else snapshot.withColumn(c, F.lit(""))
        rows = snapshot.select("document_id", "text", "title", "uri", "location")
        part = self.store.write("snapshot", rows)
        parts = F.xxhash64(*rows.columns).cast("decimal(20,0)")
        n, total = self.store.read([part]).agg(F.count(F.lit(1)), F.sum(parts)).first()  # of rows in any order
        return self._tasks.submit(source, f"{n}:{total}", self.baseline(source).revision if base is None else base, key, snapshot=part)

    def run_sync(self, owner: str, seconds: float = 600.0) -> dict | None:
        """Claim the next queued sync, run it and record its report or error; the task as it ended, None where none waits.

        The version that holds the sync also holds the task's number: an owner that died after publishing has done the task, and who runs it
        again finds that. An owner whose task was recovered meanwhile cannot finish it.
        """
        task = self._tasks.claim(owner, seconds)
        if task is None:
            return None
        try:
            done = f"task:{task['source']}"
            report = self.sync_source(task["source"], self.store.read([task["payload"]["snapshot"]]), task["base"], **{done: task["id"]})
        except Exception as e:  # noqa: BLE001 - the task fails with it
            return self._tasks.finish(task, error=str(e)[:1000])
        return self._tasks.finish(task, report)

    def recover_syncs(self, now: float | None = None) -> int:
        """End tasks of owners that are gone: done where their version was published, else failed."""
        for t in self._tasks.list(state=tasks.RUNNING):
            published = self.store.manifest()["meta"].get(f"task:{t['source']}") == t["id"]
            if published and t["until"] <= (time.time() if now is None else now):
                self._tasks.finish(t, {"source": t["source"], "revision": self.baseline(t["source"]).revision})
        return self._tasks.recover(now)

    def _index(self) -> fts.Index:
        m = self.store.manifest()
        postings, lengths = (self.store.live(k, self.store.read(m["tables"][k]), m) for k in ("postings", "lengths"))
        counts = m["counts"] or {}
        return fts.Index(postings, lengths, None, counts.get("chunks"), counts.get("tokens"))

    def retrieve(self, query: str, k: int | None = None, used: int = 0, rewrite: str | None = None) -> DataFrame:
        """The best chunks for a query. used: tokens of context taken already, which lower k where settings make it dynamic; rewrite: expansion, hyde or multi_query
        by the engine's language model, whose forms of the query are searched at once, a failing model leaving the query itself."""
        tables, cfg, e = self._tables(), self.settings.retrieve, self.settings.embedding
        if tables is None:
            return self.spark.createDataFrame([], "chunk_id long, text string, source string, vec_score double, bm25_score double, final_score double")
        k = k or cfg.top_k
        k = retrieval.room(k, used, cfg) if cfg.dynamic_top_k else k
        forms = retrieval.rewritten(query, rewrite, self.llm) if rewrite and self.llm else [query]
        if len(forms) == 1:
            found = retrieval.retrieve(*tables, self._index(), forms[0], self.model([e.query_prefix + forms[0]])[0], cfg, k)
        else:
            asked = [(i, q, v) for i, (q, v) in enumerate(zip(forms, self.model([e.query_prefix + q for q in forms])))]
            asked = self.spark.createDataFrame(asked, "query_id long, query string, qv array<double>")
            found = retrieval.hydrate(retrieval.best_of(tables[1], self._index(), asked, cfg, k), tables[0])
        if cfg.rerank and self.reranker is not None:
            return retrieval.reranked(found, query, self.reranker, cfg)
        return retrieval.rerank(found, retrieval.lexical_score(F.col("text"), query), cfg) if cfg.rerank else found

    def evidence(self, query: str) -> DataFrame:
        rows = self.retrieve(query).withColumn("q", F.lit(0)).withColumn("parent_text", F.lit(""))
        return citations.evidence(rows, "q", F.col("final_score").desc())

    def sources(self) -> DataFrame:
        return store.sources(self.store.table("chunks"))

    def delete_source(self, source: str) -> int:
        """Chunks of a source and its parts leave; writes their ids only."""
        start = self.store.version
        chunks, _ = self._tables()
        gone = chunks.where(store.of_source(source)).select("chunk_id")
        n = gone.count()
        self._append(chunks.where("false").withColumn("ord", F.lit(0)).drop("chunk_id"), ["source", "ord"], start, gone, drop=self._forgotten(start, source))
        return n

    def reset(self) -> None:
        """No chunks; ids go on from where they were."""
        start, top = self.store.version, self._top(self.store.version)
        held = self.store.manifest(start)["tables"]
        empty = {k: self.store.write(k, self.store.read(held[k]).where("false")) for k in store.KEYED if held.get(k)}
        self.store.publish(parts={k: [] for k in held} | {k: [p] for k, p in empty.items()}, sizes=dict.fromkeys(empty.values(), 0), top=top, counts={"chunks": 0, "tokens": 0}, expect=start)

    def rebuild(self, owner: str = "rebuild", seconds: float = 3600.0, span: int = 1 << 16) -> int:
        """Embed all chunks anew beside the live index, check, cut over. Writes are refused meanwhile, by any driver; reads go on.

        Ids go in ranges of `span`, more where there would be over 256; each finished range leaves a progress file. A rebuild whose driver died leaves a lease
        that runs out after `seconds`; the next rebuild of the same version, model and settings takes it over and goes on with the missing ranges. The
        lease is given back after the cut-over, so no writer slips in between; a holder whose lease was taken over cannot publish.
        """
        lease = self.store.freeze(owner, seconds)
        try:
            start = self.store.version
            m = self.store.manifest(start)
            chunks = self.store.table("chunks", start)
            top = self._top(start)
            span = max(span, top // 256 + 1)
            job = hashlib.sha256(repr((start, span, self.settings.embedding, getattr(self.model, "name", ""))).encode()).hexdigest()[:16]
            done = {int(n): self.store.text(f"REBUILD-{job}-{n}") for n in self.store.names(f"REBUILD-{job}-")}
            for at in range(0, top + 1, span):
                if at not in done:
                    done[at] = self.store.write("vectors", self._vectors(chunks.where((F.col("chunk_id") >= at) & (F.col("chunk_id") < at + span))))
                    self.store.create(f"REBUILD-{job}-{at}", done[at])
            parts = [done[at] for at in sorted(done)]
            fresh = self.store.read(parts)
            bad = [r for r in store.index_problems(chunks, fresh, self.settings.embedding.dims).collect() if r.n] + retrieval.probe(fresh)
            if bad:
                raise store.Conflict(str(bad))
            return self.store.publish(parts={"vectors": parts}, sizes=dict.fromkeys(parts, sum(m["sizes"].get(p, 0) for p in m["tables"]["chunks"]) // len(parts)), expect=start, lease=lease)
        finally:
            self.store.thaw(lease)

    def integrity(self) -> DataFrame:
        return store.index_problems(*self._tables(), self.settings.embedding.dims)
