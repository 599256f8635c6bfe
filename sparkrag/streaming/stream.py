"""Continuous ingest, sync and metrics with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkrag.engine import Engine
from sparkrag.operators.store import Conflict


def outcomes(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """start, kind, n, total by tumbling windows; with a watermark on streams."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    return rows.groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


# Upper bounds of the buckets of durations, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def histograms(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str | None = "10 minutes", bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """start, kind, n, total and at_most: for each bound how many values do not exceed it, by tumbling windows; with a watermark on streams. The state of a window
    is a sum for each bound, so parts of it merge before they travel and late rows add to it. A null value counts in n alone."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    sums = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    found = rows.groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), *sums)
    return found.select(F.col("window.start").alias("start"), kind, "n", "total", F.array(*(F.coalesce(f"b{i}", F.lit(0)) for i in range(len(bounds)))).alias("at_most"))


def merged(parts: DataFrame, kind: str) -> DataFrame:
    """Histograms of the same windows and bounds as one each."""
    n = F.max(F.size("at_most"))
    rows = parts.groupBy("start", kind).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.collect_list("at_most").alias("x"), n.alias("m"))
    add = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.aggregate("x", F.lit(0).cast("long"), lambda s, a: s + F.get(a, i)))
    return rows.select("start", kind, "n", "total", add.alias("at_most"))


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, name: str = "ingest"):
    """Documents (source, text and perhaps title, uri, location) of a stream into the engine's chunks, vectors and full-text index: one publish a batch, after which
    they are found. The version that holds a batch also holds its number under the stream's name, and later versions keep it: a batch that is run again after a
    restart changes nothing. Another writer in between makes the batch start anew."""
    key = f"epoch:{name}"

    def batch(df: DataFrame, epoch: int) -> None:
        for _ in range(10):
            if engine.store.manifest()["meta"].get(key, -1) >= epoch:
                return
            try:
                engine.ingest(df, **{key: epoch})
                return
            except Conflict:
                continue
        raise Conflict("the batch was always overtaken")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def sync(stream: DataFrame, engine: Engine, checkpoint: str, name: str = "sync"):
    """Documents (source, document_id, text, at and perhaps title, uri, location) of a stream as changes of their sources: of each document the last row of a batch
    by `at` holds, a null text deletes it. The state that a batch is held against is the baseline of the documents it names, in the store; a source's chunks, vectors,
    postings and baseline come out in one version, which also holds the batch's number for the source. So a batch that broke off between two sources goes on with
    the second after a restart."""

    def batch(df: DataFrame, epoch: int) -> None:
        keys, rest = ["source", "document_id"], [c for c in df.columns if c not in ("source", "document_id")]
        rows = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "at").alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest)).persist()
        try:
            for r in rows.select("source").distinct().orderBy("source").collect():  # a batch's sources
                key, own = f"epoch:{name}:{r.source}", rows.where(F.col("source") == r.source)
                for left in reversed(range(10)):
                    if engine.store.manifest()["meta"].get(key, -1) >= epoch:
                        break
                    try:
                        engine.sync_source(r.source, own.where("text is not null").drop("source", "at"), only=own, **{key: epoch})
                        break
                    except Conflict:
                        if not left:
                            raise
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def worker(snapshots: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, every: str = "250 milliseconds"):
    """A sync worker: each micro-batch of snapshot rows goes through `apply` in order."""
    return snapshots.writeStream.foreachBatch(lambda df, _: apply(df)).option("checkpointLocation", checkpoint).trigger(processingTime=every)


class Manifests(StatefulProcessor):
    """Evidence manifests by id with a time to live: a row (id, payload) stores or, with null payload, reads one."""

    def __init__(self, ttl_ms: int = 3_600_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("manifest", "payload string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        for df in rows:
            for payload in df["payload"]:
                if payload is not None:
                    self.kept.update((payload,))
                out.append((key[0], self.kept.get()[0] if self.kept.exists() else None))
        yield pd.DataFrame(out, columns=["id", "payload"])

    def close(self) -> None:
        pass


def manifests(stream: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    return stream.groupBy("id").transformWithStateInPandas(Manifests(ttl_ms), "id string, payload string", "Append", "processingTime")
