"""The retrieval-feedback ledger: filters, pages, aggregates, candidates, retention, export."""

from __future__ import annotations

import json
import unicodedata
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.functions.text import fingerprint, redact_excerpt

# Kinds of feedback; the last needs citations.
KINDS = ("helpful", "unhelpful", "citation-error")


@dataclass
class Ledger:
    events: DataFrame
    citations: DataFrame
    feedback: DataFrame
    links: DataFrame
    candidates: DataFrame | None = None


@dataclass(frozen=True)
class Filter:
    kind: str = ""
    channel: str = ""
    retrieval_id: str = ""
    session_id: str = ""
    since: str = ""
    until: str = ""
    source: str = ""
    citation_id: str = ""
    candidate_status: str = ""
    superseded: bool = False
    notes: bool = False
    excerpts: bool = False
    cursor: str = ""
    limit: int = 100


def filtered(led: Ledger, f: Filter) -> DataFrame:
    """Feedback joined with its event, by the filter's fields; superseded rows only on request."""
    ev = led.events.select(F.col("id").alias("retrieval_id"), "channel", "query_fingerprint", "query_excerpt")
    rows = led.feedback.join(ev, "retrieval_id")
    tests = [F.col(k) == v for k, v in (("kind", f.kind), ("channel", f.channel), ("retrieval_id", f.retrieval_id), ("session_id", f.session_id)) if v]
    if f.since:
        tests.append(F.col("created_at") >= F.to_timestamp(F.lit(f.since)))
    if f.until:
        tests.append(F.col("created_at") <= F.to_timestamp(F.lit(f.until)))
    if tests:
        rows = rows.where(reduce(lambda a, b: a & b, tests))
    if f.source or f.citation_id:
        cit = led.citations
        cit = cit.where(F.col("source") == f.source) if f.source else cit
        cit = cit.where(F.col("id") == f.citation_id) if f.citation_id else cit
        hit = led.links.join(cit.select(F.col("id").alias("citation_id")), "citation_id").select(F.col("feedback_id").alias("id"))
        rows = rows.join(hit, "id", "left_semi")
    if f.candidate_status:
        rows = rows.join(led.candidates.where(F.col("status") == f.candidate_status).select(F.col("feedback_id").alias("id")), "id", "left_semi")
    if not f.superseded:
        newer = led.feedback.where("supersedes_feedback_id is not null and supersedes_feedback_id <> ''").select(F.col("supersedes_feedback_id").alias("id"))
        rows = rows.join(newer, "id", "left_anti")
    rows = rows.withColumn("note", F.col("note") if f.notes else F.lit(""))
    return rows.withColumn("query_excerpt", F.col("query_excerpt") if f.excerpts else F.lit(""))


def after(cursor: str) -> Column | None:
    """The keyset predicate of a cursor `timestamp|id`; None for one that cannot be read."""
    ts, sep, key = cursor.partition("|")
    if not sep or not ts or not key:
        return None
    t = F.to_timestamp(F.lit(ts))
    return (F.col("created_at") > t) | ((F.col("created_at") == t) & (F.col("id") > key))


def page(led: Ledger, f: Filter) -> DataFrame:
    """One page with a row more than the limit where another page follows, with citation ids."""
    rows = filtered(led, f)
    seek = after(f.cursor) if f.cursor else None
    rows = rows.where(seek) if seek is not None else rows
    rows = rows.orderBy("created_at", "id").limit(f.limit + 1)
    ids = led.links.groupBy(F.col("feedback_id").alias("id")).agg(F.array_sort(F.collect_list("citation_id")).alias("citation_ids"))
    return rows.join(ids, "id", "left").withColumn("citation_ids", F.coalesce("citation_ids", F.array().cast("array<string>")))


DIMENSIONS = {
    "kind": lambda: F.col("kind"),
    "channel": lambda: F.col("channel"),
    "source": lambda: F.coalesce("source", F.lit("")),
    "citation_rank": lambda: F.coalesce(F.col("rank").cast("string"), F.lit("")),
    "date": lambda: F.date_format("created_at", "yyyy-MM-dd"),
}


def aggregate(led: Ledger, dims: list[str], f: Filter = Filter()) -> DataFrame:
    """Counts of joined rows by dimensions (feedback with two citations counts twice), ordered by them."""
    if not dims or any(d not in DIMENSIONS for d in dims):
        raise ValueError("unknown dimension")
    cit = led.citations.select(F.col("id").alias("citation_id"), "source", "rank")
    rows = filtered(led, f).select("id", "kind", "channel", "created_at")
    rows = rows.join(led.links.withColumnRenamed("feedback_id", "id"), "id", "left").join(cit, "citation_id", "left")
    cols = [DIMENSIONS[d]().alias(d) for d in dims]
    return rows.select(*cols).groupBy(*dims).agg(F.count(F.lit(1)).alias("n")).orderBy(*dims)


def candidates_of(led: Ledger, f: Filter = Filter()) -> DataFrame:
    """A candidate for each feedback and citation (or one without), by a unique key."""
    ids = led.links.groupBy(F.col("feedback_id").alias("id")).agg(F.array_sort(F.collect_list("citation_id")).alias("cs"))
    rows = filtered(led, f).join(ids, "id", "left").select(F.col("id").alias("feedback_id"), "retrieval_id", "kind", "note", "query_fingerprint", F.explode_outer("cs").alias("citation_id"))
    rows = rows.withColumn("citation_id", F.coalesce("citation_id", F.lit("")))
    return rows.withColumn("uniqueness_key", F.concat_ws(":", "feedback_id", "citation_id")).withColumn("status", F.lit("pending"))


def convert(led: Ledger, f: Filter = Filter()) -> tuple[DataFrame, DataFrame]:
    """(new candidates, all wanted): keys that exist already are skipped."""
    wanted = candidates_of(led, f)
    return (wanted.join(led.candidates.select("uniqueness_key"), "uniqueness_key", "left_anti") if led.candidates is not None else wanted), wanted


def reviewed(cands: DataFrame, key: str, status: str, note: str = "", most: int = 1000) -> DataFrame:
    """A pending candidate becomes approved or rejected, once; other rows stay as they are. A key that is unknown or reviewed already is an error."""
    if status not in ("approved", "rejected"):
        raise ValueError("status")
    note = note.strip()
    if len(note) > most or any(unicodedata.category(c) == "Cc" and c not in "\n\t" for c in note):
        raise ValueError("note")
    hit = (F.col("uniqueness_key") == key) & (F.col("status") == "pending")
    if cands.where(hit).isEmpty():
        raise ValueError("candidate is unknown or already reviewed")
    for name, kind in (("review_note", "string"), ("reviewed_at", "timestamp")):
        cands = cands if name in cands.columns else cands.withColumn(name, F.lit(None).cast(kind))
    return cands.withColumns({"review_note": F.when(hit, F.lit(note)).otherwise(F.col("review_note")), "reviewed_at": F.when(hit, F.current_timestamp()).otherwise(F.col("reviewed_at")), "status": F.when(hit, F.lit(status)).otherwise(F.col("status"))})


def listed(led: Ledger, status: str = "", kind: str = "", source: str = "", limit: int = 100) -> DataFrame:
    """Candidates by status, kind and their citation's source, oldest first; at most `limit` (0 or less: 100), which is the page of the report."""
    rows = led.candidates
    if status:
        rows = rows.where(F.col("status") == status)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if source:
        rows = rows.join(led.citations.where(F.col("source") == source).select(F.col("id").alias("citation_id")), "citation_id", "left_semi")
    order = [c for c in ("created_at", "uniqueness_key") if c in rows.columns]
    return rows.orderBy(*order).limit(limit if limit > 0 else 100)


def recorded(results: DataFrame, query: str, channel: str, key: bytes, session: str = "", sessions: DataFrame | None = None, excerpt: int = 0) -> tuple[DataFrame, DataFrame]:
    """(event, citations) of one retrieval: results (chunk_id, source, parent_id, vec_score, bm25_score, final_score) in their order.

    excerpt: characters of the redacted query to keep, 0 none. A blank channel, a key of another length than 32 bytes and an unknown session are errors.
    """
    if not channel.strip():
        raise ValueError("channel")
    if len(key) != 32:
        raise ValueError("fingerprint key")
    if session and (sessions is None or sessions.where(F.col("id") == session).isEmpty()):
        raise ValueError("unknown session_id")
    spark, rid = results.sparkSession, str(uuid.uuid4())
    event = spark.range(1).select(F.lit(rid).alias("id"), F.current_timestamp().alias("created_at"), F.lit(channel).alias("channel"), F.lit(session).alias("session_id"), fingerprint(F.lit(query), key).alias("query_fingerprint"), F.lit(redact_excerpt(query, excerpt)).alias("query_excerpt"))
    # as many rows as a retrieval has results: one window over top-k rows
    order = F.row_number().over(Window.partitionBy("retrieval_id").orderBy(F.round("final_score", 9).desc(), "chunk_id"))
    rows = results.select(F.lit(rid).alias("retrieval_id"), "chunk_id", "source", (F.col("parent_id") if "parent_id" in results.columns else F.lit("")).alias("parent_id"), F.col("vec_score").alias("vector_score"), "bm25_score", "final_score")
    rows = rows.withColumn("rank", order).withColumn("id", F.concat_ws("-", "retrieval_id", "rank"))
    return event, rows


def retained(led: Ledger, cutoff: Column) -> Ledger:
    """Without feedback older than the cutoff, then without older events that have none, and what hangs on them."""
    fb = led.feedback.where(F.col("created_at") >= cutoff)
    ev = led.events.where(F.col("created_at") >= cutoff).unionByName(led.events.where(F.col("created_at") < cutoff).join(fb.select(F.col("retrieval_id").alias("id")), "id", "left_semi"))
    cit = led.citations.join(ev.select(F.col("id").alias("retrieval_id")), "retrieval_id", "left_semi")
    links = led.links.join(fb.select(F.col("id").alias("feedback_id")), "feedback_id", "left_semi")
    return Ledger(ev, cit, fb, links, led.candidates)


def checked(new: DataFrame, led: Ledger) -> DataFrame:
    """New feedback (id, retrieval_id, kind, session_id, note, supersedes_feedback_id, citation_ids) with an error column; null where it may be written."""
    ev = led.events.select(F.col("id").alias("retrieval_id"), F.col("session_id").alias("event_session"), F.lit(True).alias("known"))
    cit = led.citations.groupBy("retrieval_id").agg(F.collect_set("id").alias("own"))
    old = led.feedback.select(F.col("id").alias("supersedes_feedback_id"), F.col("retrieval_id").alias("old_retrieval"))
    rows = new.join(ev, "retrieval_id", "left").join(cit, "retrieval_id", "left").join(old, "supersedes_feedback_id", "left")
    named = F.coalesce("supersedes_feedback_id", F.lit("")) != ""
    error = (
        F.when(~F.col("kind").isin(*KINDS), "kind")
        .when(F.col("known").isNull(), "retrieval")
        .when(F.coalesce("session_id", F.lit("")) != F.coalesce("event_session", F.lit("")), "session")
        .when(named & (F.coalesce("old_retrieval", F.lit("")) != F.col("retrieval_id")), "supersedes")
        .when((F.col("kind") == KINDS[2]) & (F.size("citation_ids") <= 0), "citations missing")
        .when(F.size(F.array_distinct("citation_ids")) != F.size("citation_ids"), "duplicate citation")
        .when(F.size(F.array_except("citation_ids", F.coalesce("own", F.array().cast("array<string>")))) > 0, "citation")
    )
    return rows.withColumn("error", error).drop("event_session", "known", "own", "old_retrieval")


def exported(led: Ledger, f: Filter, most: int = 10_000) -> DataFrame:
    """The export's rows: schema version, fields, citation ids joined by semicolons. More than `most` rows are an error, not a cut."""
    if most < 1:
        raise ValueError("the export's maximum must be positive")
    ids = led.links.groupBy(F.col("feedback_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("citation_id")), ";").alias("citation_ids"))
    rows = filtered(led, f)
    if rows.limit(most + 1).count() > most:
        raise ValueError("the export exceeds its maximum")
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at")
    return rows.join(ids, "id", "left").select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("id").alias("feedback_id"), "retrieval_id", "kind", "session_id", F.coalesce("citation_ids", F.lit("")).alias("citation_ids"), stamp, "channel", "note", "query_excerpt")


SCHEMA_VERSION = "v1"


def export(led: Ledger, f: Filter, path: str, form: str = "jsonl", most: int = 10_000) -> None:
    """The export as text files under path: JSON lines, the first part a line of its filters, or CSV with a header."""
    rows = exported(led, f, most).repartition(1).sortWithinPartitions("created_at", "feedback_id")  # bounded by `most`
    if form == "csv":
        rows.write.option("header", "true").csv(path)
    elif form == "jsonl":
        meta = {"schema_version": SCHEMA_VERSION, "filters": {k: v for k, v in asdict(f).items() if v}, "notes_included": f.notes, "query_excerpts_included": f.excerpts}
        listed_ids = F.filter(F.split("citation_ids", ";"), lambda x: x != "")
        lines = rows.withColumn("citation_ids", listed_ids).select(F.lit(1).alias("o"), F.to_json(F.struct(*rows.columns)).alias("value"))
        head = led.feedback.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit(json.dumps(meta, sort_keys=True)).alias("value"))
        head.unionByName(lines).repartition(1).sortWithinPartitions("o", F.get_json_object("value", "$.created_at"), F.get_json_object("value", "$.feedback_id")).select("value").write.text(path)
    else:
        raise ValueError("format must be jsonl or csv")
