"""Incremental sync: snapshot diff, revisions, tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrag.functions.text import chunk_key, newlines, ordinal_key, sha256_hex, trim_ws

DOCUMENT, CHUNK = ["source", "document_id"], ["source", "document_id", "chunk_key"]
#: Tables of a source's baseline; the store holds one of each a source, named `<table>:<source>`, so that a sync writes its own only. The latter two are logs: a
#: sync appends what changed, with its revision of the source (`at`) and the one that added the key (`first`); a null hash says that the key is gone.
TABLES = {
    "sync_sources": "revision long, identity string",
    "sync_documents": "source string, document_id string, content_hash string, first long, at long",
    "sync_chunks": "source string, document_id string, chunk_key string, content_hash string, first long, at long, chunk_id long",
}
KEYS = {"sync_documents": DOCUMENT, "sync_chunks": CHUNK}


@dataclass(frozen=True)
class Baseline:
    revision: int
    identity: str
    documents: DataFrame
    chunks: DataFrame


def latest(log: DataFrame, keys: list[str], whole: bool = True) -> DataFrame:
    """The last entry of each key of a log; keys that are gone drop out where the log is whole."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "at").alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))
    return last.where(F.col("content_hash").isNotNull()) if whole else last


def state(log: DataFrame, keys: list[str], revision: int) -> DataFrame:
    """Keys present with hash, first and revision, which grows by one a sync from 1."""
    return latest(log, keys).withColumn("revision", F.lit(revision) - F.col("first") + 1)


def changes(old: DataFrame, new: DataFrame, keys: list[str], revision: int, all_changed: bool = False) -> DataFrame:
    """The diff of a state and a snapshot's rows with their other columns, `old` ids, and the log's first and at for the sync to `revision`."""
    ids = ["chunk_id"] if "chunk_id" in old.columns else []
    a = old.select(*keys, F.col("content_hash").alias("old_hash"), F.col("first").alias("old_first"), *(F.col(c).alias(f"old_{c}") for c in ids))
    b = new.withColumnRenamed("content_hash", "new_hash")
    o, n = F.col("old_hash"), F.col("new_hash")
    kind = F.when(o.isNull(), "added").when(n.isNull(), "deleted").when((o == n) & F.lit(not all_changed), "unchanged").otherwise("changed")
    first = F.when(o.isNull(), F.lit(revision)).otherwise(F.col("old_first")).cast("long")
    return a.join(b, keys, "full_outer").withColumns({"class": kind, "first": first, "at": F.lit(revision).cast("long")})


def canonical(text: Column) -> Column:
    return trim_ws(F.regexp_replace(newlines(text), "\r", "\n"))


def content_hash(text: Column) -> Column:
    return sha256_hex(canonical(text))


def snapshot_documents(snapshot: DataFrame, source: str) -> DataFrame:
    """A snapshot's documents in canonical form, with their hashes."""
    text = canonical(F.coalesce(F.col("text"), F.lit("")))
    return snapshot.select(F.lit(source).alias("source"), trim_ws(F.col("document_id")).alias("document_id"), text.alias("text"), sha256_hex(text).alias("content_hash"), "title", "uri", "location")


def snapshot_chunks(pieces: DataFrame) -> DataFrame:
    """Chunks (pieces of a snapshot's documents: ord, text) with key and hash."""
    rows = pieces.select(*DOCUMENT, "title", "uri", "location", "ord", "text")
    return rows.withColumns({"chunk_key": chunk_key(F.col("source"), F.col("document_id"), ordinal_key(F.col("ord"))), "content_hash": content_hash(F.col("text"))})


def violations(snapshot: DataFrame, key: str) -> DataFrame:
    """Blank or repeated keys, which make a snapshot invalid as a whole."""
    k = trim_ws(F.coalesce(F.col(key), F.lit("")))
    return snapshot.groupBy(k.alias(key)).count().where((F.col(key) == "") | (F.col("count") > 1))


def diff(old: DataFrame, new: DataFrame, keys: list[str], identity_changed: bool = False) -> DataFrame:
    """keys, old_hash, new_hash, class (unchanged, added, changed, deleted). old and new: keys, content_hash."""
    a = old.select(*keys, F.col("content_hash").alias("old_hash"))
    b = new.select(*keys, F.col("content_hash").alias("new_hash"))
    o, n = F.col("old_hash"), F.col("new_hash")
    same = (o == n) & F.lit(not identity_changed)
    kind = F.when(o.isNull(), "added").when(n.isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, keys, "full_outer").withColumn("class", kind)


def counts(d: DataFrame) -> DataFrame:
    return d.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def to_embed(d: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose vectors must be computed; all others keep theirs."""
    return d.where(F.col("class").isin("added", "changed")).select(*keys)


def promoted(old: DataFrame, d: DataFrame, keys: list[str]) -> DataFrame:
    """The next baseline: keys present, their hash and revision (old + 1, from 1)."""
    rev = old.select(*keys, "revision")
    return d.where(F.col("new_hash").isNotNull()).join(rev, keys, "left").select(*keys, F.col("new_hash").alias("content_hash"), (F.coalesce("revision", F.lit(0)) + 1).cast("long").alias("revision"))
