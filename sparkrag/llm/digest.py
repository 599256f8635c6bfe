"""Canonical exact digests of documents.

A text is brought to NFKC, case-folded, its white space folded to single spaces, and hashed with 128-bit xxh3.
Equal digests form a bucket; inside each bucket of more than one row the canonical texts are compared byte for byte
(their least and greatest are equal or the bucket is split), so a fingerprint stands for one canonical text.

Defined results: null text is empty and has the empty text's fingerprint; repeated rows and ties of doc_id stand in
order of their text; null doc_ids come first; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.llm.common import blocks, stored


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest_of(canon: str) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def digests(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_chars and digest of each row, with the canonical text if asked for."""

    def run(batches):
        for b in blocks(batches, "text", 8 << 20):
            texts = [t or "" for t in b.column(1).to_pylist()]
            canon = [canonical(t) for t in texts]
            cols = [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(map(digest_of, canon), pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(canon, pa.string())] * keep_text, ["doc_id", "n_chars", "digest", "canonical"][: 3 + keep_text])

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return slim.mapInArrow(run, "doc_id long, n_chars long, digest string" + ", canonical string" * keep_text)


#: Digests of more than one row up to which they are broadcast (32 characters each); beyond it the join shuffles.
BROADCAST_DIGESTS = 500_000


def split_buckets(texts: DataFrame, found: DataFrame) -> DataFrame | None:
    """(digest, canonical, part) of the buckets in `found` (column digest) whose canonical texts in `texts` differ; None if none does."""
    shared = stored(found.groupBy("digest").count().where("count > 1").select("digest"), "digests")
    few = shared.count() <= BROADCAST_DIGESTS
    same = texts.join(F.broadcast(shared) if few else shared, "digest", "left_semi")
    differ = same.groupBy("digest").agg(F.min("canonical").alias("a"), F.max("canonical").alias("b")).where("a <> b").select("digest")
    differ = stored(differ, "collisions")
    if differ.isEmpty():
        return None
    apart = same.join(differ, "digest", "left_semi").select("digest", "canonical").distinct()
    return apart.withColumn("part", F.row_number().over(Window.partitionBy("digest").orderBy("canonical")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, group_id (least doc_id with that fingerprint) of each row."""
    rows = stored(digests(docs), "fingerprints")
    parts = split_buckets(digests(docs, True), rows)
    if parts is not None:
        rows = digests(docs, True).join(parts, ["digest", "canonical"], "left").select("doc_id", "n_chars", F.concat_ws("-", "digest", F.col("part").cast("string")).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("group_id"))
    return rows.join(first, "digest").select("doc_id", "n_chars", F.col("digest").alias("fingerprint"), "group_id")


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with likenesses (1 if the canonical texts are equal, else 0).

    The edited text ends with the beginning of the next document by doc_id. Rows are dealt into ranges of doc_id cut at
    quantiles; the first document of a range is also sent to the range before it, so neighbours meet after one shuffle.
    """
    spark = docs.sparkSession
    slim = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    n = 3 * min(3000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = slim.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    def place(ids: pa.Array) -> np.ndarray:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        at = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(known, at, 0)

    def lowest(batches):
        least: dict[int, int | None] = {}
        for b in batches:
            for p, i in zip(place(b.column(0)).tolist(), b.column(0).to_pylist()):
                old = least.get(p, i)
                least[p] = None if i is None or old is None else min(old, i)
        yield pa.record_batch([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64()), pa.array([v is None for v in least.values()], pa.bool_())], names=["place", "doc_id", "none"])

    # at most n rows: the ranges' first ids
    rows = slim.select("doc_id").mapInArrow(lowest, "place int, doc_id long, none boolean").groupBy("place").agg(F.min("doc_id").alias("doc_id"), F.max("none").alias("none")).collect()
    firsts = sorted((r.place, None if r["none"] else r.doc_id) for r in rows)
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}  # the first of all goes after the last

    def deal(batches):
        for b in batches:
            at = place(b.column(0)).astype(np.int32)
            ids = b.column(0).to_pylist()
            yield pa.record_batch([pa.array(at), pa.array(np.zeros(len(at), bool)), b.column(0), b.column(1)], names=["place", "ahead", "doc_id", "text"])
            more = [k for k, i in enumerate(ids) if i in before]
            if more:
                take = b.take(pa.array(more))
                yield pa.record_batch([pa.array([before[ids[k]] for k in more], pa.int32()), pa.array([True] * len(more)), take.column(0), take.column(1)], names=["place", "ahead", "doc_id", "text"])

    dealt = slim.mapInArrow(deal, "place int, ahead boolean, doc_id long, text string").repartition("place").sortWithinPartitions("place", "ahead", "doc_id", "text")

    names = ["doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def pairs(batches):
        last = None  # (place, doc_id, text, canonical, digest) that waits for the next

        def row(cur, nxt):
            _, i, t, canon, d = cur
            k = len(t) // 4
            edited = t[: len(t) - k] + nxt[2][:k]
            e = canonical(edited)
            return i, len(t), hashlib.sha256(edited.encode()).hexdigest(), d, d if e == canon else digest_of(e), float(e == canon), float(nxt[3] == canon)

        for b in blocks(batches, "text", 4 << 20):
            out = []
            for p, ahead, i, t in zip(*(b.column(k).to_pylist() for k in range(4))):
                t = t or ""
                canon = canonical(t)
                cur = (p, i, t, canon, digest_of(canon))
                if last is not None and last[0] == p:
                    out.append(row(last, cur))
                last = None if ahead else cur
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    found = dealt.mapInArrow(pairs, "doc_id long, n_chars long, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double")
    found = stored(found, "edits")
    parts = split_buckets(digests(docs, True), found)
    shown = found
    if parts is not None:  # unlike texts under one 128-bit digest: number them
        by_doc = digests(docs, True).join(parts, ["digest", "canonical"], "left").select("doc_id", "digest", F.concat_ws("-", "digest", F.col("part").cast("string")).alias("own")).distinct()
        shown = found.join(by_doc, ["doc_id", "digest"], "left").withColumn("digest", F.coalesce("own", "digest"))
    return shown.select("doc_id", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.when(F.col("near_edited") == 1, F.col("digest")).otherwise(F.col("edited_digest")).alias("edited_fingerprint"), "near_edited", "near_next")
