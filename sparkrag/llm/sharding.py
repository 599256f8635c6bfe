"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled within their source by a seeded hash and ranked; a row's fractional rank is (2 rank - 1) / (2 rows of
its source). All rows in order of fractional rank are cut into equal runs, so each shard holds every source in
the corpus's proportion and row counts differ by one at most.

Ranks need no large sort: rows fall into hash buckets (rank within a source) and then into buckets of the fraction,
each bucket is ranked on its own and running totals of the bucket counts are added. A source with a third of all rows is spread over
all buckets.

Law: rows. Defined results: null text has size 1 and the checksum of the empty text; a null source is a source; null
and repeated doc_ids are rows like others (ties go by checksum, then arbitrarily among identical rows); an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.llm.common import crc32_text, stored


def _bucket_ranks(rows: DataFrame, keys: list[str], bucket: str, order: list[Column]) -> DataFrame:
    """Adds rank (from 0) within keys, by bucket and then order; one shuffle of the rows and one of the counts."""
    totals = Window.orderBy(bucket) if not keys else Window.partitionBy(*keys).orderBy(bucket)
    before = F.sum("n").over(totals.rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n")).select(*(F.col(k).alias(f"c_{k}") for k in [*keys, bucket]), F.coalesce(before, F.lit(0)).alias("before"))
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1)
    on = F.lit(True)
    for k in [*keys, bucket]:
        on = on & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    return ranked.join(counts, on).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", *(f"c_{k}" for k in [*keys, bucket]))


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_rows: int = 20_000, least_buckets: int = 1024) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\u0000")).alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    slim = slim.select("doc_id", "source", (F.octet_length("t") + 1).cast("long").alias("size"), crc32_text(F.col("t")).alias("text_crc32"))
    slim = stored(slim.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")), "sharding")
    per_source = slim.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    n = slim.count()
    bits = max(least_buckets, n // bucket_rows).bit_length()
    order = [F.col("h"), F.col("doc_id"), F.col("text_crc32")]
    rows = slim.withColumn("b", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    rows = _bucket_ranks(rows, ["source"], "b", order).drop("b")
    rows = rows.join(per_source, "source").withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("of")))
    rows = stored(rows.withColumn("b", F.floor(F.col("fraction") * (1 << bits)).cast("int")).drop("rank", "of"), "sharding")
    rows = _bucket_ranks(rows, [], "b", [F.col("fraction"), F.xxhash64("source"), F.col("source"), *order])
    place = F.floor(F.col("rank") * shards / F.lit(n)) if n == 0 else F.expr(f"(rank * {shards}) div {n}")
    # run k begins at the least rank with rank * shards >= k * n
    rows = rows.withColumn("shard", place.cast("int"))
    slot = F.expr(f"rank - (shard * cast({n} as bigint) + {shards - 1}) div {shards}")
    return rows.select("doc_id", F.when(F.col("source") != "\u0000", F.col("source")).alias("source"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"))


def shard_query(docs: DataFrame) -> DataFrame:
    found = interleave(docs)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
