"""Exact top-k search by distributed histogram selection.

Components are made whole numbers, so scores are whole numbers and exact. Candidates and queries are packed into blocks of rows, stored once; every
pair of a query block and a candidate block is scored as one matrix product. The k-th score of each query is located by global
histograms: a pass counts each query's scores in `bins` equal bins of its range, the counts of all blocks are added, and the bin in which the k-th score lies
is the range of the next pass, until a bin is one number. From a pair of blocks only the highest bins travel that hold k scores, as lower
ones cannot hold the k-th score of all. The last pass keeps the scores above the k-th one and, of those equal to it, the smallest ids, which settles ties.

The pairs are an equi-join: candidate blocks are dealt to slabs, query blocks are copied to each slab. Nothing but the number of blocks,
the greatest norm and the widest range comes to the driver; memory is that of a few blocks; every pass reads stored tables, so lost
tasks are run again. Work grows with queries times candidates: this is the exact search of a stated query set.

Defined results: a vector that is null, or that holds null or a component that is not finite (scaled), takes no part, nor does a row without id or a candidate of another
dimension than the query's. Candidates with the query's own id are its own. Repeated candidates count each; repeated queries of equal vectors count
once, of unlike vectors each for itself. Scores beyond 61 bits stay at that bound. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.llm.common import stored

MOST = (1 << 61) - 1  # scores stay within +-MOST
_NONE = -(1 << 63) + 1  # the query's own row

_BLOCK = "block long, n int, dims int, norm double, ids binary, wide boolean, vectors binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("norm", pa.float64()), ("ids", pa.binary()), ("wide", pa.bool_()), ("vectors", pa.binary())])


def usable(rows: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """id, v of the rows that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) != float("inf")))
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))


def packed(rows: DataFrame, scale: float, size: int) -> DataFrame:
    """Blocks of at most `size` rows (id, v) of one dimension: ids in rising order and floor(scale * v), as 4-byte floats where these hold it exactly."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        held: dict[int, list] = {}

        def block(dims: int):
            nonlocal number
            ids, x = (np.concatenate(p) for p in zip(*held.pop(dims)))
            by_id = np.argsort(ids, kind="stable")
            ids, x = ids[by_id], x[by_id]
            wide = bool(x.size and np.abs(x).max() >= 1 << 24)
            norm = float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))
            row = [[number], [len(ids)], [dims], [norm], [ids.astype("<i8").tobytes()], [wide], [x.astype("<f8" if wide else "<f4").tobytes()]]
            number += 1
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(row, _BLOCK_SCHEMA)], schema=_BLOCK_SCHEMA)

        for b in batches:
            ids, v = b.column(0).to_numpy(), b.column(1)
            sizes = v.value_lengths().to_numpy()
            for dims in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dims)
                x = v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), dims)
                x = np.floor(scale * x)
                for at in range(0, len(own), size):
                    have = sum(len(i) for i, _ in held.get(dims, ()))
                    if have and have + len(own[at : at + size]) > size:
                        yield block(dims)
                    held.setdefault(dims, []).append((ids[own[at : at + size]], x[at : at + size]))
        for dims in list(held):
            yield block(dims)

    return rows.mapInArrow(run, _BLOCK)


def _matrix(raw, wide: bool, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8" if wide else "<f4").reshape(n, dims)


def scores(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of whole numbers as 64-bit integers; bound: on the product of the norms, which no partial sum passes."""
    if bound < 1 << 24:
        return (q.astype(np.float32, copy=False) @ c.astype(np.float32, copy=False).T).astype(np.int64)
    if bound < 1 << 53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(c).T, -MOST, MOST).astype(np.int64)


class Pair:
    """A query block against a candidate block."""

    def __init__(self, row: dict, rows: int = 64):
        self.n, self.m, dims = row["n"], row["c_n"], row["dims"]
        self.q, self.c = _matrix(row["vectors"], row["wide"], self.n, dims), _matrix(row["c_vectors"], row["c_wide"], self.m, dims)
        self.q_ids, self.c_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["c_ids"], "<i8")
        self.bound, self.rows = row["norm"] * row["c_norm"] * (1 + 1e-9) + 1, rows
        self.queries = (row["block"] << 20) + np.arange(self.n)

    def parts(self):
        """(slice of the queries, scores), own candidates marked as none."""
        a, z = np.searchsorted(self.c_ids, self.q_ids, "left"), np.searchsorted(self.c_ids, self.q_ids, "right")
        for at in range(0, self.n, self.rows):
            own = slice(at, min(self.n, at + self.rows))
            s = scores(self.q[own], self.c, self.bound)
            for i in range(own.start, own.stop):
                s[i - at, a[i] : z[i]] = _NONE
            yield own, s


def _pairs(asked: DataFrame, cands: DataFrame, slabs: int) -> DataFrame:
    """All pairs of blocks of one dimension, by slab."""
    c = cands.select("dims", F.pmod(F.xxhash64("block"), F.lit(slabs)).alias("slab"), *(F.col(x).alias(f"c_{x}") for x in ("n", "norm", "ids", "wide", "vectors")))
    q = asked.withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))))
    return q.join(c, ["slab", "dims"])


def _rows(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def histograms(bins: int):
    """Counts of scores by bin within each query's range: query, low (of the bin), n."""

    def run(batches):
        for b in batches:
            for row in _rows(b):
                pair, state = Pair(row), np.array([(s["low"], s["span"], s["need"]) for s in row["state"]], np.int64)
                low, span, need = state[:, :1], state[:, 1:2], state[:, 2:]
                width = -(-span // bins)
                out = []
                for own, s in pair.parts():
                    lo, w = low[own], width[own]
                    inside = (s >= lo) & (s - lo < span[own])
                    r, _ = where = np.nonzero(inside)
                    at = (s[where] - lo[r, 0]) // w[r, 0]
                    n = np.bincount(r * bins + at, minlength=len(s) * bins).reshape(len(s), bins)
                    above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
                    i, j = np.nonzero((n > 0) & (above < need[own]))
                    out.append((pair.queries[own][i], lo[i, 0] + j * w[i, 0], n[i, j]))
                q, at, n = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch([pa.array(q), pa.array(at), pa.array(n)], names=["query", "low", "n"])

    return run


def winners(batches):
    """query, query_id, id, score: scores above the k-th and, of those equal to it, as many of the smallest ids as can be needed."""
    for b in batches:
        for row in _rows(b):
            pair, state = Pair(row), np.array([(s["low"], s["need"]) for s in row["state"]], np.int64)
            out = []
            for own, s in pair.parts():
                low, need = state[own, :1], state[own, 1:]
                equal = s == low
                take = ((s > low) & (s != _NONE)) | (equal & (np.cumsum(equal, axis=1) <= need))  # ids rise along a block
                i, j = np.nonzero(take)
                out.append((pair.queries[own][i], pair.q_ids[own][i], pair.c_ids[j], s[i, j]))
            q, q_id, c_id, score = (np.concatenate(x) for x in zip(*out))
            yield pa.record_batch([pa.array(q), pa.array(q_id), pa.array(c_id), pa.array(score)], names=["query", "query_id", "id", "score"])


def _with_state(asked: DataFrame, state: DataFrame) -> DataFrame:
    """Blocks with the states of their queries in order; a block has at most `query_block` of them."""
    per = state.groupBy(F.shiftright("query", 20).alias("block")).agg(F.array_sort(F.collect_list(F.struct("query", "low", "span", "need"))).alias("state"))
    return asked.join(per, "block")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, bins: int = 512, query_block: int = 512, candidate_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), id, score: the k highest inner products of every row for which is_query holds, among all rows but its own; ties go
    to the smaller id."""
    own = usable(rows, key, vector, scale)
    cands = stored(packed(own, scale, candidate_block), "candidates")
    chosen = usable(rows.where(is_query), key, vector, scale).distinct()
    n = chosen.count()
    asked = stored(packed(chosen.repartition(max(1, n // query_block)), scale, query_block), "queries")
    n_blocks, norm = cands.agg(F.count(F.lit(1)), F.max("norm")).first()
    slabs = max(1, min(n_blocks, max(2 * rows.sparkSession.sparkContext.defaultParallelism, n_blocks // 8)))
    # Cauchy-Schwarz bounds a query's scores
    reach = F.ceil(F.least(F.col("norm") * float(norm or 0) * (1 + 1e-9) + 1, F.lit(float(MOST))))
    numbers = asked.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "block", reach.alias("reach"))
    numbers = numbers.select((F.shiftleft("block", 20) + F.col("i")).alias("query"), "reach")
    state = numbers.select("query", (-F.col("reach")).alias("low"), (F.col("reach") * 2 + 1).alias("span"), F.lit(k).cast("long").alias("need"))
    down = Window.partitionBy("query").orderBy(F.col("low").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = False
    while not last:
        blocks = stored(_with_state(asked, state), "query-states")
        widest = blocks.agg(F.max(F.array_max(F.transform("state", lambda s: s["span"])))).first()[0]
        last = widest is None or widest <= bins
        counts = _pairs(blocks, cands, slabs).mapInArrow(histograms(bins), "query long, low long, n long").groupBy("query", "low").agg(F.sum("n").alias("n"))
        now = blocks.select(F.explode("state").alias("s")).select("s.query", F.col("s.low").alias("from"), "s.span", "s.need")
        found = counts.withColumn("upto", F.sum("n").over(down)).join(now, "query")
        # the first bin, from above, with which there are enough; it ends where the range did, at the latest
        hit = found.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        width = F.expr(f"(span + {bins - 1}) div {bins}")
        hit = hit.select("query", "low", F.least(width, F.col("from") + F.col("span") - F.col("low")).alias("span"), (F.col("need") - F.col("upto") + F.col("n")).alias("need"))
        # fewer than k candidates: all of them
        few = numbers.join(hit, "query", "left_anti").select("query", F.lit(-MOST - 1).cast("long").alias("low"), F.lit(1).cast("long").alias("span"), F.lit(0).cast("long").alias("need"))
        state = stored(hit.unionByName(few), "states")
    rows_out = _pairs(_with_state(asked, state), cands, slabs).mapInArrow(winners, "query long, query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return rows_out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
