"""Importance resampling towards a target: documents are drawn in proportion to how much likelier their n-grams are in the target.

Features are runs of 1 to `order` words, hashed into buckets. Two small aggregations count the buckets of all documents and of the target; their
log ratios are one array of `buckets` whole numbers, and a document's weight is the sum of that array over its features. Words of a task's block are hashed at
once, column by column of bytes, and the hash of a longer run continues the hash of the shorter one.

The draw takes the highest scores (weight and seeded Gumbel noise) among documents of enough words. Every partition sorts its own into a run, stored in
pieces. The pieces' first keys, a bounded and regular sample, give ranges of keys; counts of the ranges tell the rank each begins with and the last one
that is needed. Then one task a range merges the runs' slices in it with a tournament tree, writes ranks and stops at the exact number;
ranges beyond it are never read. No task holds more than a range, the driver holds bounds and counts of ranges (some 2 * `heads` at most, and one a run).

Defined results: null text has no words; no features: weight 0; a null doc_id hashes as no digits and comes last among equal scores; repeated rows are
drawn each for itself, in any order among themselves; an empty target makes all gains those of unseen features; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import blocks, first_of_runs, stored, text_bytes

BUCKETS, ORDER, LEAST_WORDS, SEED = 10_000, 3, 20, 42


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to words, their lower case (A-Z only), and the table of the reflected CRC-32 polynomial."""
    code = np.arange(256)
    low = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint8)
    inside = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1).astype(np.uint32)
    return inside, low, crc


_INSIDE, _LOW, _CRC = _tables()
_ALL = np.uint32(0xFFFFFFFF)
_SHORT = 48  # longer words are hashed one by one


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


class _Words:
    """Words of a window, by falling length, so that column j of bytes concerns the first of them only."""

    def __init__(self, low: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.low, self.starts, self.lengths = low, starts, lengths
        capped = np.minimum(lengths, _SHORT + 1).astype(np.uint8)
        self.order = np.argsort(_SHORT + 1 - capped, kind="stable")
        self.long = self.order[: int((capped > _SHORT).sum())]
        rest = self.order[len(self.long) :]
        self.rest, self.at = rest, starts[rest]
        self.alive = len(rest) - np.searchsorted(lengths[rest][::-1], np.arange(1, _SHORT + 1))

    def extend(self, state: np.ndarray) -> np.ndarray:
        """States of the checksum after each word, from the states before them."""
        out = state.copy()
        v = state[self.rest]
        for j, n in enumerate(self.alive.tolist()):
            if n == 0:
                break
            v[:n] = _step(v[:n], self.low[self.at[:n] + j])
        out[self.rest] = v
        for w in self.long.tolist():
            a = int(self.starts[w])
            out[w] = zlib.crc32(self.low[a : a + int(self.lengths[w])], int(state[w]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        return out


def hashed(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, order: int = ORDER, window: int = 1 << 16):
    """(texts' numbers of words, iterator of (text, bucket) arrays of all features), a window of words at a time."""
    inside = _INSIDE[data]
    starts = first_of_runs(inside, offsets)
    ends = np.flatnonzero(inside & np.append(~inside[1:], True)) + 1
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    edge = np.unique(edge[inside[edge - 1] & inside[edge]])  # words that only a limit between texts parts
    ends = np.sort(np.concatenate([ends, edge]))
    own = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(own, minlength=len(offsets) - 1)[: len(offsets) - 1]

    def parts():
        for at in range(0, len(starts), window):
            a, z = max(0, at - order + 1), min(len(starts), at + window)
            low = _LOW[data[starts[a] : ends[z - 1]]]
            text, words = own[a:z], _Words(low, starts[a:z] - starts[a], ends[a:z] - starts[a:z])
            state = words.extend(np.full(z - a, _ALL, np.uint32))
            for k in range(order):
                if k:
                    before = np.empty_like(state)
                    before[0], before[1:] = _ALL, state[:-1]
                    state = words.extend(_step(before, np.uint32(32)))
                whole = np.arange(a, z) >= at
                whole[:k] = False
                whole[k:] &= text[k:] == text[: max(0, len(text) - k)]
                yield text[whole], ((state[whole] ^ _ALL) % np.uint32(buckets)).astype(np.int64)

    return n_words, parts()


def n_features(words, order: int = ORDER):
    return sum(np.maximum(words - k, 0) for k in range(order))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Features of all texts by bucket: one number a bucket comes to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in blocks(batches, 0, 2 << 20):
            for _, bucket in hashed(*text_bytes(b.column(0)), buckets, order)[1]:
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.selectExpr("cast(text as string) text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of the smoothed shares of each bucket."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("row", pa.int64())])


def scored(docs: DataFrame, gain: np.ndarray, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """doc_id, words, n_features, weight, score and a row number of every document; one map."""
    buckets = len(gain)

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in blocks(batches, "text", 2 << 20):
            words, parts = hashed(*text_bytes(b.column(1)), buckets, order)
            weight = np.zeros(len(words), np.int64)
            for text, bucket in parts:
                if len(text):
                    a, z = int(text[0]), int(text[-1]) + 1
                    weight[a:z] += np.bincount(text - a, gain[bucket], z - a).astype(np.int64)
            noises = np.array([noise(i, seed) for i in b.column(0).to_pylist()], np.int64)
            yield pa.record_batch([b.column(0), pa.array(words), pa.array(n_features(words, order)), pa.array(weight), pa.array(weight + noises), pa.array(row + np.arange(len(words)))], schema=_SCORED)
            row += len(words)

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return slim.mapInArrow(run, "doc_id long, words long, n_features long, weight long, score long, row long")


_KEY = np.dtype([("score", "<i8"), ("doc", "<i8"), ("row", "<i8")])  # falling scores are kept negated, so keys rise
_NO_ID = np.iinfo(np.int64).max


def runs(rows: DataFrame, most: int, piece: int) -> DataFrame:
    """Sorted runs of (doc_id, score, row), one a partition, in pieces of keys with the first key beside; `most` keys of a run can be drawn at all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"]

    def pack(batches):
        from pyspark import TaskContext

        run, done, held = TaskContext.get().partitionId(), 0, []

        def cut(keys):
            nonlocal done
            keys = keys[: most - done]
            for at in range(0, len(keys), piece):
                part = keys[at : at + piece]
                head = part[0]
                yield pa.record_batch([pa.array([run], pa.int64()), pa.array([done], pa.int64()), pa.array([head["score"]], pa.int64()), pa.array([head["doc"]], pa.int64()), pa.array([head["row"]], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["run", "at", "score", "doc", "row", "keys"])
                done += len(part)

        for b in batches:
            keys = np.empty(b.num_rows, _KEY)
            keys["score"], keys["doc"], keys["row"] = -b.column(0).to_numpy(), b.column(1).fill_null(_NO_ID).to_numpy(), b.column(2).to_numpy()
            held.append(keys)
            if done < most and sum(map(len, held)) >= piece:
                keys = np.concatenate(held)
                full = len(keys) // piece * piece
                yield from cut(keys[:full])
                held = [keys[full:]]
        if done < most and held:
            yield from cut(np.concatenate(held))

    return rows.select("score", "doc_id", "row").sortWithinPartitions(*order).mapInArrow(pack, "run long, at long, score long, doc long, row long, keys binary")


class Tournament:
    """A loser tree over sorted sources: the root is the least key, and after each step only the matches on one leaf's path are played again."""

    def __init__(self, sources: list[list[tuple]]):
        self.sources = sources
        self.size = 1
        while self.size < len(sources):
            self.size *= 2
        self.at = [0] * len(sources)
        heads = [self._head(i) for i in range(self.size)]
        winner: list = [None] * self.size + heads
        self.losers: list = [None] * self.size
        for i in range(self.size - 1, 0, -1):
            a, b = winner[2 * i], winner[2 * i + 1]
            winner[i], self.losers[i] = (a, b) if self._less(a, b) else (b, a)
        self.best = winner[1]

    def _head(self, i: int) -> tuple | None:
        """(key, source) of a source's next key; None where it is done."""
        return (self.sources[i][self.at[i]], i) if i < len(self.sources) and self.at[i] < len(self.sources[i]) else None

    @staticmethod
    def _less(a, b) -> bool:
        return b is None or (a is not None and a <= b)

    def pop(self) -> tuple | None:
        won = self.best
        if won is None:
            return None
        i = won[1]
        self.at[i] += 1
        now, node = self._head(i), (self.size + i) // 2
        while node:
            if self._less(self.losers[node], now) and self.losers[node] is not None:
                now, self.losers[node] = self.losers[node], now
            node //= 2
        self.best = now
        return won[0]


def _cuts(bounds: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, start, end) of the slices of sorted keys by range; a key's range is the number of bounds that are not above it."""
    a, z = (int(np.searchsorted(bounds, keys[i], side="right")) for i in (0, -1))
    cut = [0, *np.searchsorted(keys, bounds[a:z], side="left").tolist(), len(keys)]
    return [(a + i, s, e) for i, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if s < e]


def ranked(rows: DataFrame, n: int, size: int = 8192, heads: int = 1 << 17) -> DataFrame:
    """row, rank (from 1) of the n first rows by falling score, then doc_id. Ranges hold about `size` keys each, more where n is above size * heads."""
    spark = rows.sparkSession
    if n <= 0:
        return spark.createDataFrame([], "row long, rank long")
    total = rows.count()
    piece = max(min(1024, size), total // heads)
    pieces = stored(runs(rows, n, piece), "runs")
    # one key a piece: at most `heads` and one a run
    firsts = pieces.select("score", "doc", "row").toArrow()
    keys = np.empty(firsts.num_rows, _KEY)
    for name in _KEY.names:
        keys[name] = firsts.column(name).to_numpy()
    keys.sort(order=_KEY.names)
    bounds = keys[max(1, size // piece) :: max(1, size // piece)]

    def sizes(batches):
        count = np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            for raw in b.column(0):
                for part, s, e in _cuts(bounds, np.frombuffer(raw.as_buffer(), _KEY)):
                    count[part] += e - s
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some), pa.array(count[some])], names=["part", "n"])

    count = np.zeros(len(bounds) + 1, np.int64)
    for r in pieces.select("keys").mapInArrow(sizes, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():
        count[r.part] = r.n
    before = np.concatenate([[0], np.cumsum(count)])
    last = int(np.searchsorted(before, n)) - 1  # the range in which the draw ends
    end = bounds[last] if last < len(bounds) else None

    def slices(batches):
        for b in batches:
            for run, at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own = np.frombuffer(raw.as_buffer(), _KEY)
                found = [x for x in _cuts(bounds, own) if x[0] <= last]
                if found:
                    yield pa.record_batch([pa.array([p for p, _, _ in found], pa.int64()), pa.array([run] * len(found), pa.int64()), pa.array([at + s for _, s, _ in found], pa.int64()), pa.array([own[s:e].tobytes() for _, s, e in found], pa.binary())], names=["part", "run", "at", "keys"])

    def merge(key, table):
        part = key[0].as_py()
        by_run: dict[int, list] = {}
        for run, at, raw in sorted(zip(table.column("run").to_pylist(), table.column("at").to_pylist(), table.column("keys").to_pylist())):
            by_run.setdefault(run, []).extend(np.frombuffer(raw, _KEY).tolist())
        tree, first = Tournament(list(by_run.values())), int(before[part])
        most = min(n - first, int(count[part]))
        won = [tree.pop()[2] for _ in range(most)]
        return pa.table({"row": pa.array(won, pa.int64()), "rank": pa.array(range(first + 1, first + 1 + most), pa.int64())})

    need = pieces
    if end is not None:  # pieces that begin after the last range are not read
        need = pieces.where(F.struct("score", "doc", "row") < F.struct(*(F.lit(int(end[x])).alias(x) for x in _KEY.names)))
    dealt = need.select("run", "at", "keys").mapInArrow(slices, "part long, run long, at long, keys binary")
    return dealt.groupBy("part").applyInArrow(merge, "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it is not drawn. Of the N documents of at least `least_words`
    words, floor(percent * N / 100) are drawn."""
    gain = gains(bucket_counts(docs, buckets, order), bucket_counts(target, buckets, order))
    rows = stored(scored(docs, gain, order, seed), "scored")
    able = rows.where(F.col("words") >= least_words)
    drawn = stored(ranked(able, percent * able.count() // 100), "drawn")
    return rows.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 by its table, over the distinct runs of words only.
SQL = r"""WITH RECURSIVE g AS (SELECT range::UBIGINT AS i, range::UBIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM g WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM g WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
m AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT doc_id, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS f FROM d, (VALUES (1), (2), (3)) x(k)),
t AS (SELECT unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS f FROM m, (VALUES (1), (2), (3)) x(k)),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM f UNION SELECT f FROM t)),
b AS (SELECT f, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
  lambda s, x: xor(s >> 8, t[(xor(s, x) & 255)::INT + 1]))) % 10000 AS bucket FROM u, crc),
s AS (SELECT bucket, count(*)::BIGINT AS n FROM f JOIN b USING (f) GROUP BY bucket),
v AS (SELECT bucket, count(*)::BIGINT AS n FROM t JOIN b USING (f) GROUP BY bucket),
a AS (SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM s) AS ss, (SELECT coalesce(sum(n), 0)::BIGINT FROM v) AS tt),
z AS (SELECT s.bucket, floor(1000 * ln(((coalesce(v.n, 0) + 1) * (ss + 10000))::DOUBLE / ((s.n + 1) * (tt + 10000))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN v USING (bucket), a),
w AS (SELECT doc_id, count(*)::BIGINT AS n, sum(gain)::BIGINT AS weight FROM f JOIN b USING (f) JOIN z USING (bucket) GROUP BY doc_id),
e AS (SELECT doc_id, len(d.w) AS words, coalesce(w.n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE words >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)"""
