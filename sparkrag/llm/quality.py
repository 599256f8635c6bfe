"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score), score = w . x with weights shared by all grades and ordered thresholds.
Ratings come from the labels table: 0 low quality, 1 good but toxic, 2 good. x holds hashed text features (is a word
or a run of marks in the text?) and a few dense shares (capitals, digits, marks, distinct words, length). The model
gives the expected grade and the tail probability P(grade >= 2), by which documents are kept.

Only features that set a grade apart have weights: at least `least_held` labelled documents hold one, and the share of some grade
among them is `least_z` standard errors or more off its share of all (each grade by itself, as the middle one hardly moves the mean).
A word that only toxic documents hold needs two where one labelled document in ten is toxic. With weights for all features fewer
toxic documents are found.

The fit takes labelled rows in order of a hash of doc_id up to `max_fit` (a documented bound on the fit alone); scoring covers
every row and its whole text in one map over the scan.

Defined results: null or empty text has expected grade 0, tail probabilities 0 and is not kept; without labels every
text has the middle grade and is kept; several labels of a document all count; null labels are left out; rows repeat as they come; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import blocks, byte_codes, first_of_runs, run_hashes, text_bytes

GRADES = 3
DENSE = 7
_CODES = byte_codes(5)
_KIND = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 mark
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _a, _b in ((65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1
_KIND[48:58] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48


def features(col: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets n+1, distinct hashed features by row, dense shares) of a text column."""
    data, o = text_bytes(col)
    n = len(o) - 1
    size = np.diff(o)
    if not len(data):
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros((n, DENSE))
    kind = _KIND[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    edge = o[:-1]
    change[edge[edge < len(data)]] = True
    starts = np.flatnonzero(change & (kind > 0))
    h = run_hashes(_FOLD[data], starts, kind > 0, _CODES)
    # reduceat runs to the next start, over blanks (0) only
    row = np.searchsorted(o, starts, side="right") - 1
    upper = (data >= 65) & (data < 91)
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    key = np.unique((row << bits) | (h & np.uint64((1 << bits) - 1)).astype(np.int64))
    at = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << bits)
    dense = np.zeros((n, DENSE))

    def share(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[o[1:]] - c[o[:-1]]) / np.maximum(size, 1)

    runs = np.diff(first)
    dense[:, 0] = share(upper)
    dense[:, 1] = share(kind == 2)
    dense[:, 2] = share(kind == 3)
    dense[:, 3] = share(kind == 0)
    dense[:, 4] = np.diff(at) / np.maximum(runs, 1)
    dense[:, 5] = np.log1p(size) / 10
    dense[:, 6] = np.minimum(size / np.maximum(runs, 1), 50) / 50
    return at, key & ((1 << bits) - 1), dense


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights over hashed and dense features with ordered thresholds."""

    def __init__(self, bits: int):
        self.bits = bits
        self.w = np.zeros(1 << bits)
        self.v = np.zeros(DENSE)
        self.mean, self.scale = np.zeros(DENSE), np.ones(DENSE)
        self.theta = np.array([-1.0, 1.0])

    def score(self, at, feats, dense) -> np.ndarray:
        c = np.concatenate([[0.0], np.cumsum(self.w[feats])])
        return (c[at[1:]] - c[at[:-1]]) + ((dense - self.mean) / self.scale) @ self.v

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2) as columns."""
        return 1 - _sigmoid(self.theta[None, :] - score[:, None])

    def fit(self, at, feats, dense, grade, epochs: int = 80, rate: float = 0.3, l2: float = 1e-5, batch: int = 256, least_z: float = 4.0, least_held: int = 2, seed: int = 3):
        """Maximum likelihood by AdaGrad over shuffled minibatches; thresholds stay ordered."""
        rng = np.random.default_rng(seed)
        n = len(grade)
        self.mean, self.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
        z = (dense - self.mean) / self.scale
        # only features of least_held rows or more whose share of a grade is least_z standard errors off that of all rows have weights
        held = np.bincount(feats, minlength=len(self.w))
        of = np.repeat(grade, np.diff(at))
        self.used = np.zeros(len(self.w), bool)
        for k in range(GRADES):
            p = (grade == k).mean()
            off = np.abs(np.bincount(feats[of == k], minlength=len(self.w)) - held * p) / np.maximum(np.sqrt(held * p * (1 - p)), 1e-9)
            self.used |= (held >= least_held) & (off >= least_z)
        at, feats = np.concatenate([[0], np.cumsum(self.used[feats])])[at], feats[self.used[feats]]
        share = np.clip(np.cumsum(np.bincount(grade, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
        self.theta = np.log(share / (1 - share))
        gw, gv, gt = np.full(len(self.w), 1e-3), np.full(DENSE, 1e-3), np.full(GRADES - 1, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(n)
            for b in range(0, n, batch):
                rows = order[b : b + batch]
                length = at[rows + 1] - at[rows]
                pick = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                f = feats[pick]
                owner = np.repeat(np.arange(len(rows)), length)
                s = np.bincount(owner, self.w[f], minlength=len(rows)) + z[rows] @ self.v
                edges = np.concatenate([[-np.inf], self.theta, [np.inf]])
                g = grade[rows]
                hi, lo = _sigmoid(edges[g + 1] - s), _sigmoid(edges[g] - s)
                hi, lo = np.where(g == GRADES - 1, 1.0, hi), np.where(g == 0, 0.0, lo)
                p = np.maximum(hi - lo, 1e-9)
                dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
                ds = (dhi - dlo) / len(rows)  # of the negative log-likelihood
                grad = np.bincount(f, ds[owner], minlength=0)
                idx = np.flatnonzero(grad)
                step = grad[idx] + l2 * self.w[idx]
                gw[idx] += step * step
                self.w[idx] -= rate * step / np.sqrt(gw[idx])
                step = z[rows].T @ ds + l2 * self.v
                gv += step * step
                self.v -= rate * step / np.sqrt(gv)
                step = np.array([-(dhi[g == k].sum() - dlo[g == k + 1].sum()) for k in range(GRADES - 1)]) / len(rows)
                gt += step * step
                self.theta = np.maximum.accumulate(self.theta - rate * step / np.sqrt(gt))
        return self


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 low quality, 1 good but toxic, 2 good."""
    good = F.col("quality").cast("int")
    return labels.where("quality is not null and toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(good < 1, 0).when(F.col("toxic").cast("int") > 0, 1).otherwise(2).alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = 20_000, bits: int = 18, seed: int = 3) -> Ordinal | None:
    """The model from at most about max_fit labelled rows, chosen by a hash of doc_id before texts are read; None without any."""
    rated = ratings(labels)
    n = rated.count()
    if n > max_fit:
        rated = rated.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_fit / n))
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("text is not null and text <> ''")
    # at most max_fit rows of two numbers: bounded, so broadcast
    found = texts.join(F.broadcast(rated), "doc_id")

    def run(batches):
        for b in blocks(batches, "text", 2 << 20):
            at, feats, dense = features(b.column(1), bits)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(feats.astype(np.int32)))
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(at), dtype=np.int32) * DENSE), pa.array(dense.ravel()))
            yield pa.record_batch([b.column(0), b.column(2), lists, wide], names=["doc_id", "grade", "f", "d"])

    table = found.select("doc_id", "text", "grade").mapInArrow(run, "doc_id long, grade int, f array<int>, d array<double>").toArrow().combine_chunks()
    if not table.num_rows:
        return None
    table = table.sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    flat = lambda c: (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c)
    f, d = flat(table.column("f")), flat(table.column("d"))
    at = f.offsets.to_numpy().astype(np.int64)
    feats = f.flatten().to_numpy().astype(np.int64)
    dense = d.flatten().to_numpy().reshape(-1, DENSE)
    return Ordinal(bits).fit(at - at[0], feats, dense, table.column("grade").to_numpy().astype(np.int64), seed=seed)


def grade(docs: DataFrame, model: Ordinal | None, keep_at: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_good (P(grade >= 1)), p_best (P(grade >= 2)), keep of every row."""
    scored = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_scorer(model, keep_at, [0], 1), "doc_id long, expected_grade double, p_good double, p_best double, keep boolean")
    return scored


def select(docs: DataFrame, model: Ordinal | None, keep_at: float = 0.5) -> DataFrame:
    """The rows of docs that the model keeps, with all their columns."""
    names = docs.columns
    run = _scorer(model, keep_at, None, names.index("text"))
    return docs.mapInArrow(run, docs.schema)


def _scorer(model, keep_at, carry, i_text):
    def run(batches):
        for b in blocks(batches, i_text, 2 << 20):
            col = b.column(i_text)
            size = np.diff(text_bytes(col)[1])
            if model is None:
                tails = np.tile([1.0, 0.5], (len(size), 1))
            else:
                tails = model.tails(model.score(*features(col, model.bits)))
            tails[size == 0] = 0.0
            keep = tails[:, 1] >= keep_at
            if carry is None:
                yield b.filter(pa.array(keep))
            else:
                yield pa.record_batch([*(b.column(k) for k in carry), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(keep)], names=["doc_id", "expected_grade", "p_good", "p_best", "keep"])

    return run
