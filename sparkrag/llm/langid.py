"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds its letters' vectors (element-wise product)
after permuting them by their position (cyclic shifts by 2, 1 and 0). A text's vector bundles (sums) its trigrams'
vectors; a language's prototype bundles the unit vectors of its training texts. A text gets the language of the
prototype with the greatest cosine. Texts are lower-cased; everything that is no letter is a word boundary.

Training takes labelled rows in order of a hash of doc_id up to `max_train` rows (a documented bound of the fit only; every
row's whole text is predicted). Prototypes are summed by partitions, so the driver gets languages x dimensions numbers.

Memory is bounded by the block of 2 MB of text: besides it, three vectors for each letter of the block's alphabet and tables of counts of at most 16 MB.

Defined results: null text or one without a letter is `und` with score 0; with nothing to learn from every row is
`und`; scores are cosines clipped to 0..1; ties go to the first language in alphabetical order; rows repeat as they come;
null doc_ids are never held out; other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import blocks, mix64

UND = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of every code point below U+34000, above which there are none, 0 where it is no letter (one code point each)."""
    t = np.zeros(0x34000, np.uint32)
    for c in range(0x34000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


def letter_vector(code: int, dims: int, seed: int) -> np.ndarray:
    """The letter's random signs, from a counter-based hash: the same on every worker."""
    with np.errstate(over="ignore"):
        x = mix64(mix64(np.arange(dims // 64, dtype=np.uint64) + np.uint64(code << 20)) + np.uint64(seed))
    bits = np.unpackbits(x.view(np.uint8), bitorder="little")[:dims]
    return (bits.astype(np.int8) * 2 - 1)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each preceded by a blank, and the texts' beginnings (n + 1)."""
    joined = " ".join(["", *texts])
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return cps, starts


def trigrams(texts: list[str]):
    """(alphabet, document index, trigram key a*k*k + b*k + c) of every trigram with a letter in the middle or at an end of a word."""
    cps, starts = code_points(texts)
    table = _letters()
    low = table[np.minimum(cps, len(table) - 1)]
    if (cps >= len(table)).any():
        low = np.where(cps < len(table), low, 0)
    seen = np.zeros(len(table), bool)
    seen[low] = True
    seen[0] = True
    alphabet = np.flatnonzero(seen)
    index = np.zeros(len(table), np.int32)
    index[alphabet] = np.arange(len(alphabet), dtype=np.int32)
    s = index[low].astype(np.int64)
    k = len(alphabet)
    a = np.concatenate([s, [0, 0]])
    key = (a[:-2] * k + a[1:-1]) * k + a[2:]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(starts))
    # the middle symbol must be a letter; a trigram may reach over the blank between texts only as that blank
    use = a[1:-1] != 0
    use = use[: len(doc)]
    key = key[: len(doc)]
    return alphabet, doc[use], key[use]


class Space:
    """The vector space: letters' vectors by code point, 0 (word boundary) included."""

    def __init__(self, dims: int = 1024, seed: int = 11):
        self.dims, self.seed, self.known = dims, seed, {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.known:
            if len(self.known) >= 1 << 14:
                self.known.clear()
            self.known[code] = letter_vector(code, self.dims, self.seed)
        return self.known[code]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One float32 row for each text: the sum of its trigrams' bound vectors."""
        out = np.zeros((len(texts), self.dims), np.float32)
        if not texts:
            return out
        alphabet, doc, key = trigrams(texts)
        if not len(key):
            return out
        k = len(alphabet)
        if k**3 <= 1 << 24:
            mark = np.zeros(k**3, np.int32)
            mark[key] = 1
            distinct = np.flatnonzero(mark)
            mark[distinct] = np.arange(len(distinct), dtype=np.int32)
            col = mark[key].astype(np.int64)
        else:
            distinct, col = np.unique(key, return_inverse=True)
        base = np.stack([self.letter(int(c)) for c in alphabet])
        p2, p1 = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)

        def use(a: int, z: int, counts: np.ndarray, keys: np.ndarray) -> None:
            """Add the vectors of trigrams `keys` to texts a..z, as often as each holds them."""
            held = np.flatnonzero(counts.any(axis=0))
            for u in range(0, len(held), most):
                part = held[u : u + most]
                d = keys[part]
                vectors = p2[d // (k * k)] * p1[d // k % k] * base[d % k]
                out[a:z] += counts[:, part].astype(np.float32) @ vectors.astype(np.float32)

        def add(a: int, z: int) -> None:
            """Texts a..z: at once, where the block has few trigrams; else their own in parts, so that no table of counts grows; alone, where they share few."""
            lo, hi = np.searchsorted(doc, (a, z))
            if lo == hi:
                return
            if (z - a) * len(distinct) <= 1 << 21:
                use(a, z, np.bincount((doc[lo:hi] - a) * len(distinct) + col[lo:hi], minlength=(z - a) * len(distinct)).reshape(z - a, -1), distinct)
                return
            by = np.argsort(col[lo:hi], kind="stable")
            row, own = (doc[lo:hi] - a)[by], col[lo:hi][by]
            new = np.append(True, own[1:] != own[:-1])
            first, place = np.flatnonzero(new), np.cumsum(new) - 1  # where each trigram begins
            if z - a > 1 and hi - lo < (z - a) * len(first) // 16:
                for t in range(a, z):
                    add(t, t + 1)
                return
            for u in range(0, len(first), most):
                at, to = first[u], first[u + most] if u + most < len(first) else len(own)
                width = min(most, len(first) - u)
                counts = np.bincount(row[at:to] * width + (place[at:to] - u), minlength=(z - a) * width).reshape(z - a, width)
                use(a, z, counts, distinct[own[first[u : u + width]]])

        step, most = 128, 2048
        for at in range(0, len(texts), step):
            add(at, min(at + step, len(texts)))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros(x.shape), where=norm > 0)


def held_out_flag(doc_id):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(train: DataFrame, dims: int = 1024, seed: int = 11, max_train: int = 40_000) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from rows (doc_id, text, lang) with a language; at most about max_train of them, chosen by a hash of doc_id."""
    rows = train.where("lang is not null and text is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    n = rows.count()
    if n > max_train:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))

    def run(batches):
        space, sums = Space(dims, seed), {}
        for b in blocks(batches, "text", 2 << 20):
            v = unit(space.bundle(b.column(0).to_pylist()))
            langs = np.array(b.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                sums[lang] = sums.get(lang, 0) + v[langs == lang].sum(axis=0)
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = rows.select("text", "lang").mapInArrow(run, "lang string, v array<double>")
    # languages x dims sums; sorted input of rounded sums keeps the result the same whatever the order of the parts
    sums = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum(F.round(F.col("x") * 1048576).cast("long")).alias("x"))
    table = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).orderBy("lang").collect()
    langs = [r.lang for r in table]
    proto = np.array([[e.x for e in r.v] for r in table], float).reshape(len(langs), dims if langs else 0)
    return langs, unit(proto) if langs else proto


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, langs: list[str], proto: np.ndarray, dims: int = 1024, seed: int = 11) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; one map over the scan."""
    weights = proto.T.astype(np.float64)

    def run(batches):
        space = Space(dims, seed)
        for b in blocks(batches, "text", 2 << 20):
            v = space.bundle([t or "" for t in b.column(2).to_pylist()])
            some = v.any(axis=1)
            if langs:
                cos = unit(v) @ weights
                best = cos.argmax(axis=1)
                score = np.where(some, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0)
                names = [langs[k] if s else UND for k, s in zip(best, some)]
            else:
                score, names = np.zeros(len(v)), [UND] * len(v)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score)], schema=_OUT)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_flag(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, dims: int = 1024, seed: int = 11, max_train: int = 40_000) -> DataFrame:
    """Learns from the rows that are not held out and predicts all rows."""
    langs, proto = fit(docs.where(~held_out_flag(F.col("doc_id"))), dims, seed, max_train)
    return predict(docs, langs, proto, dims, seed)
