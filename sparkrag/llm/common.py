"""Shared plumbing: tables in the cluster's shared folder and numpy views of Arrow text."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrag.sources.stored import shared_folder

M64 = (1 << 64) - 1


shared_dir = shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkrag/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_text(col):
    """Unsigned CRC-32 of a string's UTF-8 bytes."""
    return F.crc32(F.encode(col, "UTF-8"))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its n+1 offsets from 0, without copying; null is empty."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def blocks(batches, key: str | int, most: int):
    """Regroup Arrow batches so that the text column (name or index) of each piece holds about `most` bytes at most (a single longer text stays whole)."""
    for batch in batches:
        i = batch.schema.get_field_index(key) if isinstance(key, str) else key
        _, o = text_bytes(batch.column(i))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(o, o[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(28))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_R = 0x2545F4914F6CDD1D
_POW: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int, kept: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse up to n - 1 at least; tables of more than `kept` are made anew each time."""
    if n <= kept and _POW:
        return _POW[0]
    both = []
    for base in (_R, pow(_R, -1, 1 << 64)):
        a = np.full(max(n, kept), base, np.uint64)
        a[0] = 1
        both.append(np.multiply.accumulate(a))
    if n <= kept:
        _POW.append((both[0], both[1]))
    return both[0], both[1]


def byte_codes(seed: int) -> np.ndarray:
    """256 random odd 64-bit codes."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def run_hashes(data: np.ndarray, starts: np.ndarray, inside: np.ndarray, codes: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """64-bit polynomial hashes of the runs that begin at `starts`, over the bytes marked `inside`.

    Works on pieces of whole runs, so that the memory it takes does not grow with the data.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = int(np.searchsorted(starts, a + piece))
        end = starts[j] if j < len(starts) else len(data)
        p, inv = _powers(end - a)
        v = codes[data[a:end]] * p[: end - a]
        v[~inside[a:end]] = 0
        at = starts[i:j] - a
        out[i:j] = mix64(np.add.reduceat(v, at) * inv[at])
        i = j
    return out


def first_of_runs(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where a run of `inside` begins; a document's first byte begins a new run."""
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offsets[:-1]
    edge = edge[edge < len(inside)]
    start[edge] = inside[edge]
    return np.flatnonzero(start)
