"""Fill-in-the-middle: every text is cut into prefix, middle and suffix at line ends and written in another order.

The cuts are found by overlapping chunks. The bytes of a block of texts are divided into chunks of at most `chunk` bytes, each of which also sees the
byte before it; a unit (line) begins where the byte before is a newline, a predicate of two adjacent characters. Every chunk counts its unit beginnings and
its code points; prefix sums over the chunks of a text give the number of units and tell which chunk owns a cut of a given rank; only
the owning chunks are scanned again for the place itself. No chunk needs another one's characters but that one byte.

One map over the scan without a shuffle: a block holds about `block_bytes` of text (a longer text stays whole), the flags of at most
`piece` bytes exist at once, and a lost task is run again.

Defined results: null text is empty; an empty text is plain with 0 units; a text that contains a mark is plain; a null doc_id hashes as no digits
and stays null; repeated rows give repeated results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import blocks, text_bytes

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_NEWLINE = 10


class Chunks:
    """Unit beginnings inside texts and code points, counted by chunks; `data` are the texts' bytes, `offsets` their n + 1 limits."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 13, piece: int = 1 << 22):
        self.data, self.offsets = data, offsets
        sizes = np.diff(offsets)
        per = -(-sizes // chunk)
        self.first = np.zeros(len(sizes) + 1, np.int64)  # the first chunk of every text
        np.cumsum(per, out=self.first[1:])
        own = np.repeat(np.arange(len(sizes)), per)
        self.start = offsets[own] + (np.arange(len(own)) - self.first[own]) * chunk
        self.head = self.start == offsets[own]  # the first chunk of a text: its first byte has none before it
        units, points = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(self.start, self.start[at] + piece)))
            a, z = self.start[at], self.start[to] if to < len(own) else len(data)
            inner = self.start[at:to] - a
            units[at:to] = np.add.reduceat(self._begins(a, z, inner[self.head[at:to]]), inner, dtype=np.int64)
            points[at:to] = np.add.reduceat((data[a:z] & 0xC0) != 0x80, inner, dtype=np.int64)
            at = to
        self.units, self.points = np.concatenate([[0], np.cumsum(units)]), np.concatenate([[0], np.cumsum(points)])

    def _begins(self, a: int, z: int, heads: np.ndarray) -> np.ndarray:
        """Whether a unit begins at each byte of a..z, by the pair of it and the byte before; a text's own beginning does not count."""
        flags = np.zeros(z - a, bool)
        flags[1:] = self.data[a : z - 1] == _NEWLINE
        flags[0] = a > 0 and self.data[a - 1] == _NEWLINE
        flags[heads] = False
        return flags

    def n_units(self) -> np.ndarray:
        inner = self.units[self.first[1:]] - self.units[self.first[:-1]]
        return inner + (np.diff(self.offsets) > 0)

    def place(self, text: int, rank: int, n: int) -> tuple[int, int]:
        """(byte, code points before it in the text) of the cut after `rank` of the text's n units."""
        a, z = self.first[text], self.first[text + 1]
        if rank == 0:
            return int(self.offsets[text]), 0
        if rank == n:
            return int(self.offsets[text + 1]), int(self.points[z] - self.points[a])
        want = self.units[a] + rank
        c = a + int(np.searchsorted(self.units[a + 1 : z + 1], want))  # the chunk that owns the cut
        s, e = int(self.start[c]), int(self.start[c + 1]) if c + 1 < z else int(self.offsets[text + 1])
        heads = np.zeros(1 if self.head[c] else 0, np.int64)
        at = s + int(np.flatnonzero(self._begins(s, e, heads))[want - self.units[c] - 1])
        return at, int(self.points[c] - self.points[a]) + int(((self.data[s:at] & 0xC0) != 0x80).sum())


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four groups of eight hexadecimal digits of the seeded hash, as numbers."""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(x[i : i + 8], 16) for i in range(0, 32, 8)]


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def infill(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, chunk: int = 1 << 13, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output of every document.

    `rate` percent of the texts are rearranged, `spm` percent of these with the suffix first.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches):
        for b in blocks(batches, "text", block_bytes):
            data, offsets = text_bytes(b.column(1))
            raw = data.tobytes()
            chunks = Chunks(data, offsets, chunk)
            counts, cols = chunks.n_units().tolist(), [[] for _ in _OUT]
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                a, z, n = int(offsets[i]), int(offsets[i + 1]), counts[i]
                h = draws(doc_id, seed)
                if a == z or h[2] % 100 >= rate or any(raw.find(x, a, z) >= 0 for x in marks):
                    row = (doc_id, n, "plain", None, None, raw[a:z])
                else:
                    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    (x, before), (y, upto) = chunks.place(i, low, n), chunks.place(i, high, n)
                    form = "spm" if h[3] % 100 < spm else "psm"
                    parts = (s, raw[y:z], p, raw[a:x], m, raw[x:y]) if form == "spm" else (p, raw[a:x], s, raw[y:z], m, raw[x:y])
                    row = (doc_id, n, form, before, upto - before, b"".join(parts))
                for col, v in zip(cols, row):
                    col.append(v)
            yield pa.record_batch([*(pa.array(v, f.type) for v, f in zip(cols[:5], _OUT)), pa.array(cols[5], pa.binary()).view(pa.string())], schema=_OUT)

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return slim.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form. Texts that hold a mark are plain, so each mark occurs once."""
    psm = F.regexp_replace(output, f"(?s)^{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(rows: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


# Texts of whole tables stay small enough in DuckDB for lists of their lines.
SQL = r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
  ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT *, len(l)::BIGINT AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256 FROM p"""
