"""Packing by minimum bin slack.

Every document's token ids are cut into full windows, which are sequences of their own, and a rest. The rests of a
block are kept as a multiset of lengths. For each window the longest rest is placed and a subset-sum dynamic program
over a bitset (one bit a token) finds the multiset of remaining lengths that fills the window closest to capacity;
counts are recovered by walking the stored bitsets backwards, and a pattern is repeated as often as its counts allow.
Where slack is left, one more rest is cut so that its head fills it. What remains at the end of a partition, less than
one window, is cut into sequences of powers of two.

Each partition packs its own rows in blocks of at most `block_bytes` of text and carries less than one window from
block to block: no shuffle, memory bounded by the block and the words a worker remembers (some 48 MB), and a lost task is simply run again.

Defined results: null text is empty (one token, the end id); a repeated row is packed once for each time it occurs; a null doc_id stays
null; an empty table gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import struct
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import blocks

END_ID = 1
_ENTRY = 210  # bytes of a short text, its ids' bytes and a slot of a growing dict, besides the characters and ids themselves
# Fixed value: the splitting rule of byte-level BPE files of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths from `counts` (length: how many) with the largest sum within capacity."""
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    goal = 1 << capacity
    for size in sorted(counts, reverse=True):
        left = min(counts[size], capacity // size)
        m = 1
        while left > 0 and not reach & goal:
            m = min(m, left)
            grown = (reach | reach << size * m) & mask
            if grown != reach:
                steps.append((size, m, reach))
                reach = grown
            left -= m
            m *= 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for size, m, before in reversed(steps):
        if not before >> at & 1:
            at -= size * m
            used[size] = used.get(size, 0) + m
    return used


class SlackPacker:
    """Places pieces (key, start, ids, total) into sequences of at most `window` tokens."""

    def __init__(self, window: int):
        self.window = window
        self.rest: dict[int, deque] = {}
        self.out: list[tuple] = []
        self.sequences = 0
        self.tokens = 0

    def _emit(self, pieces) -> None:
        at = 0
        for key, start, ids, total in pieces:
            self.out.append((key, start, ids, total, self.sequences, at))
            at += len(ids)
        self.sequences += 1

    def _keep(self, piece) -> None:
        self.rest.setdefault(len(piece[2]), deque()).append(piece)
        self.tokens += len(piece[2])

    def _take(self, size: int):
        q = self.rest[size]
        piece = q.popleft()
        if not q:
            del self.rest[size]
        self.tokens -= size
        return piece

    def add(self, key, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) // self.window * self.window
        for s in range(0, full, self.window):
            self._emit([(key, s, ids[s : s + self.window], total)])
        if full < total:
            self._keep((key, full, ids[full:], total))

    def pack(self) -> None:
        """Fill windows until less than one is left."""
        while self.tokens >= self.window:
            counts = {k: len(q) for k, q in self.rest.items()}
            longest = max(counts)
            counts[longest] -= 1
            if not counts[longest]:
                del counts[longest]
            pattern = best_fill(counts, self.window - longest)
            pattern[longest] = pattern.get(longest, 0) + 1
            slack = self.window - sum(k * n for k, n in pattern.items())
            times = 1 if slack else min(len(self.rest[k]) // n for k, n in pattern.items())
            for _ in range(times):
                pieces = [self._take(k) for k in sorted(pattern, reverse=True) for _ in range(pattern[k])]
                if slack:
                    key, start, ids, total = self._take(min(k for k in self.rest if k > slack))
                    pieces.append((key, start, ids[:slack], total))
                    self._keep((key, start + slack, ids[slack:], total))
                self._emit(pieces)

    def finish(self) -> None:
        """Cut the last part of a window into powers of two, which need no padding."""
        self.pack()
        left = [self._take(k) for k in sorted(self.rest, reverse=True) for _ in range(len(self.rest[k]))]
        left.reverse()
        total = sum(len(p[2]) for p in left)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            pieces = []
            while room:
                key, start, ids, n = left.pop()
                pieces.append((key, start, ids[:room], n))
                if len(ids) > room:
                    left.append((key, start + room, ids[room:], n))
                room -= len(pieces[-1][2])
            self._emit(pieces)


def _byte_of() -> dict[str, int]:
    """Bytes by the characters that stand for them in a byte-level vocabulary: printable ones themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class CachedTokenizer:
    """Ids of whole texts by a `tokenizers` file of byte-level BPE, remembering parts between single spaces.

    The pre-tokeniser always begins a new token at a space that stands between two characters that are not white
    space, so such a text is the concatenation of its parts. A part seen for the first time is merged by the same
    file's vocabulary and splitting rule in tiktoken, which is quicker for single words; texts with other
    spaces or an added token (such as <|endoftext|>) go through `tokenizers` whole. The ids are the same either way (tests hold them against `tokenizers`).

    Parts of at most `longest` characters are remembered, until they take some `most` bytes; longer ones, as texts without spaces have them, are
    forgotten after the call.
    """

    def __init__(self, path: str, most: int = 48 << 20, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = {t["content"] for t in model.get("added_tokens", ())}
        self.added = sorted(added)
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in added}
        self.quick = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.most, self.longest, self.held = most, longest, 0
        self.known: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids."""
        cut = [t.split(" ") for t in texts]
        if self.held > self.most:
            self.known.clear()
            self.held = 0
        known, quick, missing, long = self.known, self.quick.encode_ordinary, set(), []
        for parts in cut:
            missing.update(parts[1:])
        for p in missing.difference(known):
            if p and not p[0].isspace() and not p[-1].isspace():
                ids = quick(" " + p)
                known[p] = raw = struct.pack(f"<{len(ids)}I", *ids)
                if len(p) <= self.longest:
                    self.held += _ENTRY + 4 * len(p) + len(raw)
                else:
                    long.append(p)
        out, whole = [], []
        for i, parts in enumerate(cut):
            head = parts[0]
            try:
                if not head or head[-1].isspace() or any(a in texts[i] for a in self.added):
                    raise KeyError
                out.append(np.array(quick(head), np.uint32).tobytes() + b"".join([known[p] for p in parts[1:]]))
            except KeyError:
                out.append(b"")
                whole.append(i)
        for p in long:
            del known[p]
        for i, ids in zip(whole, self._raw([texts[i] for i in whole])):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    """One a worker process, so that later tasks find the parts that earlier ones met."""
    return CachedTokenizer(path)


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, block_bytes: int = 8 << 20) -> DataFrame:
    """Pieces of the documents' ids with their sequence and offset; ids are little-endian unsigned 32-bit words."""
    end = np.uint32(END_ID).tobytes()

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        tok = tokenizer(tokenizer_path)
        packer = SlackPacker(window)

        def flush():
            for at in range(0, len(packer.out), 1024):
                part = packer.out[at : at + 1024]
                key, start, ids, total, seq, off = zip(*part)
                yield pa.record_batch(
                    [pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array([base + s for s in seq], pa.int64()), pa.array(off, pa.int64())], schema=_OUT
                )
            packer.out = []

        held = 0
        for b in blocks(batches, "text", 1 << 20):
            texts = [t or "" for t in b.column(1).to_pylist()]
            for key, ids in zip(b.column(0).to_pylist(), tok.encode(texts)):
                packer.add(key, np.frombuffer(ids + end, np.uint32))
            held += sum(map(len, texts))
            if held >= block_bytes:
                packer.pack()
                held = 0
            yield from flush()
        packer.finish()
        yield from flush()

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return slim.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
