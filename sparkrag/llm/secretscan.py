"""Secret scan: three fixed patterns, and a battery of randomness tests that adds spans of unknown kinds.

The battery looks at every maximal run of 20 token characters or more in what no base span covers. '=' ends a run, except as padding at its end; a run
that mixes + or / with - or _ is cut at either pair, and of overlapping pieces the more random one counts. Letters alone are a run like
any other, and the tests decide: by chance a base62 key may hold no digit. For the encoding inferred from its alphabet
(hex, base32, base36, base62, base64) it computes chi-squared uniformity over the alphabet, in cells that running text fills unevenly (digits and
marks, frequent and rare letters of either case), a runs test (symbols above and below the middle of the alphabet) and the lag-1 serial
correlation. Each is a p-value under "uniformly random"; a run whose score, three times the least of them, is under `alpha` is not random.

False-discovery control is over every run tested in a document. Its null is "a word-like run of the same length and encoding": the log of the score
of such runs is taken as normal above its median, with the median and ninth decile of 700 runs drawn from a letter model (seeded, once a length),
so a longer run that looks random is stronger evidence. Benjamini-Hochberg at q decides. A run under `alpha` counts with p-value 1.

Null or empty text: no spans, counts 0, sha256 of the empty string. Repeated rows give repeated results; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkrag.llm.common import blocks

# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")

# The same matches found faster: a maximal hex or access run that is too short can hold no longer one.
_HEX = re.compile(r"[0-9a-f]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
# '=' ends a run; one or two at its end that no token character follows are padding.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
# What base64 and base64url leave of a run that mixes the two.
_PIECES = (re.compile(r"[A-Za-z0-9+/]{20,}(?:={1,2}$)?"), re.compile(r"[A-Za-z0-9_-]{20,}(?:={1,2}$)?"))

ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
_SETS = [(k, frozenset(v)) for k, v in ENCODINGS.items()]


def _codes(alphabet: str) -> np.ndarray:
    """Place in the alphabet of each character of ASCII."""
    t = np.zeros(128, np.int64)
    for i, c in enumerate(alphabet):
        t[ord(c)] = i
    return t


_CODES = {k: _codes(v) for k, v in ENCODINGS.items()}


def infer(token: str) -> str | None:
    """The smallest encoding whose alphabet holds the token (without = padding), or None."""
    have = set(token)
    for k, s in _SETS:
        if have <= s:
            return k
    return None


def _chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


# Letters of running text, most frequent first; weights as one by rank.
_LETTERS = "etaoinshrdlucmfwypvbgkqjxz"
_WEIGHTS = 1 / np.arange(1.0, 27.0)
_FREQUENT = frozenset(_LETTERS[:10])


def _cell(c: str) -> int:
    """Digits and marks 0, frequent and rare upper-case letters 1 and 2, lower-case ones 3 and 4."""
    return 0 if not c.isalpha() else 1 + 2 * c.islower() + (c.lower() not in _FREQUENT)


_CELLS = {k: np.array([_cell(c) for c in v]) for k, v in ENCODINGS.items()}
_SHARES = {k: [(i, n / len(v)) for i, n in enumerate(np.bincount(v, minlength=5).tolist()) if n] for k, v in _CELLS.items()}


def battery(codes: np.ndarray, encoding: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for symbol codes of an encoding."""
    n, size = len(codes), len(ENCODINGS[encoding])
    c = np.bincount(_CELLS[encoding][codes], minlength=5).tolist()
    shares = _SHARES[encoding]
    chi = 0.0
    for i, f in shares:
        chi += (c[i] - n * f) ** 2 / (n * f)
    p_chi = _chi2_sf(chi, len(shares) - 1)
    high = codes * 2 >= size
    a = int(np.count_nonzero(high))
    b = n - a
    if a == 0 or b == 0:
        p_runs = 0.0
    else:
        runs = 1 + int(np.count_nonzero(high[1:] != high[:-1]))
        mean = 1 + 2 * a * b / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var))
    x = codes - int(np.add.reduce(codes)) / n
    v = float(x @ x)
    r = float(x[1:] @ x[:-1]) / v if v else 1.0
    p_ser = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    return p_chi, p_runs, p_ser


def randomness(token: str) -> tuple[str, float] | None:
    """(encoding, least p-value of the battery with a Bonferroni factor), None where no encoding fits."""
    body = token.rstrip("=")
    kind = infer(body) if len(body) >= 16 else None
    if kind is None:
        return None
    codes = _CODES[kind][np.frombuffer(body.encode("ascii"), np.uint8)]
    return kind, min(1.0, 3 * min(battery(codes, kind)))


def word_like(rng: np.random.Generator, length: int, style: int) -> str:
    """Letters of the letter model cut into words of 3 to 8: plain, CamelCase, with separators, with a number at the end, CamelCase with one, upper case, and that with one."""
    s = "".join(_LETTERS[k] for k in rng.choice(26, length, p=_WEIGHTS / _WEIGHTS.sum()))
    marks = set(np.cumsum(rng.integers(3, 9, length)).tolist())
    if style in (1, 4):
        s = "".join(c.upper() if k == 0 or k in marks else c for k, c in enumerate(s))
    if style == 2:
        mark = "-_/"[int(rng.integers(3))]
        s = "".join(mark if k in marks else c for k, c in enumerate(s))
    if style in (3, 4, 6):
        n = int(rng.integers(1, 5))
        s = s[:-n] + "".join(rng.choice(list("0123456789"), n))
    return s.upper() if style > 4 else s


STYLES = 7
_FLOOR = 1e-12  # scores below it are alike


@lru_cache(maxsize=1024)
def word_scores(length: int) -> dict[str | None, tuple[float, float]]:
    """Median and upper deviation (0.5 at least) of the log score of word-like runs of a length, by encoding; None: of all."""
    rng = np.random.default_rng(length)
    by: dict[str | None, list[float]] = {None: []}
    for i in range(100 * STYLES):
        found = randomness(word_like(rng, length, i % STYLES))
        if found:
            v = math.log(max(found[1], _FLOOR))
            by[None].append(v)
            by.setdefault(found[0], []).append(v)
    return {k: (float(np.median(v)), max(0.5, float(np.quantile(v, 0.9) - np.median(v)) / 1.2816)) for k, v in by.items() if len(v) >= 30}


def discovery_p(score: float, length: int, encoding: str | None = None) -> float:
    """How often a word-like run of the length and encoding looks as random as the score, by the normal tail of its log."""
    table = word_scores(length if length < 64 else min(512, length // 32 * 32))
    middle, deviation = table.get(encoding, table[None])
    return 0.5 * math.erfc((math.log(max(score, _FLOOR)) - middle) / deviation / math.sqrt(2))


def candidates(text: str, taken: list[tuple[int, int]]):
    """The token runs (start, end) that no base span covers, or what is left of them beside base spans."""
    at = 0
    for x, y in [*sorted(taken), (len(text), len(text))]:
        if x - at >= 20:
            yield from (m.span() for m in _CANDIDATE.finditer(text, at, x))
        at = max(at, y)


def better(a: list[tuple[float, int, int]], b: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Of two lists of (p, start, end), each in order of place and without overlaps, what the least p, then the earlier place, leave standing.

    All overlaps of the one list with the other are as many as both have entries at most, so the time is linear but for a sort.
    """
    near: list[list[int]] = [[] for _ in range(len(a) + len(b))]  # entries of b are numbered after those of a
    j = 0
    for i, (_, x, y) in enumerate(a):
        while j < len(b) and b[j][2] <= x:
            j += 1
        k = j
        while k < len(b) and b[k][1] < y:
            near[i].append(len(a) + k)
            near[len(a) + k].append(i)
            k += 1
    both, kept = [*a, *b], [False] * len(near)
    for i in sorted(range(len(both)), key=both.__getitem__):
        kept[i] = not any(kept[n] for n in near[i])
    return [c for c, k in zip(both, kept) if k]


def random_spans(text: str, taken: list[tuple[int, int]], alpha: float, q: float) -> list[tuple[int, int]]:
    found = []
    for s, e in candidates(text, taken):
        token = text[s:e]
        by = [[(0, e - s)]] if infer(token.rstrip("=")) else [[m.span() for m in rx.finditer(token)] for rx in _PIECES]
        scored = []
        for parts in by:
            own = []
            for x, y in parts:
                r = randomness(token[x:y])
                if r is not None:
                    own.append((discovery_p(r[1], len(token[x:y].rstrip("=")), r[0]) if r[1] >= alpha else 1.0, s + x, s + y))
            scored.append(own)
        found += scored[0] if len(scored) == 1 else better(*scored)
    found.sort()
    keep, m = 0, len(found)
    for i, (p, _, _) in enumerate(found, 1):
        if p <= q * i / m:
            keep = i
    return [(s, e) for _, s, e in found[:keep]]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base spans in code points, by start, then kind as listed."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m.group(2)) >= LEAST["assign"]:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return [(s, e, KINDS[k]) for s, k, e in out]


def scan(text: str | None, alpha: float = 0.01, q: float = 0.05) -> tuple[list, list]:
    """(base spans, all spans) of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    more = random_spans(text, [(s, e) for s, e, _ in base], alpha, q)
    order = {k: i for i, k in enumerate(KINDS)}
    spans = sorted([*base, *((s, e, "random") for s, e in more)], key=lambda x: (x[0], order[x[2]]))
    return base, spans


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])


def find_secrets(docs: DataFrame, alpha: float = 0.01, q: float = 0.05) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans as kind:start:end. One map over the scan, no shuffle."""

    def run(batches):
        for b in blocks(batches, "text", 8 << 20):
            out = [[] for _ in _OUT]
            for t in b.column(1).to_pylist():
                base, spans = scan(t, alpha, q)
                n = dict.fromkeys(KINDS, 0)
                for _, _, k in spans:
                    n[k] += 1
                for col, v in zip(out[1:], (n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n["random"])):
                    col.append(v)
            yield pa.record_batch([b.column(0), *(pa.array(v, f.type) for v, f in zip(out[1:], list(_OUT)[1:]))], schema=_OUT)

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return slim.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(docs: DataFrame, mask: str = "[secret]", alpha: float = 0.01, q: float = 0.05) -> DataFrame:
    """The documents with each secret span replaced by `mask` (overlapping spans merge) and n_chars brought up to date. All rows and columns stay."""
    names = docs.columns
    i_text = names.index("text")
    i_n = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in blocks(batches, i_text, 8 << 20):
            texts = b.column(i_text).to_pylist()
            new = []
            for t in texts:
                _, spans = scan(t, alpha, q)
                if not spans:
                    new.append(t)
                    continue
                parts, at = [], 0
                for s, e, _ in spans:
                    if s >= at:
                        parts += [t[at:s], mask]
                    at = max(at, e)
                new.append("".join([*parts, t[at:]]))
            cols = list(b.columns)
            cols[i_text] = pa.array(new, b.schema.field(i_text).type)
            if i_n is not None:
                old = cols[i_n].to_pylist()
                cols[i_n] = pa.array([o if x is y or x is None else len(y) for o, x, y in zip(old, texts, new)], b.schema.field(i_n).type)
            yield pa.record_batch(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
