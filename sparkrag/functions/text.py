"""Column functions over text and vectors. All stay in the JVM but for those marked Arrow."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = r"[\t\n\f\r ]"


def trim_ws(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def collapse_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, r"\s+", " "))


def newlines(c: Column) -> Column:
    """Byte-order mark off, CRLF and CR to LF."""
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), "\r\n?", "\n")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 3).cast("long")


def sentences(c: Column) -> Column:
    """Sentences by end marks and line breaks, trimmed, without empty ones."""
    cut = F.split(F.regexp_replace(c, rf"([。！？.!?]{BLANKS}*|\n+)", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, trim_ws), lambda s: s != "")


def _accents() -> tuple[str, str]:
    """Latin letters with marks and their bare letters."""
    pairs = []
    for c in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(x) for x in parts[1:]):
            pairs.append((chr(c), parts[0].lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accents()


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(c), ACCENTED, BARE)


def tokens(c: Column) -> Column:
    """Full-text tokens: folded runs of letters and digits."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda s: s != "")


def md5_hex(c: Column) -> Column:
    return F.md5(F.encode(c, "UTF-8"))


def sha256_hex(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def chunk_key(source: Column, document: Column, key: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws("\u0000", source, document, key), "UTF-8"), 256)


def ordinal_key(n: Column) -> Column:
    return F.format_string("%08d", n)


def redact_url(c: Column) -> Column:
    """Without user info, query and fragment."""
    return F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths or a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def valid_note(c: Column, most: int) -> Column:
    return (F.length(c) <= most) & ~F.regexp_replace(c, "[\n\t]", "").rlike(r"\p{Cc}")


def strip_fence(c: Column) -> Column:
    return trim_ws(F.regexp_replace(trim_ws(c), r"^```[a-zA-Z]*\n?|```$", ""))


# What names a secret before "=" in a word of a query, and what stands for the word then.
_NAMED = ("key=", "token=", "secret=", "password=")
_MASK = "[REDACTED]"


def _without_query(word: str) -> str:
    """The word as a URL without its query and fragment; a word that is no URL stays."""
    try:
        u = urlsplit(word)
    except ValueError:
        return word
    return urlunsplit((u.scheme, u.netloc, u.path, "", "")) if u.query or u.fragment else word


def redact_excerpt(text: str, most: int) -> str:
    """A query's excerpt: words that name a secret masked, URLs without query and fragment, trimmed and cut to `most` code points. Blanks stay."""
    s = unicodedata.normalize("NFC", text)
    s = re.sub(r"\S+", lambda m: _MASK if any(k in m[0].lower() for k in _NAMED) else _without_query(m[0]), s)
    return s.strip()[:most] if most > 0 else ""


def query_excerpt(c: Column, most: int = 256) -> Column:
    """Arrow."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: redact_excerpt(t or "", most))

    return run(c)


def fingerprint(c: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of the NFC query with folded blanks. Arrow (the JVM functions have no HMAC)."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hmac.new(key, " ".join(unicodedata.normalize("NFC", t or "").split()).encode(), hashlib.sha256).hexdigest())

    return run(c)
