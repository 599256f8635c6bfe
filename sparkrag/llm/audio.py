"""Audio features of media columns.

A media column holds WAV bytes: 8-bit unsigned mono PCM here. Features of a clip: the samples are brought to the model's
rate by a polyphase windowed-sinc filter (rational up / down), cut into overlapped Hann frames, turned into log-mel
energies and cut into segments of sound by hysteresis (a segment opens at the first frame of the high threshold or more and closes at the next
one below the low threshold). Log-mel values go in tensors of a fixed shape (frames x mels, the last one padded with the floor) with the time span
of each. In Arrow they are a fixed_shape_tensor column (`tensor_column`); Spark has no such type and stores its values, one array of frames * mels
floats a tensor, which `tensor_column` takes back. Segments are spans in milliseconds.

A clip is resampled and transformed in pieces of about `piece` samples with the filter's and the frames' overlap: beside a clip's bytes and its
tensors, memory is bounded by the piece, and a clip's values do not depend on the rows around it.

Defined results: null media have no rows in `features`; null text is empty, which gives one block of 64 zero bytes; equal texts give equal values; rows repeat as they come; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkrag.llm.common import blocks


@dataclass(frozen=True)
class Spec:
    rate_in: int = 16_000
    up: int = 5
    down: int = 8  # 16 kHz to 10 kHz
    half_taps: int = 4  # zero crossings of the filter on either side
    frame: int = 256
    hop: int = 128
    mels: int = 24
    low_db: float = -34.0
    high_db: float = -28.0
    tensor_frames: int = 64
    piece: int = 1 << 18

    @property
    def rate(self) -> int:
        return self.rate_in * self.up // self.down


def wav_bytes(payload: bytes, rate: int) -> bytes:
    """RIFF/WAVE of 8-bit unsigned mono PCM; the samples are the payload's bytes."""
    pad = b"\0" * (len(payload) & 1)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload) + len(pad), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + pad


def read_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of 8-bit mono PCM."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif name == b"data" and rate is not None:
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def _phases(up: int, down: int, half: int) -> tuple[np.ndarray, int]:
    """The up polyphase branches of a Hann-windowed sinc low-pass, as rows of taps over input samples."""
    reach = half * max(up, down)  # in steps of the upsampled rate
    t = np.arange(-reach, reach + 1)
    h = np.sinc(t / max(up, down)) * (0.5 + 0.5 * np.cos(np.pi * t / (reach + 1)))
    h *= up / h.sum()
    side = reach // up + 1
    rows = np.zeros((up, 2 * side + 1))
    for p in range(up):  # output at phase p reads input sample k at offset p - k * up
        for k in range(-side, side + 1):
            d = p - k * up
            if -reach <= d <= reach:
                rows[p, k + side] = h[d + reach]
    return rows.astype(np.float32), side


def resample(x: np.ndarray, up: int, down: int, half: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """Samples first .. first+count of x at rate up/down, by polyphase branches; x (8-bit unsigned is scaled to -1..1) is zero outside."""
    rows, side = _phases(up, down, half)
    count = -(-len(x) * up // down) - first if count is None else count
    m = np.arange(first, first + count, dtype=np.int64) * down
    src, phase = m // up, m % up
    lo, hi = (int(src[0]), int(src[-1])) if count else (0, 0)
    part = np.zeros(hi - lo + 1 + 2 * side, np.float32)
    a, b = max(0, lo - side), min(len(x), hi + side + 1)
    if b > a:
        part[a - (lo - side) : b - (lo - side)] = (x[a:b].astype(np.float32) - 128) / 128 if x.dtype == np.uint8 else x[a:b]
    windows = np.lib.stride_tricks.sliding_window_view(part, 2 * side + 1)
    out = np.empty(count, np.float32)
    for r in range(min(up, count)):  # every up-th output has the same phase and input step `down`
        at = src[r::up] - lo
        out[r::up] = windows[at[0] : at[-1] + 1 : down] @ rows[phase[r]]
    return out


@lru_cache(maxsize=8)
def _mel(frame: int, rate: int, mels: int) -> np.ndarray:
    """Triangular mel filters (bins x mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    a, b, c = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - a) / (b - a), (c - f) / (c - b))).astype(np.float32)


def log_mel(samples: bytes, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels log energies in dB, energy in dB of each frame); at least one frame."""
    x = np.frombuffer(samples, np.uint8)
    total = -(-len(x) * spec.up // spec.down)
    frames = max(1, -(-max(0, total - spec.frame) // spec.hop) + 1)
    window = np.hanning(spec.frame + 1)[:-1].astype(np.float32)
    bank = _mel(spec.frame, spec.rate, spec.mels)
    step = max(1, spec.piece * spec.up // spec.down // spec.hop)
    out, energy = [], []
    for f in range(0, frames, step):
        n = min(step, frames - f)
        need = (n - 1) * spec.hop + spec.frame
        y = np.zeros(need, np.float32)
        have = max(0, min(need, total - f * spec.hop))
        y[:have] = resample(x, spec.up, spec.down, spec.half_taps, f * spec.hop, have)
        w = np.lib.stride_tricks.sliding_window_view(y, spec.frame)[:: spec.hop] * window
        s = np.fft.rfft(w, axis=1)
        power = (s.real**2 + s.imag**2).astype(np.float32) / spec.frame
        out.append(10 * np.log10(power @ bank + 1e-6))
        energy.append(10 * np.log10((w * w).mean(axis=1) + 1e-6))
    return np.concatenate(out), np.concatenate(energy)


def segments(energy: np.ndarray, low: float, high: float) -> list[tuple[int, int]]:
    """Segments (first frame, frame after the last): each opens at the first frame of `high` or more and closes at the next below `low`."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (energy >= low).astype(np.int8), [0]])))
    peaks = np.append(np.flatnonzero(energy >= high), len(energy))
    opened = peaks[np.searchsorted(peaks, edge[::2])]
    return [(int(a), int(b)) for a, b in zip(opened, edge[1::2]) if a < b]


def clip_features(media: bytes, spec: Spec = Spec()) -> dict:
    """The tensors (k x frames x mels), their spans and the sound segments in milliseconds."""
    rate, samples = read_wav(media)
    m, e = log_mel(samples, spec)
    ms = lambda f: round(1000 * f * spec.hop / spec.rate)
    k = -(-len(m) // spec.tensor_frames)
    tensor = np.full((k * spec.tensor_frames, spec.mels), -60, np.float32)
    tensor[: len(m)] = m
    spans = [(ms(i * spec.tensor_frames), ms(min(len(m), (i + 1) * spec.tensor_frames))) for i in range(k)]
    return {"samples": samples, "rate": rate, "tensor": tensor.reshape(k, spec.tensor_frames, spec.mels), "spans": spans, "segments": [(ms(a), ms(b)) for a, b in segments(e, spec.low_db, spec.high_db)], "frames": len(m)}


def feature_string(found: dict) -> str:
    """frames, segments, their total length, mean and spread of each eighth mel and a digest of the values rounded to dB."""
    t = found["tensor"].reshape(-1, found["tensor"].shape[2])[: found["frames"]]
    mean = t.mean(axis=0, dtype=np.float64)[::8]
    h = hashlib.sha256(np.round(t).astype(np.int8).tobytes()).hexdigest()[:16]
    sound = sum(b - a for a, b in found["segments"])
    return f"frames={found['frames']};segments={len(found['segments'])};sound_ms={sound};mel={','.join(f'{v:.0f}' for v in mean)};digest={h}"


def tensor_column(tensors: list[np.ndarray] | pa.Array, spec: Spec = Spec()) -> pa.Array:
    """An Arrow fixed_shape_tensor column of frames x mels, of tensors or of the arrays that Spark stores."""
    shape = (spec.tensor_frames, spec.mels)
    if isinstance(tensors, pa.Array):
        flat = tensors.flatten()
    else:
        flat = pa.array(np.concatenate([t.reshape(-1) for t in tensors]) if tensors else np.zeros(0, np.float32), pa.float32())
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape), pa.FixedSizeListArray.from_arrays(flat, shape[0] * shape[1]))


_SPAN = "struct<start_ms: long, end_ms: long>"
_SPANS = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))


def _spans(pairs: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start_ms": a, "end_ms": e} for a, e in p] for p in pairs], _SPANS)


def _stored(tensors: np.ndarray, spec: Spec) -> pa.Array:
    """The values of a tensor column (k x frames x mels) as Spark stores them."""
    return tensor_column([tensors], spec).storage.cast(pa.list_(pa.float32()))


def features(media: DataFrame, spec: Spec = Spec(), rows: int = 64) -> DataFrame:
    """doc_id, part, start_ms, end_ms, tensor (frames * mels floats), segments (of the whole clip), for a table (doc_id, media): a row a tensor, in
    Arrow batches of `rows`."""

    def run(batches):
        for b in blocks(batches, "media", 4 << 20):
            for key, clip in zip(b.column(0).to_pylist(), b.column(1)):
                if not clip.is_valid:
                    continue
                f = clip_features(clip.as_py(), spec)
                for at in range(0, len(f["spans"]), rows):
                    spans = f["spans"][at : at + rows]
                    k = len(spans)
                    start, end = (pa.array([s[i] for s in spans], pa.int64()) for i in (0, 1))
                    yield pa.record_batch([pa.array([key] * k, pa.int64()), pa.array(range(at, at + k), pa.int32()), start, end, _stored(f["tensor"][at : at + rows], spec), _spans([f["segments"]] * k)], names=["doc_id", "part", "start_ms", "end_ms", "tensor", "segments"])

    return media.selectExpr("cast(doc_id as long) doc_id", "cast(media as binary) media").mapInArrow(run, f"doc_id long, part int, start_ms long, end_ms long, tensor array<float>, segments array<{_SPAN}>")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 if raw else 64)


def text_media(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Each text stored as a clip, read back and described: digests, tensors (arrays of frames * mels floats) with their time spans, and
    segments of sound. One map over the scan."""

    def run(batches):
        for b in blocks(batches, "text", 2 << 20):
            out, tensors, spans, segs = [], [], [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, payload = payload_of(t)
                media = wav_bytes(payload, spec.rate_in)
                found = clip_features(media, spec)
                back = found["samples"]
                out.append((key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_string(found)))
                tensors.append(found["tensor"])
                spans.append(found["spans"])
                segs.append(found["segments"])
            ends = pa.array(np.cumsum([0, *(len(t) for t in tensors)]), pa.int32())
            more = [pa.ListArray.from_arrays(ends, _stored(np.concatenate(tensors), spec)), _spans(spans), _spans(segs)]
            yield pa.record_batch([*(pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)), *more], names=[*_OUT.names, "tensors", "spans", "segments"])

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return slim.mapInArrow(run, f"{kinds}, tensors array<array<float>>, spans array<{_SPAN}>, segments array<{_SPAN}>")
