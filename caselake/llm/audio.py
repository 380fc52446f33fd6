"""Media columns: audio stored as 8-bit PCM, and its features as fixed-shape tensors.

Features: polyphase resampling to a common rate, log-mel filterbanks over
overlapping frames, and segments found by an energy threshold with hysteresis
(a segment opens above the higher limit and closes below the lower one). Log-mel
frames, rounded to hundredths, are cut into windows of a fixed shape (``WINDOW`` x ``MELS``, the last
one padded with zeros). A row's windows and their time spans are stored as one Arrow
stream whose ``window`` column is a fixed-shape tensor array (``windows_of`` reads it).

Storing, reading back and features take one Arrow pass. Samples are resampled and framed in
blocks of ``BLOCK_FRAMES`` frames by a document's own samples only, so equal audio has equal features
wherever it lies, and beside its bytes a very long one needs memory for a block and for the features.

Cases: null media gives null features; media without samples gives no window and no
segment; silence gives windows at the floor and no segment; broken media
raises ValueError; repeated rows give equal results; further columns are kept,
but for ones with the names of the results, which give way.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import spread, table

RATE_IN, RATE_OUT = 8000, 6000
FRAME, HOP, MELS, WINDOW = 256, 96, 24, 32
OPEN_DB, CLOSE_DB = -12.0, -18.0
BLOCK_FRAMES = 4096


# -- the stored form -------------------------------------------------------------------------


def to_wav(samples: bytes, rate: int = RATE_IN) -> bytes:
    """8-bit mono PCM with a RIFF header; an odd number of samples gets the pad byte that the format asks for."""
    pad = len(samples) & 1
    return b"RIFF" + struct.pack("<I", (36 + len(samples) + pad) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * pad


def from_wav(data: bytes) -> tuple[int, bytes]:
    """Rate and samples of 8-bit mono PCM, by walking the chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, rate = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            if rate is None or at + 8 + size > len(data):
                raise ValueError("a broken wave file")
            return rate, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


# -- features --------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def low_pass(up: int, down: int, half: int = 10) -> np.ndarray:
    """Windowed sinc of 2 * half * max(up, down) + 1 taps, dealt out into ``up`` phases (phases x taps)."""
    wide = max(up, down)
    n = np.arange(-half * wide, half * wide + 1)
    taps = np.sinc(n / wide) * np.kaiser(len(n), 6.0) / wide * up
    per = -(-len(taps) // up)
    padded = np.zeros(per * up)
    padded[: len(taps)] = taps
    return padded.reshape(per, up).T.copy()


def resampled_length(n: int, rate: int, to: int) -> int:
    return -(-n * (to // gcd(rate, to)) // (rate // gcd(rate, to)))


def resample(samples: np.ndarray, rate: int, to: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Output samples start to stop of a polyphase rate conversion: each takes one phase of the filter, and no sample between is computed. 8-bit samples are scaled to [-1, 1)."""
    stop = resampled_length(len(samples), rate, to) if stop is None else stop
    scaled = (lambda x: (x.astype(np.float64) - 128) / 128) if samples.dtype == np.uint8 else (lambda x: x.astype(np.float64))
    if rate == to or stop <= start:
        return scaled(samples[start:stop])
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    phases = low_pass(up, down)
    per, delay = phases.shape[1], 10 * max(up, down)
    # output m reads input (m * down + delay) // up and the per - 1 before it, with the phase of the remainder
    low, high = (start * down + delay) // up - per + 1, ((stop - 1) * down + delay) // up + 1
    held = np.zeros(high - low)
    inside = samples[max(low, 0) : max(0, min(high, len(samples)))]
    held[max(low, 0) - low : max(low, 0) - low + len(inside)] = scaled(inside)
    out = np.empty(stop - start)
    for k in range(min(up, stop - start)):
        at = (start + k) * down + delay
        last, taps, count = at // up - low, phases[at % up], -(-(stop - start - k) // up)
        out[k::up] = sum(held[last - j : last - j + down * (count - 1) + 1 : down] * taps[j] for j in range(per))
    return out


@lru_cache(maxsize=4)
def mel_bank(rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale (bins x MELS)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


def log_mels(samples: np.ndarray, rate: int, to: int = RATE_OUT) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS) log energies in hundredths, and each frame's level in dB, of the resampled samples, block by block."""
    total = resampled_length(len(samples), rate, to)
    n = 1 + max(0, -(-(total - FRAME) // HOP)) if total else 0
    window, bank = np.hanning(FRAME + 1)[:-1], mel_bank(to)
    mels, level = np.empty((n, MELS), np.float32), np.empty(n)
    for at in range(0, n, BLOCK_FRAMES):
        count = min(BLOCK_FRAMES, n - at)
        x = np.zeros((count - 1) * HOP + FRAME)
        got = resample(samples, rate, to, at * HOP, min(total, at * HOP + len(x)))
        x[: len(got)] = got
        part = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(part * window, axis=1)) ** 2
        mels[at : at + count] = np.round(np.log(power @ bank + 1e-8), 2)
        level[at : at + count] = 10 * np.log10(np.mean(part * part, axis=1) + 1e-10)
    return mels, level


def segments(level: np.ndarray, rate: int, high: float = OPEN_DB, low: float = CLOSE_DB) -> list[tuple[float, float]]:
    """Time spans that open at a frame above ``high`` and last while frames stay at or above ``low``."""
    event = np.where(level > high, 1, np.where(level < low, 2, 0))
    told = np.flatnonzero(event)
    if not told.size:
        return []
    last = np.maximum.accumulate(np.where(event > 0, np.arange(len(level)), -1))
    on = (last >= 0) & (event[np.maximum(last, 0)] == 1)
    edge = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(float(s * HOP / rate), float(((e - 1) * HOP + FRAME) / rate)) for s, e in zip(starts, ends, strict=True)]


def features(samples: bytes, rate: int) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Windows (n x WINDOW x MELS), their time spans, and the segments of one audio's samples."""
    raw = np.frombuffer(samples, np.uint8)
    mels, level = log_mels(raw, rate)
    n = -(-len(mels) // WINDOW)
    tensor = np.zeros((n, WINDOW, MELS), np.float32)
    tensor.reshape(-1, MELS)[: len(mels)] = mels
    step, whole = WINDOW * HOP / RATE_OUT, resampled_length(len(raw), rate, RATE_OUT) / RATE_OUT
    spans = [(k * step, min((k + 1) * step, whole)) for k in range(n)]
    return tensor, spans, segments(level, RATE_OUT)


TENSOR = pa.fixed_shape_tensor(pa.float32(), (WINDOW, MELS))
STORED = pa.schema([("start", pa.float64()), ("stop", pa.float64()), ("window", TENSOR)])


def pack_windows(tensor: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """Windows and time spans as an Arrow stream with a fixed-shape tensor column."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensor.reshape(-1)), WINDOW * MELS)
    columns = [pa.array([x[0] for x in spans], pa.float64()), pa.array([x[1] for x in spans], pa.float64()), pa.ExtensionArray.from_storage(TENSOR, flat)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STORED) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=STORED))
    return sink.getvalue().to_pybytes()


def windows_of(stored: bytes) -> pa.Table:
    """start, stop and window (fixed-shape tensor) of a stored ``tensors`` value."""
    return pa.ipc.open_stream(stored).read_all()


VOICED = "array<struct<start: double, stop: double>>"


def audio_columns(df: DataFrame, payload: str | None = None, media: str = "media") -> DataFrame:
    """df with ``samples`` (read back from the stored audio), ``tensors``, ``n_windows`` and ``voiced`` segments of its audio in ``media``.

    With ``payload``, a binary column, the audio is made from its bytes first, and ``media`` is added.
    """
    made = [media] if payload else []
    df = df.drop(*made, "samples", "tensors", "n_windows", "voiced")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    names = [*df.columns, *made, "samples", "tensors", "n_windows", "voiced"]
    span = pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())]))

    def described(value: bytes | None) -> tuple:
        stored = to_wav(value) if payload and value is not None else value
        if stored is None:
            return (None,) * 5
        rate, samples = from_wav(stored)
        tensor, spans, voiced = features(samples, rate)
        return stored, samples, pack_windows(tensor, spans), len(spans), [{"start": a, "stop": b} for a, b in voiced]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                got = list(zip(*(described(x.as_py()) for x in part.column(payload or media)), strict=True))
                columns = [pa.array(x, t) for x, t in zip(got, (pa.binary(), pa.binary(), pa.binary(), pa.int32(), span), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns[0 if payload else 1 :]], names=names)

    return spread(df).mapInArrow(run, ", ".join([fields, *[f"`{m}` binary" for m in made], f"samples binary, tensors binary, n_windows int, voiced {VOICED}"]))


def padded(text: str = "text") -> str:
    """SQL: the text's bytes with zero bytes up to a positive multiple of 64."""
    n = f"octet_length(coalesce(`{text}`, ''))"
    return f"unhex(concat(hex(CAST(coalesce(`{text}`, '') AS binary)), repeat('00', CASE WHEN {n} = 0 THEN 64 ELSE pmod(-{n}, 64) END)))"


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text")
    raw = docs.selectExpr("doc_id", "CAST(octet_length(coalesce(text, '')) AS long) AS n_bytes", f"{padded()} AS payload")
    return audio_columns(raw, "payload").selectExpr(
        "doc_id", "n_bytes", "CAST(octet_length(samples) AS long) AS payload_bytes", "sha2(samples, 256) AS payload_sha256", "crc32(substring(samples, -64, 64)) AS tail_crc32",
        "CAST(octet_length(media) AS long) AS media_bytes", "sha2(media, 256) AS media_sha256",
        "concat_ws('-', n_windows, size(voiced), sha2(tensors, 256), hex(xxhash64(voiced))) AS feature",
    )
