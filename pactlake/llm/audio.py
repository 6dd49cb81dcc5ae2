"""Media columns: audio features of byte payloads held as 8-bit WAV.

The stored form is mono 8-bit PCM at `RATE` Hz. Features come from the samples read back: polyphase resampling by
UP/DOWN, overlapped log-mel frames, and speech-like segments by energy with hysteresis. The log-mel frames are cut
into fixed-shape Arrow tensors [BLOCK, MELS] with the time span of each.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import byte_slices

RATE, UP, DOWN, TAPS = 8000, 3, 5, 8
FRAME, HOP, MELS, BLOCK = 256, 96, 20, 64
#: Decibels over the quietest tenth at which a segment begins, and under which it ends.
ON_DB, OFF_DB = 6.0, 3.0
#: Frames whose spectra are held at once.
STEP = 2048


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples, one for each byte."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def read_wav(data: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(data)) as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not mono 8-bit")
        return w.readframes(w.getnframes()), w.getframerate()


def _filter() -> np.ndarray:
    """Windowed-sinc low-pass split into UP phases of TAPS taps."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return (h * UP / h.sum()).reshape(TAPS, UP).T[:, ::-1].copy()


def _mel() -> np.ndarray:
    """Triangles evenly spaced on the mel scale, from 0 to half the resampled rate."""
    top = RATE * UP / DOWN / 2
    edge = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2) / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    return np.clip(np.minimum((f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])), 0, None)


_PHASES, _BANK, _HANN = _filter(), _mel(), np.hanning(FRAME)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase: output m is the phase (m * DOWN) % UP of the filter on the TAPS samples up to m * DOWN // UP.

    Zeros follow the signal until its last sample has left the filter. `x`: numbers from -1 to 1, or unsigned 8-bit samples.
    """
    count = -(-(len(x) + TAPS - 1) * UP // DOWN)
    silence = np.full(TAPS - 1, 128 if x.dtype == np.uint8 else 0, x.dtype)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([silence, x, silence]), TAPS)
    y = np.empty(count, np.float32)
    for p in range(UP):
        at = np.arange(p, count, UP) * DOWN // UP
        for a in range(0, len(at), 1 << 14):
            some = view[at[a : a + (1 << 14)]]
            y[p + a * UP : p + min(a + (1 << 14), len(at)) * UP : UP] = ((some - 128.0) / 128.0 if x.dtype == np.uint8 else some) @ _PHASES[(p * DOWN) % UP]
    return y


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, frame energy in dB); zeros fill the last frame, so every sample lies in one."""
    whole = FRAME + max(0, -(-(len(y) - FRAME) // HOP)) * HOP
    y = np.concatenate([y, np.zeros(whole - len(y), y.dtype)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mel, db = np.empty((len(frames), MELS), np.float32), np.empty(len(frames))
    for a in range(0, len(frames), STEP):
        power = np.abs(np.fft.rfft(frames[a : a + STEP] * _HANN)) ** 2
        mel[a : a + STEP] = np.log(power @ _BANK + 1e-6)
        db[a : a + STEP] = 10 * np.log10(power.sum(1) + 1e-9)
    return mel, db


def segments(db: np.ndarray) -> np.ndarray:
    """Frame ranges [start, end): on from floor + ON_DB, off under floor + OFF_DB, unchanged between."""
    floor = np.quantile(db, 0.1)
    event = np.where(db >= floor + ON_DB, 1, np.where(db < floor + OFF_DB, 0, -1))
    at = np.maximum.accumulate(np.where(event >= 0, np.arange(len(db)), -1))
    on = np.where(at >= 0, event[at], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return edge.reshape(-1, 2)


def tensor_batch(mel: np.ndarray, db: np.ndarray):
    """A record batch: tensor fixed_shape_tensor(float32, [BLOCK, MELS]), start_ms, end_ms; the last block is padded with 0."""
    import pyarrow as pa

    n = len(mel)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks * BLOCK, MELS), np.float32)
    padded[:n] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), (BLOCK, MELS))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), BLOCK * MELS)
    ms = 1000 * DOWN / (RATE * UP)
    start = np.arange(blocks) * BLOCK
    end = np.minimum(start + BLOCK, n)
    span = [pa.array(start * HOP * ms), pa.array(((end - 1) * HOP + FRAME) * ms)]
    return pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, storage), *span], names=["tensor", "start_ms", "end_ms"])


def to_ipc(batch) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes):
    import pyarrow as pa

    with pa.ipc.open_stream(data) as r:
        return r.read_next_batch()


def payload_of(text: str | None, multiple: int) -> tuple[bytes, int]:
    """UTF-8 bytes padded with bytes 255 up to a positive multiple; the unpadded size."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(multiple, -(-len(raw) // multiple) * multiple) - len(raw)), len(raw)


def feature_text(batch, spans: np.ndarray) -> str:
    """A digest of the tensors (in eighths), their time spans and the segments."""
    t = batch.column("tensor").storage.flatten().to_numpy()
    ms = 1000 * DOWN * HOP / (RATE * UP)
    active = float((spans[:, 1] - spans[:, 0]).sum() * ms)
    digest = hashlib.sha256(np.round(t * 8).astype("<i2").tobytes() + spans.astype("<i4").tobytes()).hexdigest()[:24]
    return f"blocks={batch.num_rows};end_ms={batch.column('end_ms')[-1].as_py():.1f};segments={len(spans)};active_ms={active:.1f};mel={digest}"


def audio_columns(docs: DataFrame, multiple: int = 576, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Texts as WAV payloads with audio features.

    Returns id_col, n_bytes, payload_bytes, payload_sha256 (of the samples read back), tail_crc32 (last 32 of them),
    media_bytes, media_sha256 (of the WAV file), feature and, with `with_media`, media (the file), tensors (Arrow IPC
    with fixed-shape tensors and spans) and segments_ms array<struct<start_ms,end_ms>>. A null text counts as empty:
    one block of padding. Equal texts give equal values, repeated rows repeated rows.
    Very long texts are one payload each. A null id stays null; other columns are not read; an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = f"`{id_col}` {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if with_media:
        names += ["media", "tensors", "segments_ms"]
        schema += ", media binary, tensors binary, segments_ms array<struct<start_ms:double,end_ms:double>>"

    def run(batches):
        import pyarrow as pa

        ms = 1000 * DOWN * HOP / (RATE * UP)
        for batch in batches:
            for part in byte_slices(batch, 1, 256):
                rows = []
                for text in part.column(1).to_pylist():
                    payload, n = payload_of(text, multiple)
                    media = wav_bytes(payload)
                    back, _ = read_wav(media)
                    mel, db = log_mel(resample(np.frombuffer(back, np.uint8)))
                    spans = segments(db)
                    stored = to_ipc(tensor_batch(mel, db))
                    row = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(from_ipc(stored), spans)]
                    rows.append(row + ([media, stored, [{"start_ms": a * ms, "end_ms": b * ms} for a, b in spans.tolist()]] if with_media else []))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False))], names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
