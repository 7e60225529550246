"""Media columns: texts as 8-bit audio, and log-mel features of it in fixed-shape tensors.

A text's UTF-8 bytes, padded with spaces to a positive multiple of FRAME_BYTES, are the samples of an 8-bit mono PCM WAVE file at
RATE. The files are stored as a column of a table in the shared folder and read from there; features are computed from the samples of the file's data chunk:
- polyphase resampling by UP / DOWN with a windowed-sinc low-pass filter, a branch of it for each output phase;
- log energies of MELS triangular mel bands of Hann-windowed spectra of WINDOW samples every HOP samples;
- segments of energy by hysteresis: a segment opens where a frame's level rises above HIGH and closes where it falls below LOW, both in
  units of the standard deviation from the mean level;
- the frames in tensors of shape (FRAMES, MELS), the last one filled with zeros, each with its start and end in seconds, as
  an Arrow fixed-shape tensor array in an IPC stream.

Every value of a document is computed from its own samples in blocks of a fixed length, so equal texts have equal values wherever they
are, and memory beyond the text itself is bounded by a block.

Defined cases: null counts as empty: one frame of FRAME_BYTES spaces; silence (all samples equal) has no segments; repeated rows have equal values;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

FRAME_BYTES = 192
RATE = 8000
UP, DOWN = 3, 4
TAPS = 12
WINDOW, HOP = 256, 128
MELS = 16
FRAMES = 32
HIGH, LOW = 0.5, -0.5
BLOCK = 1 << 12
#: Documents that are in Python at a time.
SLICE = 64
_OUT_RATE = RATE * UP // DOWN


def to_wave(payload: bytes) -> bytes:
    """An 8-bit mono PCM WAVE file of the samples."""
    size = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + size + size % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", size) + payload + b"\0" * (size % 2)


def from_wave(media: bytes) -> memoryview:
    """The samples of a WAVE file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, view = 12, memoryview(media)
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without data")


def _filter() -> np.ndarray:
    """The low-pass filter's branches: row p makes the output samples of phase p."""
    wide = max(UP, DOWN)
    n = np.arange(-TAPS * wide, TAPS * wide + 1)
    h = np.sinc(n / wide) * np.hamming(len(n))
    h = np.append(h, np.zeros(-len(h) % UP))
    return (UP * h / h.sum()).reshape(-1, UP).T.astype(np.float32)


def _bands() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(0, mel(_OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(WINDOW, 1 / _OUT_RATE)
    up = (f[:, None] - edge[None, :-2]) / (edge[1:-1] - edge[:-2])
    down = (edge[None, 2:] - f[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_FILTER, _BANDS, _HANN = _filter(), _bands(), np.hanning(WINDOW + 1)[:-1].astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """Polyphase resampling: output m is phase m UP-th of the branches, at input m DOWN // UP. Samples around the text are silence."""
    branches, taps = _FILTER.shape
    n = -(-len(samples) * UP // DOWN)
    out = np.empty(n, np.float32)
    half = taps // 2
    for lo in range(0, n, BLOCK * UP):
        m = np.arange(lo, min(n, lo + BLOCK * UP))
        for p in range(branches):
            mine = m[(m * DOWN) % UP == p]
            if len(mine):
                first, last = int(mine[0]) * DOWN // UP, int(mine[-1]) * DOWN // UP
                a, b = first - half, last + taps - half
                part = np.zeros(b - a, np.float32)
                x, y = max(a, 0), min(b, len(samples))
                part[x - a : y - a] = (samples[x:y].astype(np.float32) - 128) / 128
                step = DOWN // np.gcd(UP, DOWN)
                out[mine] = np.lib.stride_tricks.sliding_window_view(part, taps)[:: int(step)][: len(mine)] @ _FILTER[p][::-1]
    return out


def log_mel(signal: np.ndarray) -> np.ndarray:
    """(frames, MELS) log energies; the last frame is filled with silence."""
    frames = max(1, -(-max(0, len(signal) - WINDOW) // HOP) + 1)
    out = np.empty((frames, MELS), np.float32)
    for lo in range(0, frames, 512):
        hi = min(frames, lo + 512)
        part = signal[lo * HOP : (hi - 1) * HOP + WINDOW]
        part = np.append(part, np.zeros((hi - 1 - lo) * HOP + WINDOW - len(part), np.float32))
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, WINDOW)[::HOP] * _HANN)
        power = spectrum.real**2 + spectrum.imag**2
        out[lo:hi] = np.log(power.astype(np.float32) @ _BANDS + 1e-6)
    return out


def segments(mel: np.ndarray) -> list[tuple[float, float]]:
    """Spans in seconds where the level rose above HIGH and until it falls below LOW."""
    level = mel.mean(1)
    spread = level.std()
    if spread < 1e-6:
        return []
    z = (level - level.mean()) / spread
    # State after each frame: that of the last frame that is above HIGH or below LOW.
    mark = np.where(z > HIGH, 1, np.where(z < LOW, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[last] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int), [0]])))
    return [(a * HOP / _OUT_RATE, b * HOP / _OUT_RATE) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow IPC stream: tensor (fixed shape), start, end."""
    n = -(-len(mel) // FRAMES)
    flat = np.zeros((n * FRAMES, MELS), np.float32)
    flat[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    start = np.arange(n) * FRAMES * HOP / _OUT_RATE
    end = np.minimum((np.arange(n) + 1) * FRAMES, len(mel)) * HOP / _OUT_RATE
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), FRAMES * MELS)), pa.array(start), pa.array(end)], names=["tensor", "start", "end"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue()


def read_tensors(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tensors (n, FRAMES, MELS), starts and ends."""
    t = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return t["tensor"].chunk(0).to_numpy_ndarray(), t["start"].to_numpy(), t["end"].to_numpy()


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // FRAME_BYTES)) * FRAME_BYTES - len(raw)), len(raw)


def describe(mel: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """A short text of the features: frames, mean level of each band in hundredths, segments and their seconds."""
    mean = np.rint(100 * mel.mean(0, dtype=np.float64)).astype(int)
    return f"frames={len(mel)};mel={','.join(map(str, mean))};segments={len(spans)};seconds={sum(b - a for a, b in spans):.3f}"


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, spans array<struct<start:double,end:double>>, tensors binary"


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the WAVE file of each document (doc_id, text), written to the shared folder and read from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                part = batch.slice(lo, SLICE)
                made = [payload_of(text.as_py()) for text in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([to_wave(payload) for payload, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(texts.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def audio_features(docs: DataFrame, media: bool = False) -> DataFrame:
    """The digests of the stored media, their features, spans of energy and tensors (an Arrow stream of fixed-shape tensors, each with its time span); with `media`
    also the stored file."""
    more = ", media binary" if media else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                part, rows = batch.slice(lo, SLICE), []
                for doc_id, n, stored in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), part.column("media")):
                    stored = stored.as_py()
                    back = from_wave(stored)
                    blob = tensors(log_mel(resample(np.frombuffer(back, np.uint8))))
                    held, _, end = read_tensors(blob)
                    mel = held.reshape(-1, MELS)[: round(end[-1] * _OUT_RATE / HOP)]
                    spans = segments(mel)
                    row = {"doc_id": doc_id, "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": describe(mel, spans)}
                    rows.append(row | {"spans": [{"start": a, "end": b} for a, b in spans], "tensors": blob} | ({"media": stored} if media else {}))
                yield pa.RecordBatch.from_pylist(rows, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_SCHEMA + more))
    return store_media(docs).mapInArrow(run, _SCHEMA + more)
