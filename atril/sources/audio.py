"""WAV audio as 16 kHz mono: decoding, resampling and writing, by numpy in Arrow batches.

Other containers than RIFF/WAVE with PCM or float samples raise ``DataUnavailableError``: no codec library is at hand.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .jsonl import DataUnavailableError

RATE = 16_000
#: WAVE format tags: integer samples, float samples, and those that say which of the two later on.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Zero crossings of the resampling filter to each side.
ZEROS = 32


def samples(encoded: bytes) -> tuple[np.ndarray, int]:
    """(float32 frames x channels, rate) of a WAV file. A data chunk that is cut off gives its whole frames."""
    if encoded[:4] != b"RIFF" or encoded[8:12] != b"WAVE":
        raise DataUnavailableError("only WAV audio can be decoded here")
    at, kind, data = 12, None, None
    while at + 8 <= len(encoded) and data is None:
        name, size = encoded[at : at + 4], struct.unpack_from("<I", encoded, at + 4)[0]
        body = encoded[at + 8 : at + 8 + size]
        if name == b"fmt ":
            tag, channels, rate, _, frame, bits = struct.unpack_from("<HHIIHH", body)
            if tag == EXTENSIBLE:
                tag = struct.unpack_from("<H", body, 24)[0]
            kind = tag, bits
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if kind is None or data is None:
        raise DataUnavailableError("WAV audio without format or data")
    data = data[: len(data) // frame * frame]
    match kind:
        case (1, 8):
            x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
        case (1, 16):
            x = np.frombuffer(data, "<i2").astype(np.float32) / 2**15
        case (1, 24):
            wide = np.zeros((len(data) // 3, 4), np.uint8)
            wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
            x = wide.view("<i4")[:, 0].astype(np.float32) / 2**31
        case (1, 32):
            x = np.frombuffer(data, "<i4").astype(np.float32) / 2**31
        case (3, 32 | 64):
            x = np.frombuffer(data, f"<f{kind[1] // 8}").astype(np.float32)
        case _:
            raise DataUnavailableError(f"WAV samples of kind {kind}")
    return x.reshape(-1, channels), rate


def resampled(x: np.ndarray, rate: int, to: int = RATE, block: int = 1 << 14) -> np.ndarray:
    """``x`` at the rate ``to``: a Hann-windowed sinc that passes what both rates can hold, block by block."""
    if rate == to or not len(x):
        return x
    n, cut = -(-len(x) * to // rate), min(1.0, to / rate)
    half = int(np.ceil(ZEROS / cut))
    padded, out = np.pad(x.astype(np.float64), half + 1), np.empty(n, np.float32)
    near = np.arange(-half, half + 1)
    for a in range(0, n, block):
        place = np.arange(a, min(n, a + block)) * (rate / to)
        base = np.floor(place).astype(np.int64)
        away = place[:, None] - base[:, None] - near[None, :]
        taps = cut * np.sinc(cut * away) * np.where(np.abs(away) <= half, 0.5 + 0.5 * np.cos(np.pi * away / half), 0.0)
        out[a : a + len(place)] = (padded[base[:, None] + near[None, :] + half + 1] * taps).sum(1)
    return out


def load_16k(encoded: bytes) -> np.ndarray:
    """float32 mono at 16 kHz; channels are averaged."""
    x, rate = samples(encoded)
    return np.ascontiguousarray(resampled(x.mean(1) if x.shape[1] > 1 else x[:, 0], rate), np.float32)


def to_wav(audio: np.ndarray) -> bytes:
    """A 16 kHz mono WAV file with 16-bit samples; values beyond -1 and 1 are clipped to them."""
    pcm = np.clip(np.rint(np.clip(audio, -1.0, 1.0) * 2**15), -(2**15), 2**15 - 1).astype("<i2").tobytes()
    head = struct.pack("<HHIIHH", PCM, 1, RATE, 2 * RATE, 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(pcm)) + pcm


def write_wav_16k(encoded: bytes, dest: str | Path) -> np.ndarray:
    """Write ``encoded`` as 16 kHz mono; the name appears once the file is whole. Returns the 16-bit samples."""
    made, dest = to_wav(load_16k(encoded)), Path(dest)
    dest.parent.mkdir(parents=True, exist_ok=True)
    part = dest.with_name(dest.name + ".part")
    part.write_bytes(made)
    os.replace(part, dest)
    return np.frombuffer(made, "<i2", offset=44)


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` (of the binaryFile source) with ``wav``, their audio as a 16 kHz WAV file, and ``duration_s`` in
    place of the content; null content gives nulls. No shuffle."""
    keep = [f"`{c}`" for c in files.columns if c != content]
    rows = files.select(*keep, f"`{content}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if c is None else load_16k(c) for c in b.column(b.num_columns - 1).to_pylist()]
            wav = pa.array([None if x is None else to_wav(x) for x in made], pa.binary())
            long = pa.array([None if x is None else len(x) / RATE for x in made], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], wav, long], [*b.schema.names[:-1], "wav", "duration_s"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "wav binary", "duration_s double"]))
