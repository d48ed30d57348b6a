"""Column functions: block keys, durations, secrets, chunks, paths, endpoints, PCM samples and their digests."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a clip's duration may stand, in the order in which these are asked.
DURATIONS = ("duration_s", "duration", "audio_s")
RATE = 16_000
#: Characters of an error that are kept, and what stands for a secret.
ERROR_CHARS, MASK = 500, "***"


def text_id(meta: Column, top: Column | None = None) -> Column:
    """``meta['text_id']`` of a string map; a key that is there with a null value wins over the column ``top``."""
    inside = F.map_contains_key(meta, "text_id")
    return F.when(F.coalesce(inside, F.lit(False)), F.element_at(meta, "text_id")).otherwise(F.lit(None).cast("string") if top is None else top.cast("string"))


def block_key(block: str, clip_id: Column, text: Column) -> Column:
    """What a clip is resampled with: itself, or its text (itself where it has none)."""
    own = clip_id.cast("string")
    return own if block == "clip" else F.coalesce(text.cast("string"), own)


def duration(meta: Column, samples: Column | None = None, rate: int = RATE) -> Column:
    """Seconds: samples over the rate where audio is there, else the first of DURATIONS that is neither absent nor zero."""
    told = F.coalesce(*(F.nullif(F.try_element_at(meta, F.lit(k)).cast("double"), F.lit(0.0)) for k in DURATIONS))
    return told if samples is None else F.coalesce(samples / F.lit(float(rate)), told)


def scrubbed(text: Column, *secrets: str | None) -> Column:
    """``text`` without the secrets, cut to ERROR_CHARS."""
    for secret in filter(None, secrets):
        text = F.replace(text, F.lit(secret), F.lit(MASK))
    return F.substring(text, 1, ERROR_CHARS)


def scrub(text: object, *secrets: str | None) -> str:
    """The same for a Python string."""
    out = str(text)
    for secret in filter(None, secrets):
        out = out.replace(secret, MASK)
    return out[:ERROR_CHARS]


def chunks(data: Column, size: int) -> Column:
    """Stretches of ``size`` bytes of a binary column, the last one shorter; none of an empty value."""
    n = F.ceil(F.octet_length(data) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(data, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def retryable(status: Column) -> Column:
    """Whether an HTTP status may pass when tried again."""
    return status.isin(408, 425, 429) | (status >= 500)


def stem(path: Column) -> Column:
    """A file's name without folder and last suffix; a name that begins with its only dot is whole."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def collapsed(text: Column) -> Column:
    """White space (Unicode's) collapsed to one space and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0d\x1c-\x20\x85\p{Z}]+", " "))


def endpoint(base: Column) -> Column:
    """The transcription address of a server given with or without ``/v1`` and slashes at its end."""
    bare = F.regexp_replace(F.trim(base), "/+$", "")
    return F.concat(F.when(bare.endswith("/v1"), bare).otherwise(F.concat(bare, F.lit("/v1"))), F.lit("/audio/transcriptions"))


def pcm16_value(x: Column) -> Column:
    """One sample as ``pcm16`` has it, as a number."""
    return F.greatest(F.least(F.rint(x * 32768), F.lit(32767.0)), F.lit(-32768.0)).cast("int")


def pcm16(samples: np.ndarray) -> bytes:
    """Little-endian 16-bit samples of floats: times 32,768, rounded, clipped."""
    return np.clip(np.rint(np.asarray(samples, np.float32).reshape(-1) * np.float32(1 << 15)), -(1 << 15), (1 << 15) - 1).astype("<i2").tobytes()


def pcm16_sha256(samples: np.ndarray) -> str:
    """SHA-256 of 16-bit samples, whatever file they came from."""
    return hashlib.sha256(np.ascontiguousarray(samples, "<i2").tobytes()).hexdigest()


def wav_pcm_sha256(wav: Column, head: int = 44) -> Column:
    """The same of WAV files with a plain header of ``head`` bytes, as ``audio.to_wav`` writes them."""
    return F.sha2(F.substring(wav, F.lit(head + 1), F.octet_length(wav) - head), 256)
