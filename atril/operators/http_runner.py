"""A runner for servers with the ``/v1/audio/transcriptions`` interface, by the standard library."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
import uuid

import numpy as np

from ..functions.columns import scrub
from ..sources.audio import to_wav
from .runs import BACKOFF_S, FatalError, RetryableError, Runner, status_error

BASE_URL, MODEL, KEY = "ATRIL_BASE_URL", "ATRIL_MODEL", "ATRIL_API_KEY"


def endpoint(base: str) -> str:
    """The address of a server given with or without ``/v1`` and slashes at its end."""
    bare = base.strip().rstrip("/")
    return bare + ("" if bare.endswith("/v1") else "/v1") + "/audio/transcriptions"


def multipart(fields: dict[str, str], name: str, filename: str, data: bytes) -> tuple[bytes, str]:
    """The body of a form with one WAV file, and its content type."""
    mark = uuid.uuid4().hex
    heads = [f'form-data; name="{k}"\r\n\r\n{v}'.encode() for k, v in fields.items()]
    heads.append(f'form-data; name="{name}"; filename="{filename}"\r\nContent-Type: audio/wav\r\n\r\n'.encode() + data)
    body = b"".join(b"--%s\r\nContent-Disposition: %s\r\n" % (mark.encode(), h) for h in heads)
    return body + b"--%s--\r\n" % mark.encode(), f"multipart/form-data; boundary={mark}"


class HttpRunner(Runner):
    """Posts a clip as 16 kHz WAV; base URL, model and key come from the environment, or the first two from the caller."""

    kind, extra, max_concurrency = "remote", "", 3

    def __init__(self, name: str = "openai_compatible", base_url: str | None = None, model: str | None = None, language: str = "es", timeout_s: float = 120.0, backoff_s: tuple[float, ...] = BACKOFF_S, **_):
        self.name, self.base_url, self.model_id, self.language, self.timeout_s, self.backoff_s = name, base_url, model or "", language, timeout_s, backoff_s
        self.env_vars = tuple(v for v, given in ((BASE_URL, base_url), (MODEL, model)) if not given)
        self.label = f"{self.model_id or name} (experimental)"

    def load(self) -> None:
        self.base_url = self.base_url or os.environ[BASE_URL]
        self.model_id = self.model_id or os.environ[MODEL]

    def secrets(self) -> list[str]:
        return [v for v in (os.environ.get(KEY, "").strip(),) if v]

    def info(self) -> dict:
        return {**super().info(), "experimental": True, "form": {"language": self.language, "temperature": 0, "response_format": "json"}}

    def transcribe(self, row: dict) -> str:
        fields = {"model": self.model_id, "language": self.language, "temperature": "0", "response_format": "json"}
        body, kind = multipart(fields, "file", "audio.wav", to_wav(np.asarray(row["audio"], np.float32)))
        headers = {"Content-Type": kind, "Accept": "application/json"} | {"Authorization": f"Bearer {k}" for k in self.secrets()}
        request = urllib.request.Request(endpoint(self.base_url), data=body, headers=headers, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as response:
                said, kind = response.read().decode(errors="replace"), response.headers.get("Content-Type", "")
        except urllib.error.HTTPError as error:
            detail = error.read()[:300].decode(errors="replace")
            raise status_error(error.code, scrub(f"HTTP {error.code} from the server: {detail}", *self.secrets())) from None
        except OSError as error:
            raise RetryableError(scrub(f"{type(error).__name__}: {error}", *self.secrets())) from None
        if "json" not in kind.lower() and not said.lstrip().startswith("{"):
            return said.strip()
        try:
            text = json.loads(said)
        except ValueError:
            raise RetryableError(f"a reply that is no JSON: {said[:200]!r}") from None
        if not isinstance(text, dict) or not isinstance(text.get("text"), str):
            raise FatalError(f"a reply without a text: {said[:200]!r}")
        return text["text"].strip()
