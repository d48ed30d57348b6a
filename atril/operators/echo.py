"""A runner without a model, for trying a run end to end: it says how many samples it heard."""

from __future__ import annotations

from .runs import Runner


class Echo(Runner):
    name, label, model_id, batch_size = "echo", "Echo", "none", 4

    def transcribe(self, row: dict) -> str:
        audio = row.get("audio")
        return f"texto {0 if audio is None else len(audio)}"
