"""Run loop: a pluggable function over the clips that are left, errors as data, lines in a file that a run can resume."""

from __future__ import annotations

import json
import os
import platform
import random
import time
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import RATE, scrub
from ..sources import jsonl
from .hypotheses import todo

#: Seconds before each retry, to which up to JITTER_S come; requests at once to a hosted system at most.
BACKOFF_S, JITTER_S, MAX_AT_ONCE = (2.0, 4.0, 8.0), 1.0, 3
KINDS = ("local", "remote")
LINE = "clip_id string, hyp string, secs double, error string"


class RetryableError(RuntimeError):
    """May pass when tried again."""


class FatalError(RuntimeError):
    """Never tried again."""


def status_error(status: int, message: str) -> RuntimeError:
    """The error of an HTTP status: 408, 425, 429 and those from 500 on may pass when tried again."""
    return (RetryableError if status in (408, 425, 429) or status >= 500 else FatalError)(message)


def with_retries(attempt: Callable[[], str], backoff_s: Sequence[float] = BACKOFF_S, sleep: Callable[[float], None] = time.sleep) -> str:
    """What ``attempt`` returns. A ``RetryableError`` is tried again after each wait, the last one is raised; any other is at once."""
    for wait in backoff_s:
        try:
            return attempt()
        except RetryableError:
            if wait > 0:
                sleep(wait + random.uniform(0.0, JITTER_S))
    return attempt()


class Runner:
    """A system under test, in its default configuration; it sees a clip's audio and nothing of its reference.

    ``ensure_loaded`` once a worker, then ``warmup``, then clips or batches; a batch that fails is tried clip by clip.
    """

    name, kind, label, extra, model_id, revision = "runner", "local", None, "", "", None
    env_vars: tuple[str, ...] = ()
    batch_size = max_concurrency = 1
    backoff_s: tuple[float, ...] = BACKOFF_S

    def check_env(self) -> None:
        """Raises with the names, never the values, of variables that are not set."""
        if absent := [v for v in self.env_vars if not os.environ.get(v)]:
            raise RuntimeError(f"{self.name}: set the environment variable(s) {', '.join(absent)}")

    def load(self) -> None:
        """Load weights or open a client."""

    def close(self) -> None:
        """Give back what ``load`` took."""

    def warmup(self) -> None:
        """Before the first clip: a local system hears a second of silence."""
        if self.kind == "local":
            self.transcribe({"clip_id": "", "audio": np.zeros(RATE, np.float32)})

    def ensure_loaded(self) -> None:
        self.check_env()
        self.load()

    def transcribe(self, row: dict) -> str:
        raise NotImplementedError

    def transcribe_batch(self, rows: list[dict]) -> list[str]:
        return [self.transcribe(r) for r in rows]

    def secrets(self) -> list[str]:
        return [v for name in self.env_vars if (v := os.environ.get(name, "").strip())]

    def info(self) -> dict:
        return {"model": self.name, "label": self.label or self.name, "kind": self.kind, "extra": self.extra, "model_id": self.model_id, "revision": self.revision}


def run(clips: DataFrame, done: DataFrame, runner: Runner, batch: int | None = None, at_once: int | None = None) -> DataFrame:
    """Hypothesis lines of the clips that have no successful line in ``done``.

    at_once: a cap on parallel tasks, which for hosted systems is never above MAX_AT_ONCE. Failures are lines with an
    error, without the runner's secrets.
    """
    if runner.kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, got {runner.kind!r}")
    batch = max(1, batch or runner.batch_size)
    cap = max(1, min(at_once or runner.max_concurrency, MAX_AT_ONCE)) if runner.kind == "remote" else at_once
    left = todo(clips, done)
    left = left.repartition(cap) if cap else left

    def one(row: dict) -> tuple[str, float, str | None]:
        began, hyp, error = time.perf_counter(), "", None
        try:
            hyp = with_retries(lambda: runner.transcribe(row), runner.backoff_s)
        except Exception as e:  # noqa: BLE001  errors are rows
            error = scrub(f"{type(e).__name__}: {e}", *runner.secrets())
        return hyp, time.perf_counter() - began, error

    def several(rows: list[dict]) -> list[tuple[str, float, str | None]]:
        began = time.perf_counter()
        try:
            hyps = list(runner.transcribe_batch(rows))
            if len(hyps) != len(rows):
                raise ValueError(f"{len(hyps)} texts for {len(rows)} clips")
        except Exception:  # noqa: BLE001
            return [one(r) for r in rows]
        return [(h, (time.perf_counter() - began) / len(rows), None) for h in hyps]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = False
        try:
            for frame in frames:
                for at in range(0, len(frame), batch):
                    if not opened:
                        runner.ensure_loaded()
                        runner.warmup()
                        opened = True
                    rows = frame.iloc[at : at + batch].to_dict("records")
                    made = several(rows) if len(rows) > 1 else [one(rows[0])]
                    yield pd.DataFrame({"clip_id": [str(r["clip_id"]) for r in rows], "hyp": [h for h, _, _ in made], "secs": [round(s, 4) for _, s, _ in made], "error": [e for *_, e in made]})
        finally:
            if opened:
                runner.close()

    return left.mapInPandas(work, LINE)


def resumed(path: str | Path, log: Callable[[str], None] = print) -> list[dict]:
    """Successful lines of a file, which is rewritten to hold just these, so that failed clips are tried again.

    A last line that is no line of a run (one was killed while it wrote) is dropped with a warning; an earlier one raises.
    """
    path, good = Path(path), []
    if not path.exists():
        return good
    lines = [(k, x) for k, x in enumerate(path.read_bytes().split(b"\n"), 1) if x.strip()]
    for k, line in lines:
        try:
            row = jsonl.parsed(line)
            if row.get("clip_id") in (None, ""):
                raise ValueError("no clip_id")
        except ValueError as error:
            if k != lines[-1][0]:
                raise jsonl.MalformedFileError(f"{path}, line {k}: {error}; mend or delete that line to resume") from None
            log(f"warning: {path}, line {k} is incomplete ({error}); its clip is done again")
            continue
        if not row.get("error"):
            good.append(row)
    jsonl.write_lines(path, good)
    return good


def run_file(runner: Runner, rows: DataFrame, path: str | Path, subset: str, log: Callable[[str], None] = print) -> Path:
    """Transcribe ``rows`` (clip_id, audio and the like) into the lines of ``path`` on the driver, one flushed after the
    other as tasks give them; what is in the file stays. What the run was goes to ``<path's stem>.run.json``."""
    path, spark = Path(path), rows.sparkSession
    path.parent.mkdir(parents=True, exist_ok=True)
    known = resumed(path, log)
    done = spark.createDataFrame([(str(r["clip_id"]), None) for r in known], "clip_id string, error string")
    clips = rows.withColumn("clip_id", F.col("clip_id").cast("string"))
    n, left = clips.count(), todo(clips, done).count()
    log(f"{runner.name} / {subset}: {n - left} done, {left} to go -> {path}")
    if not left:
        return path
    runner.check_env()
    errors = 0
    with path.open("a", encoding="utf-8") as out:
        for r in run(clips, done, runner).toLocalIterator(prefetchPartitions=True):
            line = {"clip_id": r["clip_id"], "hyp": r["hyp"], "secs": r["secs"]} | ({"error": r["error"]} if r["error"] else {})
            errors += "error" in line
            out.write(json.dumps(line, ensure_ascii=False) + "\n")
            out.flush()
    about = {**runner.info(), "subset": subset, "n_clips": n, "n_errors_last_run": errors, "python": platform.python_version(), "platform": platform.platform(terse=True), "finished_utc": datetime.now(UTC).isoformat(timespec="seconds")}
    path.with_suffix(".run.json").write_text(jsonl.dumps(about) + "\n", encoding="utf-8")
    log(f"{runner.name} / {subset}: finished, {errors} error(s) this run")
    return path
