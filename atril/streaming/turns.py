"""Transcript event folds: final tokens, turns, in batch and as a stream.

Events have clip_id, seq, kind, event, turn_index, text, is_final. In a turn the last EndOfTurn wins and later updates
are ignored; a turn that never ended gives its last update, which may be empty and then adds nothing; turns join in order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import RATE

#: Milliseconds of audio in a frame, and seconds that an open turn is waited for.
FRAME_MS, FLUSH_S = 100, 6.0
CONTROL = ("<end>", "<fin>")


def _in_order(key: str, text: str, sep: str):
    pairs = F.array_sort(F.collect_list(F.struct(key, text)))
    return F.array_join(F.transform(pairs, lambda p: p[text]), sep)


def final_tokens(events: DataFrame) -> DataFrame:
    """Final tokens of each clip in order, control tokens left out, and whether an end marker came."""
    final = F.when(F.expr("kind = 'token' and is_final") & ~F.col("text").isin(*CONTROL), F.col("text"))
    marked = events.withColumn("token", final)
    return marked.groupBy("clip_id").agg(F.trim(_in_order("seq", "token", "")).alias("text"), F.bool_or(F.col("kind") == "finished").alias("complete"))


def turns(events: DataFrame) -> DataFrame:
    """(clip_id, text): what each turn said, in the order of turns."""
    ended = F.max_by(F.trim("text"), F.when(F.col("event") == "EndOfTurn", F.col("seq")))
    open_ = F.max_by(F.trim("text"), F.when(F.col("event") != "EndOfTurn", F.col("seq")))
    each = events.where("kind = 'TurnInfo'").groupBy("clip_id", "turn_index").agg(F.coalesce(ended, open_).alias("said")).where("said <> ''")
    return each.groupBy("clip_id").agg(_in_order("turn_index", "said", " ").alias("text"))


def concatenated(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Texts of each key joined by spaces in order."""
    return rows.groupBy(key).agg(_in_order(order, text, " ").alias("text"))


def final_results(events: DataFrame) -> DataFrame:
    """(clip_id, text, finalized, complete): final results of each clip joined by spaces in the order of arrival, whether
    one came after the request to finalize, and whether the stream ended as it should (metadata, or that reply)."""
    final = F.expr("kind = 'Results' and is_final")
    said = F.when(final & (F.trim("text") != ""), F.trim("text"))
    asked = F.col("from_finalize") if "from_finalize" in events.columns else F.lit(False)
    rows = events.withColumns({"said": said, "asked": final & F.coalesce(asked, F.lit(False))})
    each = rows.groupBy("clip_id").agg(_in_order("seq", "said", " ").alias("text"), F.coalesce(F.bool_or("asked"), F.lit(False)).alias("finalized"), F.coalesce(F.bool_or(F.col("kind") == "Metadata"), F.lit(False)).alias("told"))
    return each.select("clip_id", "text", "finalized", (F.col("told") | F.col("finalized")).alias("complete"))


def outcomes(folded: DataFrame) -> DataFrame:
    """Hypothesis lines of folded clips: those whose stream did not end as it should are errors that may be tried again."""
    error = F.when(~F.coalesce(F.col("complete"), F.lit(False)), "RetryableError: the stream ended without its end marker")
    return folded.select("clip_id", F.when(error.isNull(), F.col("text")).otherwise("").alias("hyp"), error.alias("error"))


def frames(pcm: bytes, trail_s: float, frame_ms: int = FRAME_MS, rate: int = RATE) -> list[bytes]:
    """16-bit samples in frames of ``frame_ms``, the last one as long as it is, then frames of silence."""
    size = rate * frame_ms // 1000 * 2
    return [pcm[k : k + size] for k in range(0, len(pcm), size)] + [bytes(size)] * round(trail_s * 1000 / frame_ms)


def paced(parts: list, frame_ms: int = FRAME_MS, clock: Callable[[], float] = time.perf_counter, sleep: Callable[[float], None] = time.sleep) -> Iterator:
    """``parts`` in real time: the k-th not before k frames after the first, without drift."""
    began = clock()
    for k, part in enumerate(parts):
        if (wait := began + k * frame_ms / 1000 - clock()) > 0:
            sleep(wait)
        yield part


def paced_stream(spark: SparkSession, frame_ms: int = FRAME_MS) -> DataFrame:
    """(seq, at): a streaming frame with a row a frame in real time, by Spark's rate source."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", max(1, 1000 // frame_ms)).load()
    return rate.select(F.col("value").alias("seq"), F.col("timestamp").alias("at"))


def stream_turns(events: DataFrame, flush_s: float = FLUSH_S) -> DataFrame:
    """(clip_id, turn_index, text) as turns end, for a streaming frame.

    Each turn comes once: at its EndOfTurn, after which updates are ignored, or with its last text once nothing came for
    ``flush_s`` seconds. Together that is what ``turns`` folds; turns without text do not come.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, last, seq = state.get if state.exists else (False, "", -1)
        give = None
        if state.hasTimedOut:
            done, give = True, None if done else last
        else:
            for part in parts:
                for row in part.sort_values("seq").itertuples():
                    if done:
                        continue
                    if row.event == "EndOfTurn":
                        done, give = True, (row.text or "").strip()
                    elif row.seq > seq:
                        last, seq = (row.text or "").strip(), row.seq
        state.update((done, last, seq))
        if not done:
            state.setTimeoutDuration(int(flush_s * 1000))
        if give:
            yield pd.DataFrame({"clip_id": [key[0]], "turn_index": [key[1]], "text": [give]})

    grouped = events.where("kind = 'TurnInfo'").groupBy("clip_id", "turn_index")
    return grouped.applyInPandasWithState(run, "clip_id string, turn_index int, text string", "done boolean, last string, seq long", "append", "ProcessingTimeTimeout")
