"""Hypothesis lines: duplicates, gaps, and joins with the clips.

Lines have clip_id, line_no, hyp, secs, error. The last successful line of a clip wins; an error stands only where no
line succeeded (the last error does). Clips without a line are missing; missing and failed clips count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAILED = "coalesce(error, '') <> ''"


def last_success(lines: DataFrame) -> DataFrame:
    """One row a clip. A maximum of structs, so that lines meet in partial sums and not in a sorted window."""
    best = F.max_by(F.struct("hyp", "secs", "error"), F.struct(F.expr(f"not ({FAILED})"), "line_no")).alias("best")
    fields = (f"if(coalesce(best.error, '') <> '', '', coalesce(best.hyp, '')) as hyp", "if(coalesce(best.error, '') <> '', null, best.secs) as secs", "nullif(best.error, '') as error")  # noqa: F541
    return lines.groupBy("clip_id").agg(best).selectExpr("clip_id", *fields)


def joined(clips: DataFrame, lines: DataFrame) -> DataFrame:
    """Every clip with its hypothesis; ``missing`` where there is none. Lines of unknown clips fall away."""
    found = last_success(lines).withColumn("present", F.lit(True))
    return clips.join(found, "clip_id", "left").withColumn("missing", F.col("present").isNull()).drop("present")


def nested(clips: DataFrame) -> DataFrame:
    """``joined`` for clips that bring their own lines in an array ``lines``: no row leaves its place."""
    ranked = F.array_max(F.transform("lines", lambda x: F.struct((F.coalesce(x["error"], F.lit("")) == "").alias("ok"), x["line_no"].alias("line_no"), x["hyp"].alias("hyp"), x["secs"].alias("secs"), x["error"].alias("error"))))
    best = clips.select("*", F.inline(F.array(F.struct(ranked.alias("best"))))).drop("lines")  # a generator, so that the choice is made once
    told = {"hyp": F.when(F.col("best.ok"), F.coalesce("best.hyp", F.lit(""))).otherwise(F.when(F.col("best").isNotNull(), "")), "secs": F.when(F.col("best.ok"), F.col("best.secs")), "error": F.when(~F.col("best.ok"), F.col("best.error")), "missing": F.col("best").isNull()}
    return best.withColumns(told).drop("best")


def todo(clips: DataFrame, lines: DataFrame) -> DataFrame:
    """Clips without a successful line: what a resumed run has left to do."""
    return clips.join(lines.where(f"not ({FAILED})").select("clip_id"), "clip_id", "left_anti")


def wanted(clips: DataFrame, ids: DataFrame) -> DataFrame:
    return clips.join(ids.select("clip_id"), "clip_id", "left_semi")


def orphans(clips: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of clips that do not exist."""
    return lines.join(clips.select("clip_id"), "clip_id", "left_anti")


def completeness(pairs: DataFrame) -> DataFrame:
    """Clips, scored, missing and failed ones of ``pairs``."""
    failed = F.col("error").isNotNull()
    return pairs.agg(
        F.count("*").alias("n_clips"),
        F.count_if(~F.col("missing") & ~failed).alias("n_scored"),
        F.count_if("missing").alias("n_missing"),
        F.count_if(failed).alias("n_errors"),
        (F.count_if(F.col("missing") | failed) == 0).alias("complete"),
    )
