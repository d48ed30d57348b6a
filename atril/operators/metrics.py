"""Metrics as ratios of sums over the fact table, never means of ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: metric: numerator, denominator, scale
METRICS = {
    "wer": ("s + d + i", "n_ref", 1),
    "term_recall": ("term_hits", "term_n", 1),
    "term_word_error_rate": ("term_word_errors", "term_words", 1),
    "other_word_error_rate": ("other_word_errors", "other_words", 1),
    "insertions_per_1k": ("i", "n_ref", 1000),
    "degenerate_rate": ("cast(size(degenerate) > 0 as int)", "1", 1),
}


def ratio(num: Column, den: Column, scale: float = 1) -> Column:
    """Null where the denominator is zero."""
    return F.lit(float(scale)) * num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def metric(name: str) -> Column:
    num, den, scale = METRICS[name]
    return ratio(F.sum(F.expr(num)), F.sum(F.expr(den)), scale).alias(name)


def metrics(scores: DataFrame, *by: str, only: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """All metrics for each group, in one pass."""
    return scores.groupBy(*by).agg(*(metric(m) for m in only))


def by_condition(scores: DataFrame, *by: str, only: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """Metrics overall and for each condition, by grouping sets: ``part`` is "all" or the condition's name."""
    sets = [list(by), [*by, "condition"]]
    grouped = scores.groupingSets(sets, *by, "condition").agg(*(metric(m) for m in only), F.grouping("condition").alias("g"))
    return grouped.where("g = 1 or condition is not null").select(*by, F.when(F.col("g") == 1, "all").otherwise(F.col("condition")).alias("part"), *only)


def counts(scores: DataFrame, *by: str) -> DataFrame:
    sums = {"s": "n_sub", "d": "n_del", "i": "n_ins", "n_ref": "n_words", "terms_not_in_ref": "n_terms_not_in_ref"}
    return scores.groupBy(*by).agg(*(F.sum(c).alias(n) for c, n in sums.items()), F.count_distinct("block").alias("n_blocks"))


def degenerate_clips(scores: DataFrame) -> DataFrame:
    """(clip_id, flags) of clips with flags, in their order where the table has one."""
    found = scores.where(F.size("degenerate") > 0)
    return (found.orderBy("ord") if "ord" in scores.columns else found).select("clip_id", "degenerate")


def flags_by_clip(scores: DataFrame, *by: str) -> DataFrame:
    """(*by, flags): a map from clip to its flags, of clips that have some. Each group's map is one value."""
    pairs = F.collect_list(F.when(F.size("degenerate") > 0, F.struct(F.col("clip_id").cast("string"), "degenerate")))
    return scores.groupBy(*by).agg(F.map_from_entries(F.array_sort(pairs)).alias("flags"))


def having_all(rows: DataFrame, key: str, column: str, wanted: list) -> DataFrame:
    """Keys that have every wanted value."""
    return rows.where(F.col(column).isin(wanted)).groupBy(key).agg(F.count_distinct(column).alias("n")).where(F.col("n") == len(set(wanted))).select(key)


def macro(scores: DataFrame, name: str, strata: str, *by: str) -> DataFrame:
    """Unweighted mean of a metric over strata."""
    return metrics(scores, *by, strata, only=(name,)).groupBy(*by).agg(F.avg(name).alias(f"macro_{name}"))


def rtf(scores: DataFrame, *by: str) -> DataFrame:
    """Median of seconds over duration, of scored clips that have both."""
    ok = "secs is not null and duration_s > 0 and error is null and not missing"
    return scores.where(ok).groupBy(*by).agg(F.round(F.median(F.col("secs") / F.col("duration_s")), 5).alias("rtf_median"))
