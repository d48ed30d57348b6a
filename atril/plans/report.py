"""Leaderboard: union of systems, unique ids, ranking, cells and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DASH = "–"


def unique_ids(ids: list[str], taken: set[str] | None = None) -> list[str]:
    """Ids made unique in order by -2, -3 and so on."""
    used, out = set(taken or ()), []
    for name in ids:
        new, k = name, 2
        while new in used:
            new, k = f"{name}-{k}", k + 1
        used.add(new)
        out.append(new)
    return out


def union(published: DataFrame, local: DataFrame) -> DataFrame:
    return published.unionByName(local, allowMissingColumns=True)


def _order(value: str) -> list[Column]:
    pinned = F.col("type") == "results-only"
    return [F.when(pinned, 0).otherwise(1).asc(), F.when(pinned, F.col("ord")).asc(), F.col(value).isNull().asc(), F.col(value).asc(), F.lower("label").asc(), F.col("ord").asc()]


def ranked(systems: DataFrame, value: str) -> DataFrame:
    """Results-only systems first in their own order, then by value, missing ones last; ties by label, then order."""
    return systems.orderBy(*_order(value))


def ranks(systems: DataFrame, value: str) -> DataFrame:
    """``systems`` (some tens of rows) with their ``rank`` in that order."""
    return systems.withColumn("rank", F.row_number().over(Window.orderBy(*_order(value))))


def percent(value: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """A cell in percent with its interval, a dash where there is no value."""
    cell = F.format_string("%.1f", value * 100)
    if lo is not None:
        cell = F.when(lo.isNull(), cell).otherwise(F.concat(cell, F.format_string(" [%.1f–%.1f]", lo * 100, hi * 100)))
    return F.when(value.isNull(), DASH).otherwise(cell)


def escaped(cell: str | None) -> str:
    return DASH if not cell else cell.replace("|", "\\|").replace("\n", " ")


def split_view(scores: DataFrame) -> DataFrame:
    """WER of clean and degraded clips side by side."""
    return scores.groupBy("system").pivot("condition", ["clean", "degraded"]).agg(F.round(F.sum(F.expr("s + d + i")) / F.sum("n_ref"), 6))


def markdown(rows: list[dict], columns: list[str]) -> str:
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(escaped(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"
