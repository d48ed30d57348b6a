"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b). Large star: a node's larger neighbours move to its least; small star: its smaller ones and itself do."""
    sides = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = sides.join(least, "a")
    moved = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); root: the least node of its component. Each round is written to
    the shared folder; rounds grow with the logarithm of the longest chain. No links: no rows. Null ends are dropped."""
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    was = None
    while (mark := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != was and mark[0]:
        was, now = mark, materialize(_star(materialize(_star(now, True), "star"), False), "star")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
