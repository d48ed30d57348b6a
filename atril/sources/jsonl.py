"""JSONL sources and sinks with explicit schemas and checks that name the file and the line."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HYPS = T.StructType([T.StructField("clip_id", T.StringType()), T.StructField("hyp", T.StringType()), T.StructField("secs", T.DoubleType()), T.StructField("error", T.StringType())])


class MalformedFileError(ValueError):
    """A line that is not what the file should hold."""


class DataUnavailableError(RuntimeError):
    """Data that cannot be had here."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value, valid): non-blank lines of each file with physical line numbers; valid JSON objects in UTF-8.

    Files are read in splits. A split's rows are numbered by Spark's ids, which follow their order, and the lines of the
    splits before it come on top, so a large file is no single task.
    """
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value", F.monotonically_increasing_id().alias("id"))
    splits = raw.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    rows = raw.join(splits, ["file", "split"]).where(F.trim("value") != "")
    utf8 = F.is_valid_utf8("value")
    rows = rows.select("file", (F.col("id") + F.col("shift")).alias("line_no"), F.when(utf8, F.col("value")).otherwise(F.make_valid_utf8("value")).alias("value"), utf8.alias("utf8"))
    return rows.withColumn("valid", is_object(F.col("value")) & F.col("utf8")).drop("utf8")


def is_object(value):
    """``from_json`` gives nulls for arrays and cut-off lines alike, so the kind is asked of the parsed variant."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))


def problems(rows: DataFrame) -> DataFrame:
    """Lines that are no hypotheses, with what is wrong."""
    kind = F.coalesce(F.schema_of_variant(F.variant_get(F.try_parse_json("value"), "$.hyp", "variant")), F.lit("VOID"))
    named = F.coalesce(F.get_json_object("value", "$.clip_id"), F.lit("")) != ""
    wrong = F.when(~F.col("valid"), "not a JSON object").when(~named, "no clip_id").when(~kind.isin("VOID", "STRING"), "hyp is not a string")
    return rows.withColumn("problem", wrong).where("problem is not null")


def read_hyps(spark: SparkSession, path: str) -> DataFrame:
    """Checked hypothesis lines: line_no, clip_id, hyp, secs, error."""
    rows = lines(spark, path)
    if bad := problems(rows).orderBy("file", "line_no").first():
        record = rows.where((F.col("file") == bad["file"]) & (F.col("line_no") <= bad["line_no"])).count()
        raise MalformedFileError(f"{bad['file']}: record {record}, line {bad['line_no']} ({bad['problem']})")
    return rows.select("line_no", F.from_json("value", HYPS).alias("r")).select("line_no", "r.*")


def resumable(rows: DataFrame) -> DataFrame:
    """Good lines of a file that a run may have left cut off: a bad last line is dropped, an earlier one raises."""
    last = rows.groupBy("file").agg(F.max("line_no").alias("last"))
    met = rows.join(last, "file")
    if bad := met.where("not valid and line_no < last").orderBy("file", "line_no").first():
        raise MalformedFileError(f"{bad['file']}: line {bad['line_no']}")
    return met.where("valid").select("file", "line_no", F.from_json("value", HYPS).alias("r")).select("file", "line_no", "r.*").where("coalesce(error, '') = ''")


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of parts; null fields are written as nulls."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated without quoting."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def read_subset(df: DataFrame, n_clips: int, limit: int | None = None, name: str = "subset") -> DataFrame:
    """``df`` in its order after a check of its row count; limit 0 or None takes all."""
    if (n := df.count()) != n_clips:
        raise ValueError(f"{name}: {n} clips where {n_clips} are declared")
    return df.orderBy("ord").limit(limit) if limit else df


def parsed(line: bytes | str) -> dict:
    """One line as an object; anything else raises ``ValueError``."""
    found = json.loads(line.decode() if isinstance(line, bytes) else line)
    if not isinstance(found, dict):
        raise ValueError(f"a JSON object is expected, not {type(found).__name__}")
    return found


def read_lines(path: str | Path) -> list[dict]:
    """Objects of a small file on the driver; blank lines are passed over, and what is no object is named by file and line."""
    out = []
    for k, line in enumerate(Path(path).read_bytes().split(b"\n"), 1):
        if line.strip():
            try:
                out.append(parsed(line))
            except ValueError as error:
                raise MalformedFileError(f"{path}, line {k}: {error}") from None
    return out


def write_lines(path: str | Path, rows: Iterable[dict]) -> None:
    """A small file on the driver, an object a line, letters as they are; its name appears once it is whole."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    part.replace(path)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")


def unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` after a check that no key repeats."""
    if twice := repeated(df, f"`{key}`").first():
        raise ValueError(f"{key} {twice[0]} occurs {twice['times']} times")
    return df


def dumps(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
