"""The fact table: one row of counts for each (system, clip). Everything else is sums over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.batch import column_of, facts_in, listed, spaced
from ..functions.normalizer import tokenize
from ..functions.scoring import FIELDS, PARTS

#: Rows whose tokens a worker holds as Python objects at once.
ROWS = 4096
DETAIL = T.StructType([T.StructField("tandem", T.ArrayType(T.StringType())), T.StructField("rep5", T.DoubleType()), T.StructField("runaway", T.BooleanType())])
_DETAIL = pa.struct([("tandem", pa.list_(pa.string())), ("rep5", pa.float64()), ("runaway", pa.bool_())])


#: The fields of the parts that have some.
OF_PART = {"edits": FIELDS[:5], "terms": FIELDS[5:]}


def score_pairs(pairs: DataFrame, normalized: bool = True, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """``pairs`` with FIELDS, ``degenerate`` (flags) and ``detail`` (what a loop consists of), without ref, hyp and terms. No shuffle.

    parts: those of PARTS that are wanted; columns of others are neither made nor there.
    normalized: ref and hyp are raw texts for the normalizer; else ref is a token array and hyp is split at spaces.
    """
    kept = [c for c in pairs.columns if c not in ("ref", "hyp", "terms")]
    fields = [f for part, own in OF_PART.items() if part in parts for f in own]
    flagged, rows_of = "flags" in parts, [FIELDS.index(f) for f in fields]
    names = [*kept, *fields, *(("degenerate", "detail") if flagged else ())]
    at = {c: pairs.columns.index(c) for c in pairs.columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                ref, hyp, terms = (b.column(at[c]) for c in ("ref", "hyp", "terms"))
                sides = [column_of([tokenize(t) for t in x.to_pylist()]) for x in (ref, hyp)] if normalized else [listed(ref), spaced(hyp)]
                counts, flags, details = facts_in(*sides, listed(terms), normalized, parts)
                made = [*map(pa.array, np.ascontiguousarray(counts.T[rows_of]))]
                if flagged:
                    made += [pa.array(flags, pa.list_(pa.string())), pa.array([d or None for d in details], _DETAIL)]
                yield pa.RecordBatch.from_arrays([*(b.column(at[c]) for c in kept), *made], names)

    schema = T.StructType([pairs.schema[c] for c in kept])
    for f in fields:
        schema = schema.add(f, T.LongType())
    return pairs.mapInArrow(run, schema.add("degenerate", T.ArrayType(T.StringType())).add("detail", DETAIL) if flagged else schema)
