"""Where the caller's own functions plug in: detectors, models, evaluators, classifiers, and SQL table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import UserDefinedTableFunction

from ..functions.text import yes_or_no
from .fold import Options, mask_text

#: What a detector gives for a text: (start, end, tag, confidence) of each find, in characters.
Detector = Callable[[str], list[tuple[int, int, str, float | None]]]
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tag", pa.string()), ("confidence", pa.float64())]))
_FIELDS = "array<struct<start:int,end:int,tag:string,confidence:double>>"


def detect_with(docs: DataFrame, detector: Detector, required: bool = False, text: str = "text") -> DataFrame:
    """The input's other columns with ``found`` and ``detector_failed``.

    A detector that raises, or gives a span outside the text, has found none of the text's values, unless it is ``required``:
    then that is an error.  A null text is the empty text."""
    keep = [c for c in docs.columns if c not in (text, "found", "detector_failed")]
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), *keep)

    def of(value: str) -> tuple[list[dict], bool]:
        try:
            out = [dict(zip(("start", "end", "tag", "confidence"), hit, strict=True)) for hit in detector(value)]
            if any(not 0 <= h["start"] < h["end"] <= len(value) for h in out):
                raise ValueError("DETECTOR_SPAN_INVALID")
        except Exception:
            if required:
                raise RuntimeError("DETECTOR_FAILED") from None  # its message may hold text
            return [], True
        return sorted(out, key=lambda h: (h["start"], h["end"], h["tag"])), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                done = [of(t) for t in part.column(0).to_pylist()]
                columns = [pa.array([d for d, _ in done], _FOUND), pa.array([f for _, f in done], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], [*part.schema.names[1:], "found", "detector_failed"])

    added = T.StructType([T.StructField("found", T._parse_datatype_string(_FIELDS)), T.StructField("detector_failed", T.BooleanType())])
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *added.fields]))


def asked(candidates: DataFrame, model: Callable[[str, str], str], most: int | None = None) -> DataFrame:
    """Candidates (tag, value, rank, ...) with ``confirmed``: what a model says of each, yes, no or null where it gives neither or
    fails; with ``most``, only the best so many of each document are asked on and the others are null."""

    def run(tags: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for tag, value in zip(tags, values, strict=True):
            try:
                out.append(None if tag is None else model(tag, value))
            except Exception:  # a failing model has no opinion
                out.append(None)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"tags": pd.Series, "values": pd.Series, "return": pd.Series}
    wanted = F.lit(True) if most is None else F.col("rank") <= most
    answer = F.pandas_udf(run, "string")(F.when(wanted, F.col("tag")), F.col("value"))
    return candidates.withColumn("_answer", answer).withColumn("confirmed", yes_or_no(F.col("_answer"))).drop("_answer")


def classified(finds: DataFrame, value_kind: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """Finds with ``value_kind``: a classifier of values given as a function of columns; null for values it does not know."""
    return finds.withColumn("value_kind", value_kind(F.col(value)))


def out_of_fold(documents: DataFrame, evaluate: Callable[[DataFrame, DataFrame], DataFrame], folds: int) -> DataFrame:
    """What ``evaluate(training documents, held out documents)`` gives for each ``fold``, with the fold."""
    parts = [evaluate(documents.filter(F.col("fold") != k), documents.filter(F.col("fold") == k)).withColumn("fold", F.lit(k)) for k in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_function(options: Options = Options()) -> UserDefinedTableFunction:
    """A table function of a text: its hits (tag, value, start_at, end_at, action)."""

    class Hits:
        def eval(self, text: str) -> Iterator[tuple]:
            for h in sorted(mask_text(text, options).hits, key=lambda h: (h.start, h.end, h.tag)) if text else ():
                yield h.tag, h.value, h.start, h.end, h.action

    return F.udtf(Hits, returnType="tag string, value string, start_at int, end_at int, action string")


def register(spark: SparkSession, name: str = "pii_hits", options: Options = Options()) -> None:
    """Make the table function known to SQL: ``SELECT * FROM docs, LATERAL pii_hits(text)``."""
    spark.udtf.register(name, table_function(options))
