"""Masking by a processor of the user's own, chunk by chunk, with retries and the built-in rules to fall back on."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import by_lines
from .fold import Options, mask_text

FAILED = "CHUNK_PROCESSOR_FAILED"
Processor = Callable[[str, Options], tuple[str, dict[str, int]]]


@dataclass
class Outcome:
    """A text's chunks, masked and put together; how many needed another try, failed for good, and fell back."""

    masked: str = ""
    counts: Counter[str] = field(default_factory=Counter)
    retried: int = 0
    failed: int = 0
    fallback: int = 0


def _tries(work: Processor, chunk: str, options: Options, retries: int) -> tuple[tuple[str, dict[str, int]] | None, int]:
    """What the processor gives, in the end, and how many tries that took."""
    for attempt in range(1, max(retries, 0) + 2):
        try:
            return work(chunk, options), attempt
        except Exception:  # a processor's failure is counted; its message may hold text and is not kept
            continue
    return None, attempt


def process(text: str, work: Processor, options: Options = Options(), size: int = 0, retries: int = 2, required: bool = False) -> Outcome:
    """``text`` by ``work``; a chunk that fails every time is masked by the rules, or is an error if ``required``."""
    out = Outcome()
    for chunk, _ in by_lines(text, size):
        result, attempts = _tries(work, chunk, options, retries)
        if result is None:
            out.failed += 1
            if required:
                raise RuntimeError(FAILED)
            tape = mask_text(chunk, options)
            result = tape.text, tape.counts
            out.fallback += 1
        else:
            out.retried += attempts > 1
        out.masked += result[0]
        out.counts.update(result[1])
    return out


_ADDED = T.StructType(
    [
        T.StructField("masked", T.StringType()),
        T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("retried_chunks", T.IntegerType()),
        T.StructField("failed_chunks", T.IntegerType()),
        T.StructField("fallback_chunks", T.IntegerType()),
    ]
)


def mask_with(docs: DataFrame, work: Processor, options: Options = Options(), size: int = 0, retries: int = 2, required: bool = False, text: str = "text") -> DataFrame:
    """The input's other columns with ``masked``, ``counts`` and the numbers of chunks retried, failed and masked by the rules.

    A null text is the empty text.  Columns of those names are replaced."""
    keep = [c for c in docs.columns if c not in (text, *_ADDED.names)]
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                done = [process(t, work, options, size, retries, required) for t in part.column(0).to_pylist()]
                columns = [pa.array([o.masked for o in done], pa.string()), pa.array([list(o.counts.items()) for o in done], pa.map_(pa.string(), pa.int64()))]
                columns += [pa.array([getattr(o, n) for o in done], pa.int32()) for n in ("retried", "failed", "fallback")]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], [*part.schema.names[1:], *_ADDED.names])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *_ADDED.fields]))
