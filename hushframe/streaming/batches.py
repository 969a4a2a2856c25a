"""Streams: masking new documents batch by batch, item status, windowed counts, run sessions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fold import Options, mask


def documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Documents as they arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def mask_stream(stream: DataFrame, out: str, checkpoint: str, options: Options = Options(), key: str = "doc_id") -> StreamingQuery:
    """Mask each micro-batch and write it under its batch number, so a batch that is run again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        mask(batch.dropDuplicates([key]), options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_retries(items: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, tries: int = 2) -> DataFrame:
    """Item status (path, status, attempts) after working on items (path) up to ``tries`` times more than once.

    ``work`` gives (path, ok); items that are not ok are tried again, in the next round only.  Each round is written below
    ``folder``, which all executors share, and read back: work is done once a round, and an item has one outcome."""
    spark, left, rounds = items.sparkSession, items.select("path").dropDuplicates(["path"]), []
    for attempt in range(1, tries + 2):
        result = work(left).select("path", F.when(F.coalesce("ok", F.lit(False)), "done").otherwise("failed").alias("status"), F.lit(attempt).alias("attempts"))
        result.write.mode("errorifexists").parquet(f"{folder}/round-{attempt}")
        rounds.append(spark.read.schema(result.schema).parquet(f"{folder}/round-{attempt}"))
        left = rounds[-1].filter("status = 'failed'").select("path")
        if left.isEmpty():
            break
    out = rounds[-1]
    for earlier in rounds[:-1]:
        out = out.unionByName(earlier.filter("status = 'done'"))
    return out


def summary(status: DataFrame) -> DataFrame:
    """total, pending, done, failed."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.agg(F.count(F.lit(1)).alias("total"), n("pending"), n("done"), n("failed"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of a key per tumbling window; on a stream, windows close when the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), key, "n"
    )


#: Allowed transitions of a run session.
MOVES = {
    ("new", "create"): "ready",
    ("ready", "finalize"): "finalizing",
    ("finalizing", "complete"): "completed",
    ("finalizing", "retry"): "ready",
    ("finalizing", "fail_cleanup"): "cleanup_required",
    ("cleanup_required", "cleanup"): "completed",
}
SESSION = "run_id string, seq long, event string, state string, accepted boolean, reason string"


def _step(state: str, revision: int, event: str, given: int | None) -> tuple[str, int, bool, str]:
    if state == "completed":
        return state, revision, False, "replayed"
    if event == "revise":
        if state != "ready" or given is None or given != revision + 1:
            return state, revision, False, "stale_revision"
        return state, given, True, ""
    after = MOVES.get((state, event))
    if after is None:
        return state, revision, False, "illegal_transition"
    if given is not None and event == "finalize" and given != revision:
        return state, revision, False, "stale_revision"
    return after, (1 if event == "create" else revision), True, ""


def session_states(events: DataFrame) -> DataFrame:
    """What each event (run_id, seq, event, revision) did to its run; replays of finished runs are refused."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, revision, out = "new", 0, []
        for r in rows.sort_values("seq").itertuples():
            given = None if pd.isna(r.revision) else int(r.revision)
            state, revision, ok, why = _step(state, revision, r.event, given)
            out.append((r.run_id, r.seq, r.event, state, ok, why))
        return pd.DataFrame(out, columns=["run_id", "seq", "event", "state", "accepted", "reason"])

    return events.groupBy("run_id").applyInPandas(run, SESSION)


def session_stream(events: DataFrame) -> DataFrame:
    """The same as a stream: state and revision per run are kept by ``applyInPandasWithState``."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches, held: GroupState):
        state, revision = held.get if held.exists else ("new", 0)
        for rows in batches:
            out = []
            for r in rows.sort_values("seq").itertuples():
                given = None if pd.isna(r.revision) else int(r.revision)
                state, revision, ok, why = _step(state, revision, r.event, given)
                out.append((key[0], r.seq, r.event, state, ok, why))
            yield pd.DataFrame(out, columns=["run_id", "seq", "event", "state", "accepted", "reason"])
        held.update((state, revision))

    return events.groupBy("run_id").applyInPandasWithState(run, SESSION, "state string, revision long", "append", GroupStateTimeout.NoTimeout)
