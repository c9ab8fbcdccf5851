"""The event store: append-only logs and views of their latest state. One writer for each target."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from roadlake.contracts import TRANSITIONS
from roadlake.operators import joins, tracks
from roadlake.session import written


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at a path, or none of its rows where nothing was written yet."""
    jvm = spark._jvm  # noqa: SLF001
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):  # noqa: SLF001
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def new_only(batch: DataFrame, stored: DataFrame, key: str = "event_id") -> DataFrame:
    """A batch's rows whose key is not stored yet, one for each key: the one with the least timestamp."""
    order = ["timestamp"] if "timestamp" in batch.columns else [key]
    w = Window.partitionBy(key).orderBy(*order, F.xxhash64(*batch.columns))
    once = batch.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    return joins.without_match(once, stored, key)


def ingest_events(spark: SparkSession, batch: DataFrame, target: str, key: str = "event_id") -> None:
    """Appends the events that the target lacks; a replayed batch adds nothing."""
    new_only(batch, read_or_empty(spark, target, batch.schema), key).write.mode("append").parquet(target)


def _judged(df: DataFrame, log: str) -> DataFrame:
    """Judged rows, written beside their log before any of them goes into it."""
    return written(df, f"{log.rstrip('/')}-judged/{uuid.uuid4().hex}")


def judge_moves(changes: DataFrame, stored: DataFrame, kind: str = "review", order: list[str] = ("at", "state"), key: str = "event_id") -> DataFrame:
    """Status changes (key, state, at) with ``previous``, the state each meets, and whether it is ``legal``.

    The changes of a key are judged in order, each against the last legal one before it, be that stored or of the same
    batch. A key's first state must be one that no move leads to. A change without a key or state is illegal.
    """
    now = tracks.latest(stored, key, ["at", "state"]).select(key, F.col("state").alias("previous"))
    moves = set(TRANSITIONS[kind])
    first = {a for a, _ in moves} - {b for _, b in moves}
    schema = StructType([*changes.schema, StructField("previous", StringType()), StructField("legal", BooleanType())])
    columns = changes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for b in batches:  # a key's rows follow each other, also from batch to batch
            met, legal = [], []
            for k, state, stored_state, nth in zip(*(b.column(c).to_pylist() for c in (key, "state", "previous", "_nth")), strict=True):
                if nth == 1:
                    current = stored_state
                good = k is not None and (state in first if current is None else (current, state) in moves)
                met.append(current)
                legal.append(good)
                current = state if good else current
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(met, pa.string()), pa.array(legal, pa.bool_())], schema.names)

    # A window, since a repartition by the join's key goes as needless, and then adaptive execution deals a key's rows to many tasks.
    w = Window.partitionBy(key).orderBy(*order)
    return changes.join(now, key, "left").select(*columns, "previous").withColumn("_nth", F.row_number().over(w)).mapInArrow(run, schema)


def append_status(spark: SparkSession, log: str, changes: DataFrame, kind: str = "review", key: str = "event_id") -> DataFrame:
    """Appends legal status changes (key, state, at) to a log; the illegal ones are returned and not written.

    For reports, ``kind`` is report and ``key`` is report_id.
    """
    judged = _judged(judge_moves(changes, read_or_empty(spark, log, changes.schema), kind, key=key), log)
    judged.where("legal").select(*changes.columns).write.mode("append").parquet(log)
    return judged.where("not legal").drop("legal")


def current_status(log: DataFrame) -> DataFrame:
    return tracks.latest(log, "event_id", ["at", "state"])


def add_reports(spark: SparkSession, reports: DataFrame, events: DataFrame, target: str) -> DataFrame:
    """Appends reports of known events, one an event; the others are returned with a reason."""
    stored = read_or_empty(spark, target, reports.schema)
    w = Window.partitionBy("event_id").orderBy("submitted_at", "report_id")
    known = events.select("event_id").distinct().withColumn("_known", F.lit(True))
    taken = stored.select("event_id").distinct().withColumn("_taken", F.lit(True))
    judged = reports.withColumn("_nth", F.row_number().over(w)).join(known, "event_id", "left").join(taken, "event_id", "left")
    reason = F.when(F.col("_known").isNull(), "unknown_event").when(F.col("_taken").isNotNull() | (F.col("_nth") > 1), "second_report")
    judged = _judged(judged.withColumn("reason", reason).drop("_nth", "_known", "_taken"), target)
    judged.where("reason is null").select(*reports.columns).write.mode("append").parquet(target)
    return judged.where("reason is not null")
