"""Detections to tracks to events, in batch. Rows of one source stay together and in order; sources never mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions import scalar


def gap_tracks(detections: DataFrame, gap_seconds: int, source: str = "source_id", ts: str = "capture_timestamp", key: str = "detection_id") -> DataFrame:
    """Adds track_seq (from 1 in each source): a detection later than ``gap_seconds`` after the one before starts a track."""
    w = Window.partitionBy(source).orderBy(ts, key)
    late = scalar.micros(F.col(ts)) - F.lag(scalar.micros(F.col(ts))).over(w) > gap_seconds * 1_000_000
    return detections.withColumn("_new", F.coalesce(late, F.lit(True)).cast("int")).withColumn("track_seq", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def rollup(tracked: DataFrame, keys: list[str] = ("source_id", "track_seq"), ts: str = "capture_timestamp", key: str = "detection_id", history: bool = True) -> DataFrame:
    """A row for each track: first and last seen, number, confidences and, with ``history``, detections and boxes in time order."""
    aggs = [F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("n_detections"), F.avg("confidence").alias("avg_confidence"), F.max("confidence").alias("max_confidence")]
    if history:
        aggs.append(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(key).alias("id"), "x1", "y1", "x2", "y2"))).alias("bbox_history"))
    out = tracked.groupBy(*keys).agg(*aggs)
    return out.withColumn("detections", F.transform("bbox_history", lambda h: h["id"])) if history else out


def promote(tracks: DataFrame, least_detections: int = 3, least_confidence: float = 0.8) -> DataFrame:
    """Tracks that last and are sure enough become one event each. Both thresholds are this engine's own parameters."""
    kept = tracks.where((F.col("n_detections") >= least_detections) & (F.col("max_confidence") >= least_confidence))
    return kept.withColumn("event_id", F.concat_ws("-", F.col("source_id").cast("string"), F.col("track_seq").cast("string")))


def event_confidence(tracks: DataFrame, mode: str = "max") -> DataFrame:
    """An event's confidence: the peak, unless ``mode`` is avg."""
    return tracks.withColumn("confidence", F.col({"max": "max_confidence", "avg": "avg_confidence"}[mode]))


def track_status(tracks: DataFrame, now, expire_seconds: int, least_detections: int = 3) -> DataFrame:
    """active, confirmed, closed or expired, from length and silence."""
    silent = scalar.micros(F.lit(now).cast("timestamp")) - scalar.micros(F.col("last_seen")) > expire_seconds * 1_000_000
    long_ = F.col("n_detections") >= least_detections
    return tracks.withColumn("status", F.when(silent & long_, "closed").when(silent, "expired").when(long_, "confirmed").otherwise("active"))


def stability(tracked: DataFrame, keys: list[str] = ("source_id", "track_seq"), ts: str = "capture_timestamp", key: str = "detection_id") -> DataFrame:
    """Each detection's change of centre and confidence from the one before it in its track; null for the first."""
    w = Window.partitionBy(*keys).orderBy(ts, key)
    cx, cy = F.col("x1") + F.col("x2"), F.col("y1") + F.col("y2")
    return tracked.withColumns({"move_x2": F.abs(cx - F.lag(cx).over(w)), "move_y2": F.abs(cy - F.lag(cy).over(w)), "confidence_change": F.col("confidence") - F.lag("confidence").over(w)})


def newest(df: DataFrame, n: int, source: str = "source_id", ts: str = "capture_timestamp", key: str = "frame_id") -> DataFrame:
    """A bounded buffer: the newest n frames of each source; the oldest go first."""
    w = Window.partitionBy(source).orderBy(F.desc(ts), F.desc(key))
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def dropped(df: DataFrame, n: int, source: str = "source_id") -> DataFrame:
    """How many frames of each source the buffer dropped."""
    return df.groupBy(source).agg(F.count("*").alias("seen"), F.greatest(F.count("*") - n, F.lit(0)).alias("dropped"))


def sequence_gaps(df: DataFrame, source: str, index: str) -> DataFrame:
    """Gaps in frame indices: (source, after, missing). Frames are reported as lost, never invented."""
    w = Window.partitionBy(source).orderBy(index)
    step = F.lead(index).over(w) - F.col(index)
    return df.select(source, F.col(index).alias("after"), (step - 1).alias("missing")).where("missing > 0")


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def illegal_transitions(log: DataFrame, allowed: list[tuple[str, str]], key: str, order: list[str], state: str = "state") -> DataFrame:
    """Rows of a log whose state may not follow the one before; first states are free."""
    w = Window.partitionBy(key).orderBy(*order)
    moves = F.concat_ws(">", F.col("previous"), F.col(state))
    return log.withColumn("previous", F.lag(state).over(w)).where(F.col("previous").isNotNull() & ~moves.isin([f"{a}>{b}" for a, b in allowed]))
