"""Projection, validation and filters. Rejected rows are returned with a reason, never dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions import boxes, scalar
from roadlake.functions.boxes import Box


def normalize_class(df: DataFrame, mapping: dict[str, str], label: str = "label", out: str = "class", default: str | None = None) -> DataFrame:
    """The project's class for a source's label, from a literal map; unknown labels get ``default``."""
    pairs = [F.lit(x) for k, v in mapping.items() for x in (k, v)]
    key = F.lower(F.trim(F.col(label)))
    found = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")
    return df.withColumn(out, F.coalesce(found, F.lit(default).cast("string")))


def yolo_to_xyxy(df: DataFrame, width: str = "image_width", height: str = "image_height") -> DataFrame:
    """Adds x1, y1, x2, y2 in pixels to rows with x_center, y_center, width and height in shares."""
    out = boxes.from_center(*(F.col(c) for c in ("x_center", "y_center", "width", "height")), F.col(width), F.col(height))
    return df.withColumns(dict(zip(("x1", "y1", "x2", "y2"), out, strict=True)))


def detection_reason(width: Column, height: Column, box: Box = Box(), confidence: str = "confidence", frame: str = "frame_id") -> Column:
    """Why a detection is rejected, or null: the first of frame, confidence and box that fails."""
    return (
        F.when(F.col(frame).isNull() | (F.trim(F.col(frame)) == ""), "missing_frame_id")
        .when(~scalar.valid_confidence(F.col(confidence)), "invalid_confidence")
        .when(~boxes.is_valid(width, height, box), "invalid_bbox")
    )


def split_valid(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rejects with one); together they are all rows."""
    judged = df.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def clamp_confidence(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """The other way to treat confidences out of range: the nearest bound."""
    return df.withColumn(confidence, scalar.clamp(F.col(confidence)))


def to_detection(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Only the contract's columns pass, under its types."""
    box = F.struct(*[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return df.select(
        F.col("detection_id").cast("string").alias("detection_id"), F.col("class").cast("string").alias("class"), F.col("confidence").cast("double").alias("confidence"),
        box.alias("bbox"), F.col("frame_id").cast("string").alias("frame_id"), F.col("capture_timestamp"), F.col("source_id"), *(extra or []),
    )


def with_resolution(df: DataFrame, width: int, height: int) -> DataFrame:
    return df.withColumns({"image_width": F.lit(width), "image_height": F.lit(height)})


def drop_stale(df: DataFrame, now: Column, max_age: str, ts: str = "capture_timestamp") -> tuple[DataFrame, DataFrame]:
    """(fresh, stale) frames; a frame exactly ``max_age`` old is fresh."""
    return split_valid(df, F.when(now - F.col(ts) > F.expr(f"interval {max_age}"), "stale"))


def is_negative(images: DataFrame, annotations: DataFrame, key: str = "image_id") -> DataFrame:
    """Images, with whether they have no annotation; they are kept."""
    known = annotations.select(key).distinct().withColumn("_some", F.lit(True))
    return images.join(known, key, "left").withColumn("negative", F.col("_some").isNull()).drop("_some")


def list_events(events: DataFrame, status: list[str] | None = None, source: list | None = None, since=None, until=None, least_confidence: float | None = None) -> DataFrame:
    """Events under any of the given filters."""
    if status:
        events = events.where(F.col("status").isin(status))
    if source:
        events = events.where(F.col("source_id").isin(source))
    if since is not None:
        events = events.where(F.col("timestamp") >= F.lit(since).cast(events.schema["timestamp"].dataType))
    if until is not None:
        events = events.where(F.col("timestamp") < F.lit(until).cast(events.schema["timestamp"].dataType))
    if least_confidence is not None:
        events = events.where(F.col("confidence") >= least_confidence)
    return events


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def public_view(events: DataFrame) -> DataFrame:
    """What an API serves: no scores of trackers, no storage paths, no model internals."""
    return events.select("event_id", "source_id", "timestamp", "confidence", "status")


def redact(df: DataFrame, hashed: list[str] = (), dropped: list[str] = ()) -> DataFrame:
    """Sensitive columns as checksums, or gone."""
    return df.withColumns({c: scalar.checksum(F.col(c)) for c in hashed}).drop(*dropped)


def purge(df: DataFrame, before: Column, ts: str = "capture_timestamp") -> DataFrame:
    """Rows that retention keeps."""
    return df.where(F.col(ts) >= before)


def vehicle_location(df: DataFrame, location: str = "location") -> DataFrame:
    """The vehicle's position as such; where the defect lies is not derived from it."""
    return df.withColumns({"vehicle_location": F.col(location), "estimated_location": F.lit(None).cast(df.schema[location].dataType)}).drop(location)


def flag_suspicious(df: DataFrame, width: str = "image_width", height: str = "image_height", **limits) -> DataFrame:
    return df.withColumn("suspicion", boxes.suspicious(F.col(width), F.col(height), **limits))


def exclude_corrupt(files: DataFrame, magic: dict[str, str], content: str = "content", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(good, rejected with a reason): empty files, and files whose first bytes (hex) don't fit their extension."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for kv in magic.items() for x in kv]), extension)
    starts = F.startswith(F.hex(content), F.upper(wanted))
    return split_valid(files, F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty").when(wanted.isNull(), "unknown_type").when(~starts, "corrupt"))
