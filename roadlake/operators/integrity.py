"""Checks of stored entities. Each returns the violating rows; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are null or held by several rows."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | F.col(key).isNull())


def several_reports(reports: DataFrame) -> DataFrame:
    return reports.groupBy("event_id").agg(F.count("*").alias("rows")).where("rows > 1")


def camera_count(events: DataFrame, cameras: DataFrame) -> DataFrame:
    """Events whose source is not exactly one camera, with how many there are."""
    known = cameras.groupBy("camera_id").agg(F.count("*").alias("cameras"))
    out = events.join(known, events["source_id"] == known["camera_id"], "left").withColumn("cameras", F.coalesce("cameras", F.lit(0)))
    return out.where("cameras != 1").select("event_id", "source_id", "cameras")


def active_models(models: DataFrame) -> DataFrame:
    """All active versions, if more than one is."""
    active = models.where("is_active")
    return active.join(F.broadcast(active.agg(F.count("*").alias("active"))), F.lit(True)).where("active > 1").select("model_version_id", "active")


def ownerless(evidence: DataFrame, owner: str = "event_id") -> DataFrame:
    return evidence.where(F.col(owner).isNull())


def changed_immutable(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose immutable columns differ between two versions, and in which."""
    o = old.select(key, *[F.col(c).alias("o_" + c) for c in columns])
    differ = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col("o_" + c)), c) for c in columns]), lambda c: c.isNotNull())
    return new.join(o, key).select(key, F.array_join(differ, ",").alias("changed")).where("changed != ''")


def hash_mismatch(artifacts: DataFrame, content: str, stated: str) -> DataFrame:
    return artifacts.where(~F.sha2(F.col(content).cast("string"), 256).eqNullSafe(F.lower(stated)))


def missing_fields(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Rows without a required field, with the names of those that are null."""
    gone = F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in required]), lambda c: c.isNotNull())
    return df.select(key, F.array_join(gone, ",").alias("missing")).where("missing != ''")


def mark_missing_evidence(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """All events, with whether their evidence is missing; storage failures are marked, not hidden."""
    known = evidence.where(F.col("storage_path").isNotNull()).select("event_id").distinct().withColumn("_some", F.lit(True))
    return events.join(known, "event_id", "left").withColumn("evidence_missing", F.col("_some").isNull()).drop("_some")
