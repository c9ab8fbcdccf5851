"""Joins of the domain. Sides are broadcast only where Spark's own size check picks that; no hint forces it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions import scalar


def with_camera(events: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each event with its one camera."""
    return events.join(cameras, events["source_id"] == cameras["camera_id"]).drop(cameras["camera_id"])


def with_report(events: DataFrame, reports: DataFrame) -> DataFrame:
    """Each event with its report, if any."""
    return events.join(reports.withColumnsRenamed({"status": "report_status"}), "event_id", "left")


def with_evidence(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each event with its evidence ids, in order; an empty list without any."""
    listed = evidence.groupBy("event_id").agg(F.sort_array(F.collect_list("evidence_id")).alias("evidence"))
    return events.join(listed, "event_id", "left").withColumn("evidence", F.coalesce("evidence", F.expr("cast(array() as " + dict(listed.dtypes)["evidence"] + ")")))


def with_model(events: DataFrame, models: DataFrame) -> DataFrame:
    return events.join(models, "model_version_id")


def without_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other side lacks: images without annotations, reports of unknown events, new events."""
    return left.join(right.select(key), key, "left_anti")


def with_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other side has."""
    return left.join(right.select(key), key, "left_semi")


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], row_id: str, tie: str) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time; null before the first.

    A union sorted once by time, and the last right row carried along: one shuffle on the key, no range join. At equal
    times right rows come first, and among them the one with the larger ``tie`` counts.
    """
    found = F.struct(*[F.col(v) for v in values])
    a = left.select(F.col(key), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.col(row_id).alias("_tie").cast("bigint"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(found.alias("v")).schema["v"].dataType).alias("_found"))
    b = right.select(F.col(key), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(tie).cast("bigint").alias("_tie"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), found.alias("_found"))
    w = Window.partitionBy(key).orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    line = a.unionByName(b).withColumn("_last", F.last("_found", ignorenulls=True).over(w))
    return line.where("_side = 1").select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def near_pairs(points: DataFrame, key: str, x: str, y: str, distance: int) -> DataFrame:
    """Pairs (a < b) of points within a distance, by cells of that size: each point meets its own and the 8 cells around it.

    A cell meets itself and four of the cells around it, so that two cells meet once. Sorted runs are merged: Spark's size
    check doesn't see that the copies for cells multiply the rows, and would broadcast them all through the driver.
    """
    cell = lambda c: F.floor(F.col(c) / distance).cast("bigint")
    own = points.select(F.col(key).alias("k"), F.col(x).alias("kx"), F.col(y).alias("ky"), cell(x).alias("cx"), cell(y).alias("cy"))
    around = [F.struct((cell(x) + dx).alias("cx"), (cell(y) + dy).alias("cy"), F.lit(dx == dy == 0).alias("same")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]
    other = points.select(F.col(key).alias("o"), F.col(x).alias("ox"), F.col(y).alias("oy"), F.explode(F.array(*around)).alias("_c")).select("o", "ox", "oy", "_c.cx", "_c.cy", "_c.same")
    square = (F.col("kx") - F.col("ox")) * (F.col("kx") - F.col("ox")) + (F.col("ky") - F.col("oy")) * (F.col("ky") - F.col("oy"))
    once = (F.col("k") < F.col("o")) | (~F.col("same") & (F.col("k") > F.col("o")))
    met = own.hint("merge").join(other, ["cx", "cy"]).where(once & (square <= distance * distance))
    return met.select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b"), square.alias("square"))


def sign_hash(vector: Column, bits: int = 64) -> Column:
    """A perceptual-hash stand-in: a bit for each of the first ``bits`` components, 1 where positive."""
    return F.aggregate(F.slice(vector, 1, bits), F.lit(0).cast("bigint"), lambda h, v: F.shiftleft(h, 1).bitwiseOR(F.when(v > 0, 1).otherwise(0).cast("bigint")))


def sign_words(vector: Column) -> Column:
    """``sign_hash`` of every component: an array with a word for each 64 of them."""
    last = F.greatest(F.ceil(F.size(vector) / 64).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda n: sign_hash(F.slice(vector, n * 64 + 1, 64)))


def near_hashes(rows: DataFrame, key: str, hash_: str, distance: int, bits: int = 64) -> DataFrame:
    """Pairs (a < b) whose hashes differ in at most ``distance`` bits: they agree in one of distance + 1 bands.

    A hash is a word of ``bits`` bits or an array of such words; a band takes the same bits of each word.
    Rows with one hash meet as one (their least key) and are listed as that pair's members through ``members_of``.
    """
    words = F.col(hash_) if dict(rows.dtypes)[hash_].startswith("array") else F.array(hash_)
    one = rows.where(F.col(hash_).isNotNull()).groupBy(words.alias("h")).agg(F.min(key).alias("k"))
    edges = [round(bits * n / (distance + 1)) for n in range(distance + 2)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    part = lambda m: F.transform("h", lambda w: w.bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m)))
    bands = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), part(m).alias("v")) for n, m in enumerate(masks)]))
    a = one.withColumn("_b", bands).select("h", "k", "_b.band", "_b.v")
    b = a.withColumnsRenamed({"h": "h2", "k": "k2"})
    differing = F.aggregate(F.zip_with("h", "h2", scalar.hamming), F.lit(0), lambda n, d: n + d)
    close = a.join(b, ["band", "v"]).where(F.col("k") < F.col("k2")).withColumn("bits", differing).where(F.col("bits") <= distance)
    return close.select(F.col("k").alias("a"), F.col("k2").alias("b"), "bits").distinct()


def members_of(rows: DataFrame, key: str, hash_: str) -> DataFrame:
    """(member, representative): each row's key and the least key with its hash. The larger side streams; its copies don't multiply."""
    one = rows.groupBy(hash_).agg(F.min(key).alias("representative"))
    return rows.join(one, hash_).select(F.col(key).alias("member"), "representative")


def provenance(events: DataFrame, tracked: DataFrame, models: DataFrame, experiments: DataFrame) -> DataFrame:
    """A row for each detection behind an event: event, track, detection, model version, experiment."""
    return events.join(tracked, ["source_id", "track_seq"]).join(models, "model_version_id").join(experiments, "experiment_id").select("event_id", "track_seq", "detection_id", "model_version_id", "experiment_id")
