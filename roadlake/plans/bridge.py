"""Domain tables made from the star-schema tables by integer arithmetic, in Spark and, alike, as SQL for the oracle.

They show that the operators run at scale; they say nothing about accuracy on road images. Line items are not unique by
(order, line), so boxes are numbered in a full order within their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 640, 480
GAP_SECONDS = 6 * 3600
#: Source labels and the project's classes.
CLASSES = {"click": "crack", "view": "crack", "purchase": "patch", "signup": "hole"}
_EVAL_SETS = ["validation", "test", "unseen", "cross_domain"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_detections(spark: SparkSession, sf: str) -> DataFrame:
    """A detector's output as it comes, some of it invalid."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.alias("detection_id"), F.when(e % 53 != 0, F.concat(F.lit("f"), e.cast("string"))).alias("frame_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("capture_timestamp"), F.col("event_type").alias("label"),
        ((e * 37 + F.col("user_id") * 11) % 1050 / 1000).alias("confidence"),
        (e * 31 % 620).cast("int").alias("x1"), (e * 17 % 460).cast("int").alias("y1"), (e * 31 % 620 + e % 97 - 2).cast("int").alias("x2"), (e * 17 % 460 + F.col("user_id") % 89 + 1).cast("int").alias("y2"),
    )


RAW_SQL = """raw AS (
  SELECT event_id AS detection_id, CASE WHEN event_id % 53 <> 0 THEN 'f' || event_id END AS frame_id, user_id AS source_id, ts AS capture_timestamp, event_type AS label,
    ((event_id * 37 + user_id * 11) % 1050) / 1000 AS confidence, event_id * 31 % 620 AS x1, event_id * 17 % 460 AS y1, event_id * 31 % 620 + event_id % 97 - 2 AS x2, event_id * 17 % 460 + user_id % 89 + 1 AS y2
  FROM events
), judged AS (
  SELECT *, CASE WHEN frame_id IS NULL OR trim(frame_id) = '' THEN 'missing_frame_id' WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'invalid_confidence'
    WHEN NOT (x1 >= 0 AND x1 < x2 AND x2 <= 640 AND y1 >= 0 AND y1 < y2 AND y2 <= 480) THEN 'invalid_bbox' END AS reason,
    CASE label WHEN 'click' THEN 'crack' WHEN 'view' THEN 'crack' WHEN 'purchase' THEN 'patch' WHEN 'signup' THEN 'hole' ELSE 'other' END AS class
  FROM raw
), detections AS (SELECT * EXCLUDE (reason) FROM judged WHERE reason IS NULL)"""

TRACKS_SQL = RAW_SQL + """, flagged AS (
  SELECT *, coalesce(epoch_us(capture_timestamp) - lag(epoch_us(capture_timestamp)) OVER (PARTITION BY source_id ORDER BY capture_timestamp, detection_id) > 21600000000, true) AS new FROM detections
), tracked AS (
  SELECT * EXCLUDE (new), (sum(new::INT) OVER (PARTITION BY source_id ORDER BY capture_timestamp, detection_id ROWS UNBOUNDED PRECEDING))::BIGINT AS track_seq FROM flagged
), tracks AS (
  SELECT source_id, track_seq, min(capture_timestamp) AS first_seen, max(capture_timestamp) AS last_seen, count(*) AS n_detections, avg(confidence) AS avg_confidence, max(confidence) AS max_confidence
  FROM tracked GROUP BY ALL
), promoted AS (
  SELECT *, source_id || '-' || track_seq AS event_id FROM tracks WHERE n_detections >= 3 AND max_confidence >= 0.8
), store AS (
  SELECT event_id, source_id, track_seq, last_seen AS timestamp, max_confidence AS confidence, ['candidate', 'confirmed', 'closed', 'rejected'][track_seq % 4 + 1] AS status, 'm' || (source_id % 4) AS model_version_id FROM promoted
), evidence AS (
  SELECT event_id || '-' || k AS evidence_id, CASE WHEN (source_id + k) % 11 <> 0 THEN event_id END AS event_id, CASE WHEN (source_id + track_seq + k) % 7 <> 0 THEN 's3://evidence/' || event_id END AS storage_path
  FROM store, range(3) t(k) WHERE (track_seq + k) % 3 <> 0
), reports AS (
  SELECT 'r' || event_id AS report_id, CASE WHEN track_seq % 10 = 7 THEN 'gone' || event_id ELSE event_id END AS event_id, 'u' || (source_id % 5) AS submitted_by, timestamp AS submitted_at,
    CASE WHEN track_seq % 3 = 0 THEN 'high' ELSE 'low' END AS priority FROM store WHERE track_seq % 2 = 1
), cameras AS (
  SELECT c_custkey AS camera_id, c_nationkey AS site, c_custkey % 7 <> 0 AS active FROM customer WHERE c_custkey % 29 <> 0
  UNION ALL SELECT c_custkey, c_nationkey, true FROM customer WHERE c_custkey % 31 = 1
), models AS (
  SELECT 'm' || n_nationkey AS model_version_id, 'x' || (n_nationkey % 3) AS experiment_id, n_nationkey % 2 = 0 AS is_active FROM nation WHERE n_nationkey < 4
)"""


def judged_detections(spark: SparkSession, sf: str) -> DataFrame:
    from roadlake.operators import validation as V

    raw = V.normalize_class(raw_detections(spark, sf), CLASSES, default="other")
    return raw.withColumn("reason", V.detection_reason(F.lit(WIDTH), F.lit(HEIGHT)))


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return judged_detections(spark, sf).where("reason is null").drop("reason")


def tracked(spark: SparkSession, sf: str) -> DataFrame:
    from roadlake.operators import tracks as T

    return T.gap_tracks(detections(spark, sf), GAP_SECONDS)


def event_store(spark: SparkSession, sf: str) -> DataFrame:
    from roadlake.operators import tracks as T

    promoted = T.promote(T.rollup(tracked(spark, sf), history=False))
    status = F.get(F.array(*map(F.lit, ("candidate", "confirmed", "closed", "rejected"))), (F.col("track_seq") % 4).cast("int"))
    return promoted.select("event_id", "source_id", "track_seq", F.col("last_seen").alias("timestamp"), F.col("max_confidence").alias("confidence"), status.alias("status"), F.concat(F.lit("m"), (F.col("source_id") % 4).cast("string")).alias("model_version_id"))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    each = event_store(spark, sf).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("(track_seq + k) % 3 != 0")
    return each.select(
        F.concat("event_id", F.lit("-"), F.col("k").cast("string")).alias("evidence_id"), F.when((F.col("source_id") + F.col("k")) % 11 != 0, F.col("event_id")).alias("event_id"),
        F.when((F.col("source_id") + F.col("track_seq") + F.col("k")) % 7 != 0, F.concat(F.lit("s3://evidence/"), "event_id")).alias("storage_path"),
    )


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return event_store(spark, sf).where("track_seq % 2 = 1").select(
        F.concat(F.lit("r"), "event_id").alias("report_id"), F.when(F.col("track_seq") % 10 == 7, F.concat(F.lit("gone"), "event_id")).otherwise(F.col("event_id")).alias("event_id"),
        F.concat(F.lit("u"), (F.col("source_id") % 5).cast("string")).alias("submitted_by"), F.col("timestamp").alias("submitted_at"), F.when(F.col("track_seq") % 3 == 0, "high").otherwise("low").alias("priority"),
    )


def cameras(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    key, site = F.col("c_custkey").alias("camera_id"), F.col("c_nationkey").alias("site")
    return c.where("c_custkey % 29 != 0").select(key, site, (F.col("c_custkey") % 7 != 0).alias("active")).union(c.where("c_custkey % 31 = 1").select(key, site, F.lit(True)))


def models(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").where("n_nationkey < 4").select(F.concat(F.lit("m"), n.cast("string")).alias("model_version_id"), F.concat(F.lit("x"), (n % 3).cast("string")).alias("experiment_id"), (n % 2 == 0).alias("is_active"))


def truths(spark: SparkSession, sf: str) -> DataFrame:
    """Ground-truth boxes: a frame for each order, about four boxes in each."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    numbered = table(spark, sf, "lineitem").withColumn("gt_id", F.col("l_orderkey") * 100 + F.row_number().over(w))
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    x1, y1 = p % 500, s * 7 % 400
    return numbered.select(
        F.col("l_orderkey").alias("frame_id"), "gt_id", F.col("l_returnflag").alias("class"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), (x1 + 20 + p % 60).cast("int").alias("x2"), (y1 + 20 + s % 50).cast("int").alias("y2"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth moved a little, some missing, some of another class, some twice."""
    g = F.col("gt_id")
    base = truths(spark, sf).where("gt_id % 10 != 0")
    each = base.withColumn("again", F.explode(F.when(g % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    dx, dy = g % 13 + F.col("again") * 3, g % 11
    return each.select(
        "frame_id", (g * 2 + F.col("again")).alias("pred_id"), F.when(g % 17 == 0, "N").otherwise(F.col("class")).alias("class"), ((g * 7 + F.col("again") * 400) % 1000 / 1000).alias("confidence"),
        (F.col("x1") + dx).cast("int").alias("x1"), (F.col("y1") + dy).cast("int").alias("y1"), (F.col("x2") + dx).cast("int").alias("x2"), (F.col("y2") + dy).cast("int").alias("y2"),
    )


BOXES_SQL = """truths AS (
  SELECT l_orderkey AS frame_id, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS gt_id, l_returnflag AS class,
    l_partkey % 500 AS x1, l_suppkey * 7 % 400 AS y1, l_partkey % 500 + 20 + l_partkey % 60 AS x2, l_suppkey * 7 % 400 + 20 + l_suppkey % 50 AS y2 FROM lineitem
), predictions AS (
  SELECT frame_id, gt_id * 2 + again AS pred_id, CASE WHEN gt_id % 17 = 0 THEN 'N' ELSE class END AS class, ((gt_id * 7 + again * 400) % 1000) / 1000 AS confidence,
    x1 + gt_id % 13 + again * 3 AS x1, y1 + gt_id % 11 AS y1, x2 + gt_id % 13 + again * 3 AS x2, y2 + gt_id % 11 AS y2
  FROM truths, range(2) t(again) WHERE gt_id % 10 <> 0 AND (again = 0 OR gt_id % 9 = 0)
)"""

MATCH_SQL = BOXES_SQL + """, pairs AS (
  SELECT p.frame_id, p.class, pred_id, confidence, gt_id,
    greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0) AS inter, (p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS both_
  FROM predictions p LEFT JOIN truths g ON p.frame_id = g.frame_id AND p.class = g.class
), best AS (
  SELECT *, both_ - inter AS uni FROM pairs QUALIFY row_number() OVER (PARTITION BY pred_id ORDER BY inter / nullif(both_ - inter, 0) DESC NULLS LAST, gt_id NULLS LAST) = 1
), hits AS (
  SELECT *, CASE WHEN gt_id IS NOT NULL AND inter * 100 >= threshold * uni THEN gt_id END AS hit FROM best, (SELECT unnest(range(50, 100, 5)) AS threshold)
), judged AS (
  SELECT *, (hit IS NOT NULL AND row_number() OVER (PARTITION BY threshold, frame_id, class, hit ORDER BY confidence DESC, pred_id) = 1)::INT AS tp FROM hits
), ranked AS (
  SELECT *, row_number() OVER w AS rank, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far FROM judged WINDOW w AS (PARTITION BY class, threshold ORDER BY confidence DESC, pred_id)
), hull AS (
  SELECT *, max(so_far / rank) OVER (PARTITION BY class, threshold ORDER BY confidence, pred_id DESC ROWS UNBOUNDED PRECEDING) AS envelope FROM ranked
), ap AS (
  SELECT class, threshold, n_truths, coalesce(sum(tp * envelope), 0) / n_truths AS ap
  FROM (SELECT class, count(*) AS n_truths FROM truths GROUP BY class) LEFT JOIN hull USING (class) GROUP BY class, threshold, n_truths
)"""


def eval_set(frame: str = "frame_id"):
    return F.get(F.array(*map(F.lit, _EVAL_SETS)), (F.col(frame) % 4).cast("int"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Images to split: orders, with leakage groups of which some are unknown."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    keys = {"video": F.when(o % 3 == 0, c), "trip": F.when(o % 5 == 0, c % 100), "location": F.when(o % 2 == 0, c % 25), "session": o % 1000, "sequence": o}
    return table(spark, sf, "orders").select(o.alias("image_id"), F.col("o_orderpriority").alias("class"), *[k.alias(n) for n, k in keys.items()])


SAMPLES_SQL = """samples AS (
  SELECT o_orderkey AS image_id, o_orderpriority AS class,
    CASE WHEN o_orderkey % 3 = 0 THEN 'video:' || o_custkey WHEN o_orderkey % 5 = 0 THEN 'trip:' || (o_custkey % 100) WHEN o_orderkey % 2 = 0 THEN 'location:' || (o_custkey % 25) ELSE 'session:' || (o_orderkey % 1000) END AS group_key
  FROM orders
), placed AS (
  SELECT *, ('0x' || substr(sha256(group_key), 1, 8))::BIGINT % 100 AS place FROM samples
), split AS (
  SELECT image_id, class, group_key, CASE WHEN place < 70 THEN 'train' WHEN place < 85 THEN 'val' ELSE 'test' END AS split FROM placed
)"""


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        F.concat(F.lit("x"), n.cast("string")).alias("experiment_id"), F.col("n_regionkey").alias("comparison"), n.alias("started_at"), F.concat(F.lit("d"), (n % 4).cast("string")).alias("dataset_version"), F.when(n % 7 != 0, F.lit("640")).alias("image_size"),
        (n * 37 % 100).alias("precision"), (n * 53 % 100).alias("recall"), (n * 71 % 100).alias("speed"),
    )


EXPERIMENTS_SQL = """experiments AS (
  SELECT 'x' || n_nationkey AS experiment_id, n_regionkey AS comparison, n_nationkey AS started_at, 'd' || (n_nationkey % 4) AS dataset_version, CASE WHEN n_nationkey % 7 <> 0 THEN '640' END AS image_size,
    n_nationkey * 37 % 100 AS precision, n_nationkey * 53 % 100 AS recall, n_nationkey * 71 % 100 AS speed FROM nation
)"""
