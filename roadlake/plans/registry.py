"""The registered queries of the road-defect engine, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.contracts import EXPERIMENT_FIELDS, TRANSITIONS
from roadlake.functions import boxes, scalar
from roadlake.operators import boxes_ops, datasets, integrity, joins, metrics, store, tracks
from roadlake.operators import validation as V
from roadlake.plans import bridge as B
from roadlake.session import shared_folder as _folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Detections: validation and filters


@query(_with(B.RAW_SQL, "SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason"))
def detection_rejects(spark, sf):
    """Rejects with their reasons, counted."""
    _, bad = V.split_valid(B.judged_detections(spark, sf).drop("reason"), V.detection_reason(F.lit(B.WIDTH), F.lit(B.HEIGHT)))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query(_with(B.RAW_SQL, "SELECT detection_id::VARCHAR AS detection_id, class, confidence, x1, y1, x2, y2, frame_id, capture_timestamp, source_id FROM detections"))
def contract_detections(spark, sf):
    """Valid detections under the contract, the box unpacked for comparison."""
    return V.to_detection(B.detections(spark, sf)).select("detection_id", "class", "confidence", "bbox.*", "frame_id", "capture_timestamp", "source_id")


@query(_with(B.RAW_SQL, "SELECT class, label, count(*) AS n FROM judged GROUP BY ALL"))
def normalized_classes(spark, sf):
    """Source labels mapped to the project's classes."""
    return V.normalize_class(B.raw_detections(spark, sf), B.CLASSES, default="other").groupBy("class", "label").agg(F.count("*").alias("n"))


@query(_with(B.RAW_SQL, "SELECT detection_id, CASE WHEN confidence > 1 THEN 1.0 WHEN confidence < 0 THEN 0.0 ELSE confidence END AS confidence FROM raw"))
def clamped_confidence(spark, sf):
    """P5, the other mode: out-of-range confidences moved to the bound."""
    return V.clamp_confidence(B.raw_detections(spark, sf)).select("detection_id", "confidence")


@query(
    "SELECT p_partkey AS image_id, floor((xc - w / 2) * 640 + 0.5)::INT AS x1, floor((yc - h / 2) * 480 + 0.5)::INT AS y1, floor((xc + w / 2) * 640 + 0.5)::INT AS x2, floor((yc + h / 2) * 480 + 0.5)::INT AS y2 "
    "FROM (SELECT p_partkey, (p_partkey * 13 % 64) / 64 AS xc, (p_partkey * 7 % 32) / 32 AS yc, (p_size % 16) / 32 AS w, (p_size % 8) / 16 AS h FROM part)"
)
def yolo_boxes(spark, sf):
    """Centre-and-size annotations as pixel boxes, with the resolution recorded."""
    k, s = F.col("p_partkey"), F.col("p_size")
    lines = B.table(spark, sf, "part").select(k.alias("image_id"), (k * 13 % 64 / 64).alias("x_center"), (k * 7 % 32 / 32).alias("y_center"), (s % 16 / 32).alias("width"), (s % 8 / 16).alias("height"))
    return V.yolo_to_xyxy(V.with_resolution(lines, B.WIDTH, B.HEIGHT)).select("image_id", "x1", "y1", "x2", "y2")


@query(
    _with(
        B.RAW_SQL,
        "SELECT CASE WHEN (x2 - x1) * (y2 - y1) / (640 * 480) < 0.0001 THEN 'tiny' WHEN (x2 - x1) * (y2 - y1) / (640 * 480) > 0.02 THEN 'huge' WHEN greatest(x2 - x1, y2 - y1) > least(x2 - x1, y2 - y1) * 10.0 THEN 'aspect' END AS suspicion, count(*) AS n, sum((x2 - x1) * (y2 - y1))::BIGINT AS area FROM detections GROUP BY ALL",
    )
)
def suspicious_boxes(spark, sf):
    """Boxes of extreme size or shape, with the areas."""
    flagged = V.flag_suspicious(V.with_resolution(B.detections(spark, sf), B.WIDTH, B.HEIGHT), most=0.02)
    return flagged.groupBy("suspicion").agg(F.count("*").alias("n"), F.sum(boxes.area()).cast("bigint").alias("area"))


@query(
    _with(
        B.BOXES_SQL,
        "SELECT CASE WHEN a <= p33 THEN 'small' WHEN a <= p67 THEN 'medium' ELSE 'large' END AS size, count(*) AS n, min(a) AS least, max(a) AS most FROM (SELECT (x2 - x1) * (y2 - y1) AS a FROM truths), (SELECT quantile_cont((x2 - x1) * (y2 - y1), 0.33) AS p33, quantile_cont((x2 - x1) * (y2 - y1), 0.67) AS p67 FROM truths) GROUP BY ALL",
    )
)
def size_categories(spark, sf):
    """Size classes by cuts from the areas' exact percentiles."""
    truth = B.truths(spark, sf).select(boxes.area().cast("bigint").alias("a"))
    cuts = datasets.area_percentiles(truth, F.col("a"), [0.33, 0.67])
    sized = truth.crossJoin(F.broadcast(cuts)).withColumn("size", boxes.size_category(F.col("a"), F.col("p33"), F.col("p67")))
    return sized.groupBy("size").agg(F.count("*").alias("n"), F.min("a").alias("least"), F.max("a").alias("most"))


@query(_with(B.RAW_SQL, "SELECT source_id, count(*) AS stale FROM detections WHERE TIMESTAMP '2024-01-31 00:00:00' - capture_timestamp > INTERVAL 10 DAY GROUP BY source_id"))
def stale_frames(spark, sf):
    """Frames older than ten days, by source."""
    _, stale = V.drop_stale(B.detections(spark, sf), F.expr("timestamp_ntz'2024-01-31 00:00:00'"), "10 days")
    return stale.groupBy("source_id").agg(F.count("*").alias("stale"))


@query(_with(B.RAW_SQL, "SELECT source_id, count(*) AS kept FROM detections WHERE capture_timestamp >= TIMESTAMP '2024-01-15' GROUP BY ALL"))
def retained_detections(spark, sf):
    """What retention keeps."""
    return V.purge(B.detections(spark, sf), F.expr("timestamp_ntz'2024-01-15 00:00:00'")).groupBy("source_id").agg(F.count("*").alias("kept"))


@query(_with(B.TRACKS_SQL, "SELECT event_id, sha256(source_id::VARCHAR) AS source_id, confidence, status FROM store"))
def redacted_events(spark, sf):
    """P20: sources as checksums, times and models left out."""
    return V.redact(B.event_store(spark, sf), hashed=["source_id"], dropped=["timestamp", "model_version_id", "track_seq"])


@query("SELECT c_custkey AS camera_id, c_nationkey / 10 AS vehicle_lat, c_custkey / 100 AS vehicle_lng, NULL::DOUBLE AS estimated_lat FROM customer")
def vehicle_locations(spark, sf):
    """A vehicle's position passes through; no defect position is derived."""
    located = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("camera_id"), F.struct((F.col("c_nationkey") / 10).alias("lat"), (F.col("c_custkey") / 100).alias("lng")).alias("location"))
    out = V.vehicle_location(located)
    return out.select("camera_id", F.col("vehicle_location.lat").alias("vehicle_lat"), F.col("vehicle_location.lng").alias("vehicle_lng"), F.col("estimated_location.lat").alias("estimated_lat"))


@query(
    "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'empty' WHEN o_orderkey % 5 = 1 THEN 'unknown_type' WHEN o_orderkey % 5 = 2 THEN 'corrupt' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 5 < 3 GROUP BY ALL"
)
def corrupt_files(spark, sf):
    """Files that are empty, of an unknown type, or not what their name says."""
    k = F.col("o_orderkey") % 5
    files = B.table(spark, sf, "orders").select(F.concat(F.lit("/d/"), "o_orderkey", F.when(k == 1, ".bin").otherwise(".jpg")).alias("path"), F.when(k == 0, F.lit("")).when(k == 2, F.lit("89504E47")).otherwise("FFD8FF00").alias("h")).select("path", F.unhex("h").alias("content"))
    _, bad = V.exclude_corrupt(files, {"jpg": "FFD8FF", "png": "89504E47"})
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT event_id, ts - INTERVAL 2 HOUR AS utc FROM events")
def utc_timestamps(spark, sf):
    """Local times of a fixed offset as UTC."""
    return B.table(spark, sf, "events").select("event_id", scalar.to_utc(F.col("ts").cast("timestamp"), F.lit("+02:00")).cast("timestamp_ntz").alias("utc"))


# Tracks and events


@query(_with(B.TRACKS_SQL, "SELECT source_id, track_seq, first_seen, last_seen, n_detections, round(avg_confidence, 9) AS avg_confidence, max_confidence FROM tracks"))
def gap_tracks(spark, sf):
    """Tracks by time gap, rolled up."""
    return tracks.rollup(B.tracked(spark, sf), history=False).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(_with(B.TRACKS_SQL, "SELECT source_id, track_seq, string_agg(detection_id || ':' || x1 || ':' || y2, ',' ORDER BY capture_timestamp, detection_id) AS history FROM tracked GROUP BY ALL"))
def track_histories(spark, sf):
    """A1, A3: each track's detections and boxes in time order."""
    rolled = tracks.rollup(B.tracked(spark, sf))
    each = F.transform("bbox_history", lambda h: F.concat_ws(":", h["id"].cast("string"), h["x1"].cast("string"), h["y2"].cast("string")))
    return rolled.select("source_id", "track_seq", F.array_join(each, ",").alias("history"))


@query(_with(B.TRACKS_SQL, "SELECT event_id, source_id, track_seq, first_seen, last_seen, n_detections, max_confidence AS confidence FROM promoted"))
def promoted_events(spark, sf):
    """One event for each track that lasts and is sure enough."""
    return tracks.event_confidence(tracks.promote(tracks.rollup(B.tracked(spark, sf), history=False))).select("event_id", "source_id", "track_seq", "first_seen", "last_seen", "n_detections", "confidence")


@query(
    _with(
        B.TRACKS_SQL,
        "SELECT CASE WHEN silent AND n_detections >= 3 THEN 'closed' WHEN silent THEN 'expired' WHEN n_detections >= 3 THEN 'confirmed' ELSE 'active' END AS status, count(*) AS n FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(last_seen) > 86400000000 AS silent FROM tracks) GROUP BY ALL",
    )
)
def track_statuses(spark, sf):
    """Tracks that expired, closed, or go on."""
    rolled = tracks.rollup(B.tracked(spark, sf), history=False)
    return tracks.track_status(rolled, F.expr("timestamp'2024-01-30 00:00:00'"), 86400).groupBy("status").agg(F.count("*").alias("n"))


@query(
    _with(
        B.TRACKS_SQL,
        "SELECT detection_id, abs(x1 + x2 - lag(x1 + x2) OVER w) AS move_x2, abs(y1 + y2 - lag(y1 + y2) OVER w) AS move_y2, round(confidence - lag(confidence) OVER w, 9) AS confidence_change FROM tracked WINDOW w AS (PARTITION BY source_id, track_seq ORDER BY capture_timestamp, detection_id)",
    )
)
def track_stability(spark, sf):
    """How boxes and confidences move from one detection of a track to the next."""
    return tracks.stability(B.tracked(spark, sf)).select("detection_id", "move_x2", "move_y2", F.round("confidence_change", 9).alias("confidence_change"))


@query(_with(B.RAW_SQL, "SELECT source_id, frame_id, capture_timestamp FROM detections QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY capture_timestamp DESC, frame_id DESC) <= 5"))
def bounded_buffer(spark, sf):
    """The newest five frames of each source."""
    return tracks.newest(B.detections(spark, sf), 5).select("source_id", "frame_id", "capture_timestamp")


@query(_with(B.RAW_SQL, "SELECT source_id, count(*) AS seen, greatest(count(*) - 5, 0) AS dropped FROM detections GROUP BY ALL"))
def dropped_frames(spark, sf):
    """Frames that the bounded buffer dropped."""
    return tracks.dropped(B.detections(spark, sf), 5)


@query("SELECT l_partkey, after, missing FROM (SELECT l_partkey, l_orderkey AS after, lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey) - l_orderkey - 1 AS missing FROM lineitem) WHERE missing > 0")
def sequence_gaps(spark, sf):
    """Indices that a source's frames skip."""
    return tracks.sequence_gaps(B.table(spark, sf, "lineitem"), "l_partkey", "l_orderkey")


@query(_with(B.RAW_SQL, "SELECT detection_id, capture_timestamp FROM detections ORDER BY capture_timestamp DESC, detection_id DESC LIMIT 100"))
def newest_detections(spark, sf):
    """O1, O3: the newest hundred, a page of a listing."""
    return datasets.newest_rows(B.detections(spark, sf), 100, [F.desc("capture_timestamp"), F.desc("detection_id")]).select("detection_id", "capture_timestamp")


@query(
    _with(
        B.TRACKS_SQL,
        "SELECT strftime(date_trunc('day', timestamp), '%Y-%m-%d') AS day, source_id // 10 AS area, count(*) AS events, count(DISTINCT source_id) AS sources, max(confidence) AS confidence FROM store GROUP BY ALL",
    )
)
def spacetime_events(spark, sf):
    """Events gathered by day and area."""
    day, area = F.date_format("timestamp", "yyyy-MM-dd").alias("day"), F.expr("source_id div 10").alias("area")
    return B.event_store(spark, sf).groupBy(day, area).agg(F.count("*").alias("events"), F.countDistinct("source_id").alias("sources"), F.max("confidence").alias("confidence"))


# The event store


@query(_with(B.TRACKS_SQL, "SELECT event_id, source_id, timestamp, confidence, status FROM store WHERE status IN ('confirmed', 'closed') AND confidence >= 0.9 AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-20'"))
def listed_events(spark, sf):
    """A filtered listing, as served."""
    return V.public_view(V.list_events(B.event_store(spark, sf), status=["confirmed", "closed"], since="2024-01-10 00:00:00", until="2024-01-20 00:00:00", least_confidence=0.9))


@query(_with(B.TRACKS_SQL, "SELECT event_id, source_id, timestamp, confidence, status FROM store WHERE event_id = (SELECT min(event_id) FROM store)"))
def event_by_id(spark, sf):
    """One event, that with the least id, so that there is one in tables of any size."""
    events = B.event_store(spark, sf)
    return V.public_view(V.by_key(events, "event_id", events.agg(F.min("event_id")).first()[0]))


@query(_with(B.TRACKS_SQL, "SELECT event_id, site, active FROM store JOIN cameras ON source_id = camera_id"))
def camera_events(spark, sf):
    """Events with their cameras."""
    return joins.with_camera(B.event_store(spark, sf), B.cameras(spark, sf)).select("event_id", "site", "active")


@query(_with(B.TRACKS_SQL, "SELECT event_id, report_id, priority FROM store LEFT JOIN reports USING (event_id)"))
def reported_events(spark, sf):
    """Events with their reports, if any."""
    return joins.with_report(B.event_store(spark, sf), B.reports(spark, sf)).select("event_id", "report_id", "priority")


@query(_with(B.TRACKS_SQL, "SELECT store.event_id, coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id), '') AS evidence FROM store LEFT JOIN evidence USING (event_id) GROUP BY ALL"))
def event_evidence(spark, sf):
    """Events with their evidence, nested."""
    return joins.with_evidence(B.event_store(spark, sf), B.evidence(spark, sf)).select("event_id", F.array_join("evidence", ",").alias("evidence"))


@query(_with(B.TRACKS_SQL, "SELECT model_version_id, is_active, count(*) AS events FROM store JOIN models USING (model_version_id) GROUP BY ALL"))
def model_events(spark, sf):
    """Events by the model version behind them."""
    return joins.with_model(B.event_store(spark, sf), B.models(spark, sf)).groupBy("model_version_id", "is_active").agg(F.count("*").alias("events"))


@query("SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def images_without_annotations(spark, sf):
    """Images without a box."""
    images = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    return joins.without_match(images, B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id")), "image_id")


@query("SELECT negative, count(*) AS n FROM (SELECT o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AS negative FROM orders) GROUP BY ALL")
def negative_images(spark, sf):
    """Negatives are kept, and known as such."""
    images = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    return V.is_negative(images, B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"))).groupBy("negative").agg(F.count("*").alias("n"))


@query(_with(B.TRACKS_SQL, "SELECT report_id FROM reports WHERE event_id NOT IN (SELECT event_id FROM store)"))
def orphan_reports(spark, sf):
    """Reports of events that don't exist."""
    return joins.without_match(B.reports(spark, sf), B.event_store(spark, sf), "event_id").select("report_id")


@query(_with(B.TRACKS_SQL, "SELECT evidence_id FROM evidence WHERE event_id IN (SELECT event_id FROM store)"))
def evidence_of_events(spark, sf):
    """Evidence of events that exist."""
    return joins.with_match(B.evidence(spark, sf), B.event_store(spark, sf), "event_id").select("evidence_id")


@query(_with(B.TRACKS_SQL, "SELECT event_id FROM store WHERE track_seq % 3 <> 0"))
def new_events(spark, sf):
    """Of a batch that holds every event twice, those not stored yet."""
    events = B.event_store(spark, sf)
    return store.new_only(events.union(events), events.where("track_seq % 3 = 0")).select("event_id")


@query(_with(B.TRACKS_SQL, "SELECT event_id, track_seq, detection_id, model_version_id, experiment_id FROM store JOIN tracked USING (source_id, track_seq) JOIN models USING (model_version_id) WHERE experiment_id IN (SELECT 'x' || n_nationkey FROM nation)"))
def event_provenance(spark, sf):
    """From an event to its detections, model version and experiment."""
    events = B.event_store(spark, sf)
    return joins.provenance(events, B.tracked(spark, sf).select("source_id", "track_seq", "detection_id"), B.models(spark, sf), B.experiments(spark, sf).select("experiment_id"))


@query(
    _with(
        B.TRACKS_SQL,
        "SELECT event_id, state FROM (SELECT event_id, ['candidate', 'confirmed', 'closed'][k + 1] AS state, k FROM store, range(3) t(k) WHERE k <= track_seq % 3) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY k DESC) = 1",
    )
)
def latest_states(spark, sf):
    """The newest state of each event's log."""
    return tracks.latest(_log(spark, sf).where("not extra"), "event_id", ["k"]).select("event_id", "state")


def _log(spark, sf):
    """A transition log: legal steps, and for some events one step that is not."""
    states = F.array(*map(F.lit, ("candidate", "confirmed", "closed", "candidate")))
    log = B.event_store(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    log = log.withColumn("extra", (F.col("k") == 3))
    return log.where("(not extra and k <= track_seq % 3) or (extra and track_seq % 5 = 0)").select("event_id", "k", "extra", F.get(states, F.col("k")).alias("state"))


@query(
    _with(
        B.TRACKS_SQL,
        "SELECT event_id, previous, state FROM (SELECT event_id, state, lag(state) OVER (PARTITION BY event_id ORDER BY k) AS previous FROM (SELECT event_id, k, ['candidate', 'confirmed', 'closed', 'candidate'][k + 1] AS state FROM store, range(4) t(k) WHERE (k < 3 AND k <= track_seq % 3) OR (k = 3 AND track_seq % 5 = 0))) WHERE previous IS NOT NULL AND previous || '>' || state NOT IN ('candidate>confirmed', 'confirmed>closed', 'candidate>rejected')",
    )
)
def illegal_transitions(spark, sf):
    """States that may not follow the ones before them."""
    return tracks.illegal_transitions(_log(spark, sf), TRANSITIONS["event"], "event_id", ["k"]).select("event_id", "previous", "state")


@query(
    _with(
        B.TRACKS_SQL,
        "SELECT 'camera' AS entity, camera_id::VARCHAR AS key, count(*) AS rows FROM cameras GROUP BY camera_id HAVING count(*) > 1 UNION ALL SELECT 'event', event_id, count(*) FROM store GROUP BY event_id HAVING count(*) > 1 OR event_id IS NULL UNION ALL SELECT 'report', report_id, count(*) FROM reports GROUP BY report_id HAVING count(*) > 1 UNION ALL SELECT 'evidence', evidence_id, count(*) FROM evidence GROUP BY evidence_id HAVING count(*) > 1 UNION ALL SELECT 'model', model_version_id, count(*) FROM models GROUP BY model_version_id HAVING count(*) > 1",
    )
)
def key_violations(spark, sf):
    """G1: keys that are not unique, of five entities."""
    entities = {"camera": (B.cameras, "camera_id"), "event": (B.event_store, "event_id"), "report": (B.reports, "report_id"), "evidence": (B.evidence, "evidence_id"), "model": (B.models, "model_version_id")}
    parts = [integrity.duplicate_keys(f(spark, sf), key).select(F.lit(name).alias("entity"), F.col(key).cast("string").alias("key"), "rows") for name, (f, key) in entities.items()]
    return datasets.combine(*parts)


@query(_with(B.TRACKS_SQL, "SELECT event_id, count(*) AS rows FROM (SELECT event_id FROM reports UNION ALL SELECT event_id FROM reports WHERE priority = 'high') GROUP BY event_id HAVING count(*) > 1"))
def several_reports(spark, sf):
    """Events with more than one report."""
    reports = B.reports(spark, sf)
    return integrity.several_reports(reports.union(reports.where("priority = 'high'")))


@query(_with(B.TRACKS_SQL, "SELECT event_id, source_id, n AS cameras FROM (SELECT event_id, source_id, (SELECT count(*) FROM cameras WHERE camera_id = source_id) AS n FROM store) WHERE n <> 1"))
def camera_violations(spark, sf):
    """Events without exactly one camera."""
    return integrity.camera_count(B.event_store(spark, sf), B.cameras(spark, sf))


@query(_with(B.TRACKS_SQL, "SELECT model_version_id, (SELECT count(*) FROM models WHERE is_active) AS active FROM models WHERE is_active AND (SELECT count(*) FROM models WHERE is_active) > 1"))
def active_models(spark, sf):
    """More than one active model version."""
    return integrity.active_models(B.models(spark, sf))


@query(_with(B.TRACKS_SQL, "SELECT evidence_id FROM evidence WHERE event_id IS NULL"))
def ownerless_evidence(spark, sf):
    """Evidence without an owner."""
    return integrity.ownerless(B.evidence(spark, sf)).select("evidence_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 AND c_custkey % 15 = 0 THEN 'c_name,c_nationkey' WHEN c_custkey % 10 = 0 THEN 'c_name' ELSE 'c_nationkey' END AS changed FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 15 = 0")
def immutable_changes(spark, sf):
    """Immutable columns that changed between two versions."""
    old = B.table(spark, sf, "customer")
    new = old.withColumns({"c_name": F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_name")), "c_nationkey": F.col("c_nationkey") + F.when(F.col("c_custkey") % 15 == 0, 1).otherwise(0)})
    return integrity.changed_immutable(old, new, "c_custkey", ["c_name", "c_nationkey"])


@query("SELECT p_partkey FROM part WHERE p_partkey % 9 = 0")
def artifact_mismatches(spark, sf):
    """Artifacts whose content differs from the stated hash."""
    stated = F.when(F.col("p_partkey") % 9 == 0, F.lit("00")).otherwise(F.upper(F.sha2("p_name", 256)))
    return integrity.hash_mismatch(B.table(spark, sf, "part").withColumn("stated", stated), "p_name", "stated").select("p_partkey")


@query(
    _with(
        B.SAMPLES_SQL,
        "SELECT 'valid_boxes' AS criterion, 0::BIGINT AS violations, true AS accepted UNION ALL SELECT 'no_leakage', 0, true UNION ALL SELECT 'no_duplicates', n, n = 0 FROM (SELECT count(*) AS n FROM (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'grouped', n, n = 0 FROM (SELECT count(*) AS n FROM samples WHERE group_key IS NULL) UNION ALL SELECT 'checksums', 0, true",
    )
)
def dataset_acceptance(spark, sf):
    """The computable acceptance criteria, each with its violations."""
    truth, grouped = B.truths(spark, sf), _samples(spark, sf)
    placed = grouped.withColumn("split", datasets.split_of(F.col("group_key")))
    docs = B.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return datasets.acceptance(
        {
            "valid_boxes": truth.where(~boxes.is_valid(F.lit(B.WIDTH), F.lit(B.HEIGHT))),
            "no_leakage": datasets.leakage(placed),
            "no_duplicates": datasets.duplicate_groups(docs, "checksum", "doc_id"),
            "grouped": grouped.where("group_key is null"),
            "checksums": docs.where("checksum is null"),
        }
    )


_OTHER_FIELDS = [c for c in EXPERIMENT_FIELDS if c not in ("experiment_id", "dataset_version", "image_size")]
_LACKING = ", ".join(f"CASE WHEN {'image_size IS NULL' if c == 'image_size' else f'started_at % {_OTHER_FIELDS.index(c) + 3} = 1' if c in _OTHER_FIELDS else f'{c} IS NULL'} THEN '{c}' END" for c in EXPERIMENT_FIELDS)


@query(_with(B.EXPERIMENTS_SQL, f"SELECT * FROM (SELECT experiment_id, array_to_string(list_filter([{_LACKING}], lambda c: c IS NOT NULL), ',') AS missing FROM experiments) WHERE missing <> ''"))
def missing_fields(spark, sf):
    """Experiments that can't be reproduced, and which of the 17 fields they lack."""
    full = B.experiments(spark, sf).withColumns({c: F.when(F.col("started_at") % (n + 3) != 1, F.lit("x")) for n, c in enumerate(_OTHER_FIELDS)})
    return integrity.missing_fields(full, "experiment_id", EXPERIMENT_FIELDS)


_STATES = ["created", "pending", "approved", "rejected", "resolved", "closed"]
_LEGAL = "coalesce(CASE WHEN {0} IS NULL THEN {1} = 'created' ELSE {0} || '>' || {1} IN (" + ", ".join(f"'{a}>{b}'" for a, b in TRANSITIONS["review"]) + ") END, false)"


@query(
    f"WITH RECURSIVE changes AS (SELECT event_id AS seq, user_id AS event_id, {_STATES}[event_id % 6 + 1] AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events), "
    "walk AS (SELECT nth, seq, event_id, state, CASE WHEN event_id % 2 = 0 THEN 'pending' END AS previous FROM changes WHERE nth = 1 "
    f"UNION ALL SELECT c.nth, c.seq, c.event_id, c.state, CASE WHEN {_LEGAL.format('w.previous', 'w.state')} THEN w.state ELSE w.previous END FROM walk w JOIN changes c ON c.event_id = w.event_id AND c.nth = w.nth + 1) "
    f"SELECT seq, event_id, state, previous, {_LEGAL.format('previous', 'state')} AS legal FROM walk"
)
def status_moves(spark, sf):
    """T5, PATCH status: chained and rival moves of one batch, each judged against the last legal one before it."""
    e = B.table(spark, sf, "events")
    changes = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("event_id"), F.get(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 6).cast("int")).alias("state"), F.col("ts").alias("at"))
    stored = e.where("user_id % 2 = 0").select(F.col("user_id").alias("event_id"), F.lit("pending").alias("state"), F.lit(0).alias("at")).distinct()
    return store.judge_moves(changes, stored, order=["at", "seq"]).select("seq", "event_id", "state", "previous", "legal")


@query(
    "SELECT array_to_string(['rows', 'checksum'], ',') AS changed, true AS bump"
)
def version_bump(spark, sf):
    """A manifest compared with the one before; another row changes both parts."""
    docs = B.table(spark, sf, "documents")
    old, new = (datasets.manifest(d, "doc_id", ["text", "lang"], v) for d, v in ((docs.where("doc_id > 0"), "1"), (docs, "2")))
    return datasets.version_bump(old, new, ["rows", "checksum"]).select(F.array_join("changed", ",").alias("changed"), "bump")


@query(_with(B.TRACKS_SQL, "SELECT evidence_missing, count(*) AS n FROM (SELECT event_id NOT IN (SELECT event_id FROM evidence WHERE storage_path IS NOT NULL AND event_id IS NOT NULL) AS evidence_missing FROM store) GROUP BY ALL"))
def missing_evidence(spark, sf):
    """Events whose evidence could not be stored are marked."""
    return integrity.mark_missing_evidence(B.event_store(spark, sf), B.evidence(spark, sf)).groupBy("evidence_missing").agg(F.count("*").alias("n"))


# Joins on time, space and hashes


@query(
    "SELECT e.event_id, o.o_orderkey, o.o_totalprice FROM (SELECT *, ts - INTERVAL 25 YEAR AS at FROM events) e ASOF LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1) o ON e.user_id = o.o_custkey AND e.at >= o.o_orderdate"
)
def position_as_of(spark, sf):
    """The last known state of a source at each detection's time."""
    e = B.table(spark, sf, "events").select("event_id", F.col("user_id").alias("k"), (F.col("ts") - F.expr("interval 25 years")).alias("at"))
    o = B.table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    return joins.as_of(e, o, "k", "at", "o_orderdate", ["o_orderkey", "o_totalprice"], "event_id", "o_orderkey").select("event_id", "o_orderkey", "o_totalprice")


@query(
    "WITH p AS (SELECT p_partkey AS k, p_partkey * 7919 % 10007 AS x, p_partkey * 104729 % 10009 AS y FROM part) SELECT a.k AS a, b.k AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS square FROM p a JOIN p b ON a.k < b.k AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 10000"
)
def near_points(spark, sf):
    """Pairs of places within a distance, by grid cells."""
    k = F.col("p_partkey")
    return joins.near_pairs(B.table(spark, sf, "part").select(k.alias("k"), (k * 7919 % 10007).alias("x"), (k * 104729 % 10009).alias("y")), "k", "x", "y", 100)


@query(
    "WITH h AS (SELECT vec_id, list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda v: (v > 0)::HUGEINT)), lambda a, v: a * 2 + v) AS h FROM embeddings), one AS (SELECT h, min(vec_id) AS k FROM h GROUP BY h) "
    "SELECT a.k AS a, b.k AS b, bit_count(xor(a.h, b.h))::INT AS bits FROM one a JOIN one b ON a.k < b.k AND bit_count(xor(a.h, b.h)) <= 7"
)
def near_duplicate_hashes(spark, sf):
    """Pairs of perceptual-hash stand-ins that differ in at most seven bits; ``near_duplicate_members`` has each one's vectors."""
    return joins.near_hashes(_hashed(spark, sf), "vec_id", "h", 7)


def _hashed(spark, sf):
    return B.table(spark, sf, "embeddings").select("vec_id", joins.sign_words(F.col("embedding")).alias("h"))


@query("SELECT vec_id AS member, min(vec_id) OVER (PARTITION BY list_transform(embedding, lambda v: v > 0)) AS representative FROM embeddings")
def near_duplicate_members(spark, sf):
    """Every vector with the least one of its hash, which stands for it in ``near_duplicate_hashes``."""
    return joins.members_of(_hashed(spark, sf), "vec_id", "h")


# Datasets


@query(_with(B.SAMPLES_SQL, "SELECT DISTINCT group_key, split FROM split"))
def group_splits(spark, sf):
    """A split for each leakage group."""
    return datasets.assign_splits(_samples(spark, sf))


def _samples(spark, sf):
    return B.samples(spark, sf).withColumn("group_key", datasets.group_key())


@query(_with(B.SAMPLES_SQL, "SELECT split, count(*) FILTER (class = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (class = '2-HIGH') AS \"2-HIGH\", count(*) FILTER (class = '5-LOW') AS \"5-LOW\", count(*) AS samples, count(DISTINCT group_key) AS groups FROM split GROUP BY split"))
def split_distribution(spark, sf):
    """Each split's samples by class."""
    grouped = _samples(spark, sf)
    placed = grouped.join(datasets.assign_splits(grouped), "group_key")
    return datasets.split_distribution(placed, "class", ["1-URGENT", "2-HIGH", "5-LOW"])


@query(_with(B.SAMPLES_SQL, "SELECT group_key, count(DISTINCT CASE WHEN image_id % 50 = 0 THEN 'train' ELSE split END) AS splits FROM split GROUP BY group_key HAVING count(DISTINCT CASE WHEN image_id % 50 = 0 THEN 'train' ELSE split END) > 1"))
def split_leakage(spark, sf):
    """Groups in two splits, after some samples were put elsewhere by hand."""
    placed = _samples(spark, sf).withColumn("split", datasets.split_of(F.col("group_key")))
    return datasets.leakage(placed.withColumn("split", F.when(F.col("image_id") % 50 == 0, "train").otherwise(F.col("split"))))


@query(_with(B.SAMPLES_SQL, "SELECT group_key FROM split WHERE split = 'train' INTERSECT SELECT group_key FROM split WHERE split = 'test'"))
def split_intersection(spark, sf):
    """Groups that training and test share: none."""
    placed = _samples(spark, sf).withColumn("split", datasets.split_of(F.col("group_key")))
    return datasets.disjoint(placed.where("split = 'train'"), placed.where("split = 'test'"))


@query("SELECT sha256(text) AS checksum, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    """Contents that occur more than once."""
    docs = B.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return datasets.duplicate_groups(docs, "checksum", "doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def deduplicated(spark, sf):
    """One row of each content."""
    docs = B.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return datasets.deduplicated(docs, "checksum", "doc_id").select("doc_id")


@query("SELECT source, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT 'part' AS source, p_partkey AS id FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY source")
def combined_datasets(spark, sf):
    """Candidate datasets as one."""
    parts = [B.table(spark, sf, t).select(F.lit(t).alias("source"), F.col(k).alias("id")) for t, k in (("part", "p_partkey"), ("supplier", "s_suppkey"))]
    return datasets.combine(*parts).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query(_with(B.RAW_SQL, "SELECT detection_id FROM judged WHERE reason IS NOT NULL"))
def rejected_ids(spark, sf):
    """U4: all detections minus the accepted."""
    return B.raw_detections(spark, sf).select("detection_id").exceptAll(B.detections(spark, sf).select("detection_id"))


@query(_with(B.BOXES_SQL, "SELECT class, count(*) AS n, round(count(*) / (SELECT count(*) FROM truths), 9) AS share, count(*) / (SELECT count(*) FROM truths) < 0.3 AS imbalanced FROM truths GROUP BY class"))
def class_balance(spark, sf):
    """A5: class counts and shares."""
    return datasets.class_balance(B.truths(spark, sf), least_share=0.3).withColumn("share", F.round("share", 9))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def source_diversity(spark, sf):
    """How many items each source and kind has."""
    return B.table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


# Metrics


def _claimed(spark, sf, thresholds=metrics.LADDER):
    return metrics.claims(metrics.best_truth(metrics.pairs(B.predictions(spark, sf), B.truths(spark, sf))), thresholds)


def _judged(spark, sf, thresholds=metrics.LADDER):
    return metrics.judge(_claimed(spark, sf, thresholds), thresholds)


@query(_with(B.MATCH_SQL, "SELECT pred_id, gt_id, round(inter / nullif(uni, 0), 9) AS iou FROM best"))
def best_ious(spark, sf):
    """Each prediction's best ground truth and IoU."""
    best = metrics.best_truth(metrics.pairs(B.predictions(spark, sf), B.truths(spark, sf)))
    return best.select("pred_id", "gt_id", F.round(scalar.ratio(F.col("inter"), F.col("uni")), 9).alias("iou"))


@query(_with(B.MATCH_SQL, "SELECT threshold::INT AS threshold, sum(tp)::BIGINT AS tp, (count(*) - sum(tp))::BIGINT AS fp FROM judged GROUP BY threshold"))
def match_counts(spark, sf):
    """True and false positives at each threshold."""
    return _judged(spark, sf).groupBy("threshold").agg(F.sum("tp").alias("tp"), (F.count("*") - F.sum("tp")).alias("fp"))


@query(
    _with(
        B.MATCH_SQL,
        "SELECT class, threshold::INT AS threshold, tp, n - tp AS fp, n_truths - tp AS fn, round(tp / nullif(n, 0), 9) AS precision, round(tp / nullif(n_truths, 0), 9) AS recall, round(2 * (tp / nullif(n, 0)) * (tp / nullif(n_truths, 0)) / nullif(tp / nullif(n, 0) + tp / nullif(n_truths, 0), 0), 9) AS f1 "
        "FROM (SELECT class, threshold, sum(tp)::BIGINT AS tp, count(*) AS n FROM judged WHERE confidence >= 0.5 AND threshold IN (50, 75) GROUP BY ALL) JOIN (SELECT class, count(*) AS n_truths FROM truths GROUP BY ALL) USING (class)",
    )
)
def precision_recall_f1(spark, sf):
    """M2, M3, M4: by class at two thresholds."""
    out = metrics.precision_recall_f1(_judged(spark, sf, [50, 75]), B.truths(spark, sf), ["class"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(_with(B.MATCH_SQL, "SELECT class, threshold::INT AS threshold, n_truths, round(ap, 9) AS ap FROM ap"))
def average_precision(spark, sf):
    """AP of each class and threshold."""
    return metrics.average_precision(_claimed(spark, sf), B.truths(spark, sf)).withColumn("ap", F.round("ap", 9))


@query(_with(B.MATCH_SQL, "SELECT round(avg(ap) FILTER (threshold = 50), 9) AS map50, round(avg(ap) FILTER (threshold = 75), 9) AS map75, round(avg(ap), 9) AS map50_95 FROM ap"))
def mean_average_precision(spark, sf):
    """Means over classes, and over the ladder."""
    out = metrics.mean_ap(metrics.average_precision(_claimed(spark, sf), B.truths(spark, sf)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    _with(
        B.MATCH_SQL.split(", ranked AS (")[0]
        + """, sized AS (SELECT *, CASE WHEN (x2 - x1) * (y2 - y1) <= 1500 THEN 'small' WHEN (x2 - x1) * (y2 - y1) <= 3000 THEN 'medium' ELSE 'large' END AS size FROM truths)
, own AS (SELECT pred_id, CASE WHEN (x2 - x1) * (y2 - y1) <= 1500 THEN 'small' WHEN (x2 - x1) * (y2 - y1) <= 3000 THEN 'medium' ELSE 'large' END AS own_size FROM predictions)
, placed AS (SELECT j.*, coalesce(s.size, own_size) AS size FROM judged j LEFT JOIN (SELECT gt_id, size FROM sized) s ON j.hit = s.gt_id JOIN own USING (pred_id) WHERE threshold IN (50, 75))
, ranked AS (SELECT *, row_number() OVER w AS rank, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far FROM placed WINDOW w AS (PARTITION BY class, size, threshold ORDER BY confidence DESC, pred_id))
, hull AS (SELECT *, max(so_far / rank) OVER (PARTITION BY class, size, threshold ORDER BY confidence, pred_id DESC ROWS UNBOUNDED PRECEDING) AS envelope FROM ranked)""",
        "SELECT class, size, threshold::INT AS threshold, n_truths, round(coalesce(sum(tp * envelope), 0) / n_truths, 9) AS ap FROM (SELECT class, size, count(*) AS n_truths FROM sized GROUP BY ALL) JOIN (SELECT unnest([50, 75]) AS threshold) ON true LEFT JOIN hull USING (class, size, threshold) GROUP BY class, size, threshold, n_truths",
    )
)
def ap_by_size(spark, sf):
    """M9: AP by the ground truth's size."""
    return metrics.by_size(B.predictions(spark, sf), B.truths(spark, sf), 1500, 3000, [50, 75]).withColumn("ap", F.round("ap", 9))


@query(
    _with(
        B.MATCH_SQL,
        "SELECT eval_set, 50 AS threshold, tp, n - tp AS fp, n_truths - tp AS fn, round(tp / n, 9) AS precision, round(tp / n_truths, 9) AS recall, round(2 * (tp / n) * (tp / n_truths) / (tp / n + tp / n_truths), 9) AS f1 FROM (SELECT ['validation', 'test', 'unseen', 'cross_domain'][frame_id % 4 + 1] AS eval_set, sum(tp)::BIGINT AS tp, count(*) AS n FROM judged WHERE threshold = 50 AND confidence >= 0.5 GROUP BY ALL) JOIN (SELECT ['validation', 'test', 'unseen', 'cross_domain'][frame_id % 4 + 1] AS eval_set, count(*) AS n_truths FROM truths GROUP BY ALL) USING (eval_set)",
    )
)
def metrics_by_set(spark, sf):
    """Metrics of each evaluation set."""
    judged, truth = _judged(spark, sf, [50]).withColumn("eval_set", B.eval_set()), B.truths(spark, sf).withColumn("eval_set", B.eval_set())
    out = metrics.precision_recall_f1(judged, truth, ["eval_set"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(_with(B.EXPERIMENTS_SQL, "SELECT experiment_id, precision, recall, speed FROM experiments a WHERE NOT EXISTS (SELECT 1 FROM experiments b WHERE b.precision >= a.precision AND b.recall >= a.recall AND b.speed >= a.speed AND (b.precision > a.precision OR b.recall > a.recall OR b.speed > a.speed))"))
def pareto_models(spark, sf):
    """Models that no other beats in every criterion."""
    return metrics.pareto(B.experiments(spark, sf).select("experiment_id", "precision", "recall", "speed"), ["precision", "recall", "speed"], "experiment_id")


@query(_with(B.EXPERIMENTS_SQL, "SELECT comparison, count(DISTINCT dataset_version) AS dataset_version, count(DISTINCT image_size) AS image_size FROM experiments GROUP BY comparison HAVING count(DISTINCT dataset_version) > 1 OR count(DISTINCT image_size) > 1"))
def incomparable_experiments(spark, sf):
    """Comparisons whose experiments differ in what must be the same."""
    return metrics.comparable(B.experiments(spark, sf), ["dataset_version", "image_size"])


@query(_with(B.EXPERIMENTS_SQL, "SELECT experiment_id, precision - first(precision) OVER w AS precision_delta, recall - first(recall) OVER w AS recall_delta FROM experiments WINDOW w AS (PARTITION BY comparison ORDER BY started_at, experiment_id)"))
def baseline_deltas(spark, sf):
    """Each run against its comparison's first."""
    return metrics.baseline_delta(B.experiments(spark, sf), ["precision", "recall"]).select("experiment_id", "precision_delta", "recall_delta")


@query(
    _with(
        B.EXPERIMENTS_SQL,
        "SELECT experiment_id, dataset_version, r_name, count(*) AS runs FROM experiments JOIN region ON comparison = r_regionkey JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL",
    )
)
def experiment_joins(spark, sf):
    """Experiments with their dataset, evaluation and benchmark rows."""
    e, region, nation = B.experiments(spark, sf), B.table(spark, sf, "region"), B.table(spark, sf, "nation")
    both = e.join(region, e["comparison"] == region["r_regionkey"]).join(nation, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("experiment_id", "dataset_version", "r_name").agg(F.count("*").alias("runs"))


_KINDS = ["shadow", "manhole", "patch", "debris", "marking", "water", "other"]


def _errors(spark, sf, wrong: bool):
    if wrong:
        rows, key = _judged(spark, sf, [50]).where("tp = 0"), "pred_id"
    else:
        judged = _judged(spark, sf, [50]).where("tp = 1").select(F.col("hit").alias("gt_id"))
        rows, key = joins.without_match(B.truths(spark, sf), judged, "gt_id"), "gt_id"
    names = F.array(*map(F.lit, ["shadow", "manhole", "patch", "debris", "marking", "water", "glare", "tar"]))
    return rows.withColumn("kind", F.get(names, (F.col(key) % 8).cast("int")))


_KIND_SQL = "CASE WHEN {0} % 8 < 6 THEN ['shadow', 'manhole', 'patch', 'debris', 'marking', 'water'][{0} % 8 + 1] ELSE 'other' END"


@query(_with(B.MATCH_SQL, f"SELECT kind, count(pred_id) AS n FROM (SELECT unnest(['shadow', 'manhole', 'patch', 'debris', 'marking', 'water', 'other']) AS kind) LEFT JOIN (SELECT pred_id, {_KIND_SQL.format('pred_id')} AS kind FROM judged WHERE threshold = 50 AND tp = 0) USING (kind) GROUP BY kind"))
def false_positive_kinds(spark, sf):
    """False positives by kind; unknown kinds are other."""
    return datasets.taxonomy(_errors(spark, sf, True), "kind", _KINDS)


@query(_with(B.MATCH_SQL, f"SELECT kind, count(gt_id) AS n FROM (SELECT unnest(['shadow', 'manhole', 'patch', 'debris', 'marking', 'water', 'other']) AS kind) LEFT JOIN (SELECT gt_id, {_KIND_SQL.format('gt_id')} AS kind FROM truths WHERE gt_id NOT IN (SELECT hit FROM judged WHERE threshold = 50 AND tp = 1)) USING (kind) GROUP BY kind"))
def false_negative_kinds(spark, sf):
    """Missed boxes by kind."""
    return datasets.taxonomy(_errors(spark, sf, False), "kind", _KINDS)


@query(_with(B.MATCH_SQL, "SELECT level, domain, sum(tp)::BIGINT AS tp, count(*) AS n FROM (SELECT *, frame_id % 5 AS level, frame_id % 10 AS domain FROM judged WHERE threshold = 50) GROUP BY ROLLUP (level, domain)"))
def generalization(spark, sf):
    """Results by level and domain, with totals."""
    judged = _judged(spark, sf, [50]).withColumns({"level": F.col("frame_id") % 5, "domain": F.col("frame_id") % 10})
    return datasets.generalization(judged, "level", "domain")


@query(
    "SELECT hardware, count(*) AS frames, round(avg(a), 6) AS avg_preprocess_ms, round(avg(b), 6) AS avg_forward_ms, round(avg(c), 6) AS avg_postprocess_ms, round(avg(a + b + c), 6) AS avg_total_ms, quantile_cont(a + b + c, 0.5) AS p50_total_ms, round(quantile_cont(a + b + c, 0.95), 6) AS p95_total_ms, round(1000.0 / avg(a + b + c), 6) AS fps, max(m) AS peak_memory_mb, round(avg(u), 6) AS avg_utilization "
    "FROM (SELECT user_id % 5 AS hardware, event_id % 7 + 1 AS a, event_id % 31 + 5 AS b, event_id % 3 AS c, event_id * 13 % 4096 AS m, event_id % 100 AS u FROM events) GROUP BY hardware"
)
def runtime_benchmarks(spark, sf):
    """Latencies, frames a second, memory and utilisation."""
    e = F.col("event_id")
    runs = B.table(spark, sf, "events").select((F.col("user_id") % 5).alias("hardware"), (e % 7 + 1).alias("preprocess_ms"), (e % 31 + 5).alias("forward_ms"), (e % 3).alias("postprocess_ms"), (e * 13 % 4096).alias("memory_mb"), (e % 100).alias("utilization"))
    out = datasets.runtime_rollup(runs, ["hardware"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("avg") or c in ("fps", "p95_total_ms")})


@query(_with(B.MATCH_SQL, "SELECT class, count(*) AS boxes, round(avg(coalesce(inter / nullif(uni, 0), 0)), 9) AS mean_iou FROM best GROUP BY class"))
def annotator_agreement(spark, sf):
    """How well two annotators' boxes agree."""
    return datasets.agreement(B.predictions(spark, sf), B.truths(spark, sf)).withColumn("mean_iou", F.round("mean_iou", 9))


@query(_with(B.TRACKS_SQL, "SELECT submitted_by, priority, strftime(date_trunc('day', submitted_at), '%Y-%m-%d') AS day, count(*) AS reports FROM reports GROUP BY ALL"))
def report_summary(spark, sf):
    """Reports by submitter, priority and day."""
    return B.reports(spark, sf).groupBy("submitted_by", "priority", F.date_format("submitted_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("reports"))


# Operators that SQL can't express, and streams


@query()
def suppressed_boxes(spark, sf):
    """Non-maximum suppression of each frame's predictions."""
    return boxes_ops.suppress(B.predictions(spark, sf)).select("pred_id", "frame_id", "class")


@query()
def greedy_matches(spark, sf):
    """Greedy matching: a prediction may fall back to its second-best box."""
    return boxes_ops.greedy_match(B.predictions(spark, sf), B.truths(spark, sf))


@query()
def overlap_tracks(spark, sf):
    """Tracks by overlap."""
    return boxes_ops.associate(B.detections(spark, sf), gap_seconds=B.GAP_SECONDS).select("source_id", "detection_id", "track_no")


def _detection_files(spark, sf):
    """The detections as a folder of files that arrive in the order of time, as a stream reads them."""
    path = _folder(spark, "detections")
    held = B.detections(spark, sf).withColumn("capture_timestamp", F.col("capture_timestamp").cast("timestamp"))
    low, high = held.agg(F.min("capture_timestamp").cast("double"), F.max("capture_timestamp").cast("double")).first()
    quarter = F.least(F.lit(3), F.floor((F.col("capture_timestamp").cast("double") - low) * 4 / (high - low + 1e-3)))
    for n in range(4):
        held.where(quarter == n).write.mode("append").parquet(path)
    return path


@query(_with(B.TRACKS_SQL, "SELECT source_id, first_seen, last_seen, n_detections, max_confidence FROM tracks"))
def streamed_tracks(spark, sf):
    """Session tracks of a stream, equal to the batch's once all input came."""
    from roadlake.streaming import pipelines as S

    stream = S.session_tracks(S.stream_table(spark, _detection_files(spark, sf), 100), B.GAP_SECONDS, "60 days")
    out = S.run_to_table(stream, _folder(spark, "tracks"), _folder(spark, "checkpoint"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


@query(_with(B.TRACKS_SQL, "SELECT event_id, source_id, confidence FROM store"))
def streamed_events(spark, sf):
    """Events sent twice, through duplicate suppression and an idempotent sink that is replayed."""
    from roadlake.streaming import pipelines as S

    path, target = _folder(spark, "events"), _folder(spark, "store")
    events = B.event_store(spark, sf).select("event_id", "source_id", "confidence", F.col("timestamp").cast("timestamp"))
    events.union(events).repartition(4).write.parquet(path)
    for _ in range(2):  # the second run replays the input under another checkpoint
        S.idempotent_sink(S.once_within(S.stream_table(spark, path, 100), "60 days"), target, _folder(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(target).select("event_id", "source_id", "confidence")


@query()
def streamed_buffer(spark, sf):
    """The newest frames of each source in each batch, and what was dropped."""
    from roadlake.streaming import pipelines as S

    target, log = _folder(spark, "frames"), _folder(spark, "dropped")
    S.bounded_buffer(S.stream_table(spark, _detection_files(spark, sf), 1), 5, target, log, _folder(spark, "checkpoint")).awaitTermination()
    kept = spark.read.parquet(target).groupBy("source_id", "batch").agg(F.count("*").alias("kept"))
    return spark.read.parquet(log).join(kept, ["source_id", "batch"])


@query()
def streamed_overlap_tracks(spark, sf):
    """The overlap tracker with state for each source."""
    from roadlake.streaming import pipelines as S

    stream = S.overlap_tracks(S.stream_table(spark, _detection_files(spark, sf), 1), gap_seconds=B.GAP_SECONDS)
    return S.run_to_table(stream, _folder(spark, "overlap"), _folder(spark, "checkpoint"))
