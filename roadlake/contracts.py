"""Record schemas at the engine's boundaries, and the fixed vocabularies of their state machines."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 1

BOX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x1", "y1", "x2", "y2")])
LOCATION = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])


def _fields(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "t": T.TimestampType(), "b": T.BooleanType(), "i": T.IntegerType(), "l": T.LongType(), "box": BOX, "loc": LOCATION, "as": T.ArrayType(T.StringType()), "map": T.MapType(T.StringType(), T.StringType())}
    return T.StructType([T.StructField(n.rstrip("!"), kinds[k], not n.endswith("!")) for n, k in (x.split(":") for x in spec.split())])


DETECTION = _fields("detection_id:s class!:s confidence!:d bbox!:box frame_id!:s capture_timestamp!:t track_id:s source_id:s model_version_id:s preprocessing_version:s")
TRACK = _fields("track_id!:s source_id!:s first_seen!:t last_seen!:t detections!:as avg_confidence:d max_confidence:d status:s")
EVENT = _fields("event_id!:s source_id!:s timestamp!:t confidence!:d bbox:box location:loc status!:s report_id:s model_version_id:s")
REPORT = _fields("report_id!:s event_id!:s submitted_by!:s submitted_at!:t priority:s resolution:s status:s")
EVIDENCE = _fields("evidence_id!:s event_id!:s media_type!:s storage_path!:s captured_at!:t verified:b")
CAMERA = _fields("camera_id!:s location:loc active!:b metadata:map")
MODEL_VERSION = T.StructType([*_fields("model_version_id!:s model_name!:s weights_hash!:s"), T.StructField("accuracy_metrics", _fields("map:d recall:d precision:d")), T.StructField("is_active", T.BooleanType(), False)])
ANNOTATION = _fields("image_id!:s class!:s x1!:i y1!:i x2!:i y2!:i image_width!:i image_height!:i")
REGISTRY = _fields("name!:s source:s version:s date_checked:s license:s coverage:s perspective:s structure:s format:s classes:s images:l sequences:l provenance:s limitations:s notes:s")

# States and the moves between them.
TRANSITIONS = {
    "detection": [("created", "consumed"), ("consumed", "retained"), ("retained", "purged")],
    "track": [("active", "confirmed"), ("confirmed", "closed"), ("active", "expired"), ("active", "invalid")],
    "event": [("candidate", "confirmed"), ("confirmed", "closed"), ("candidate", "rejected")],
    "review": [("created", "pending"), ("pending", "approved"), ("pending", "rejected"), ("approved", "resolved"), ("approved", "closed"), ("rejected", "resolved"), ("rejected", "closed")],
    "report": [("pending", "approved"), ("approved", "resolved")],
    "camera": [("created", "active"), ("created", "inactive"), ("active", "inactive"), ("inactive", "active"), ("active", "retired"), ("inactive", "retired")],
    "evidence": [("created", "stored"), ("stored", "verified"), ("verified", "retained"), ("stored", "retained"), ("verified", "archived"), ("stored", "archived")],
    "model_version": [("registered", "active"), ("active", "deprecated"), ("deprecated", "archived")],
}
#: Leakage groups, coarsest first.
GROUP_KEYS = ["video", "trip", "location", "session", "sequence"]
#: What a reproducible experiment records.
EXPERIMENT_FIELDS = ["experiment_id", "dataset_version", "split_version", "preprocessing_version", "architecture", "initial_weights", "optimizer", "learning_rate", "batch_size", "epochs", "image_size", "augmentation", "seed", "hardware", "software", "commit", "artifact_hash"]
