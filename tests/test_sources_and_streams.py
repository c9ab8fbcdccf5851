"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from roadlake.operators import boxes_ops, tracks
from roadlake.operators import validation as V
from roadlake.sources import readers, sinks
from roadlake.streaming import pipelines as S


def test_yolo_and_coco(spark, tmp_path):
    (tmp_path / "labels/train").mkdir(parents=True)
    (tmp_path / "labels/train/img1.txt").write_text("0 0.5 0.5 0.25 0.5\n1 0.1 0.2\n\n2 a b c d\n")
    df = readers.read_yolo(spark, str(tmp_path / "labels"))
    ok, bad = df.where("reason is null"), df.where("reason is not null")
    boxes = V.yolo_to_xyxy(V.with_resolution(ok, 640, 480)).collect()
    assert [(r.image_id, r.split, r.label, r.x1, r.y1, r.x2, r.y2) for r in boxes] == [("img1", "train", "0", 240, 120, 400, 360)]
    assert bad.count() == 2
    coco = {"images": [{"id": 1, "file_name": "a.jpg", "width": 9, "height": 8}], "categories": [{"id": 4, "name": "crack"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 4, "bbox": [1, 2, 3, 4]}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    assert [tuple(r) for r in readers.read_coco(spark, str(tmp_path / "c.json")).collect()] == [(5, 1, "a.jpg", 9, 8, "crack", 1.0, 2.0, 4.0, 6.0)]


def test_other_readers_and_sinks(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.jpg").write_bytes(b"\xff\xd8\xff\x00")
    (tmp_path / "img/b.jpg").write_bytes(b"GIF8")
    ok, bad = V.exclude_corrupt(readers.read_images(spark, str(tmp_path / "img")), {"jpg": "FFD8FF"})
    assert ok.count() == 1 and [r.reason for r in bad.collect()] == ["corrupt"]
    (tmp_path / "registry.json").write_text(json.dumps({"name": "set", "images": 4}))
    assert readers.read_registry(spark, str(tmp_path / "registry.json")).select("name", "images", "license").first() == ("set", 4, None)
    (tmp_path / "x.json").write_text(json.dumps({"experiment_id": "e", "seed": "1"}))
    assert readers.read_experiments(spark, str(tmp_path / "x.json")).select("experiment_id", "seed", "optimizer").first() == ("e", "1", None)
    (tmp_path / "f.json").write_text(json.dumps({"frame_id": "f", "source_id": "s", "frame_index": 3, "capture_timestamp": "2024-01-01T00:00:00Z"}))
    assert readers.read_frames(spark, str(tmp_path / "f.json")).first().frame_index == 3
    mock = readers.mock_detections(spark, 100)
    good, _ = V.split_valid(mock, V.detection_reason(F.lit(640), F.lit(480)))
    assert good.count() == 100
    sinks.write_manifest(mock, f"{tmp_path}/m", "detection_id", ["confidence"], "v1")
    assert spark.read.json(f"{tmp_path}/m").first().rows == 100
    sinks.write_splits(mock.withColumns({"split": F.lit("train"), "group_key": F.col("source_id")}), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").where("split = 'train'").count() == 100
    sinks.export_reports(spark.createDataFrame([("r", "e")], "report_id string, event_id string"), f"{tmp_path}/r")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/r").columns == ["report_id", "event_id"]
    with pytest.raises(ValueError):
        sinks.export_reports(mock, f"{tmp_path}/q", "xml")


def test_camera_stream(spark, tmp_path):
    stream = readers.read_stream(spark, frames=50, frames_per_batch=20, sources=4)
    query = stream.writeStream.format("memory").queryName("camera_frames").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
        for _ in range(3):
            query.processAllAvailable()
        rows = spark.sql("select * from camera_frames").collect()
    finally:
        query.stop()
    assert len(rows) == 50 == len({r.frame_id for r in rows})


def test_stream_equals_batch(spark, tmp_path):
    mock = readers.mock_detections(spark, 400, sources=5, frame_seconds=7).where("substring(detection_id, 2) % 9 != 0")
    times = sorted(r[0] for r in mock.select("capture_timestamp").distinct().collect())
    cuts = [0, len(times) // 3, len(times) * 2 // 3, len(times)]
    for low, high in zip(cuts, cuts[1:]):  # files arrive in the order of time
        mock.where(F.col("capture_timestamp").between(times[low], times[high - 1])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    batch = tracks.rollup(tracks.gap_tracks(mock, 7), history=False).select("source_id", "first_seen", "last_seen", "n_detections")
    streamed = S.run_to_table(S.session_tracks(S.stream_table(spark, f"{tmp_path}/d"), 7, "1 day"), f"{tmp_path}/o", f"{tmp_path}/c", "complete")
    assert sorted(map(tuple, streamed.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    whole = boxes_ops.associate(mock, gap_seconds=20.0).select("source_id", "detection_id", "track_no")
    steps = S.run_to_table(S.overlap_tracks(S.stream_table(spark, f"{tmp_path}/d"), gap_seconds=20.0), f"{tmp_path}/t", f"{tmp_path}/k")
    assert sorted(map(tuple, steps.collect())) == sorted(map(tuple, whole.collect()))


def test_sink_and_buffer(spark, tmp_path):
    events = readers.mock_detections(spark, 60).select(F.col("detection_id").alias("event_id"), F.col("capture_timestamp").alias("timestamp"), "source_id")
    events.union(events).repartition(3).write.parquet(f"{tmp_path}/e")
    for n in range(2):
        S.idempotent_sink(S.once_within(S.stream_table(spark, f"{tmp_path}/e")), f"{tmp_path}/out", f"{tmp_path}/c{n}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60
    frames = events.withColumnsRenamed({"event_id": "frame_id", "timestamp": "capture_timestamp"})
    frames.coalesce(1).write.parquet(f"{tmp_path}/f")
    S.bounded_buffer(S.stream_table(spark, f"{tmp_path}/f"), 4, f"{tmp_path}/kept", f"{tmp_path}/log", f"{tmp_path}/cb").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 40
    assert spark.read.parquet(f"{tmp_path}/log").agg(F.sum("dropped")).first()[0] == 20


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    """Without the record that a batch was committed, the stream sends it again."""
    import glob
    import os

    frames = readers.mock_detections(spark, 60).select(F.col("detection_id").alias("frame_id"), "capture_timestamp", "source_id")
    frames.coalesce(1).write.parquet(f"{tmp_path}/f")
    for _ in range(2):
        S.bounded_buffer(S.stream_table(spark, f"{tmp_path}/f"), 4, f"{tmp_path}/kept", f"{tmp_path}/log", f"{tmp_path}/cb").awaitTermination()
        rows = S.run_to_table(S.stream_table(spark, f"{tmp_path}/f"), f"{tmp_path}/t", f"{tmp_path}/ct")
        assert spark.read.parquet(f"{tmp_path}/kept").count() == 40 and rows.count() == 60
        assert spark.read.parquet(f"{tmp_path}/log").agg(F.sum("dropped")).first()[0] == 20
        for path in glob.glob(f"{tmp_path}/c[bt]/commits/*") + glob.glob(f"{tmp_path}/c[bt]/commits/.*.crc"):
            os.remove(path)
