"""Hand-worked cases and invariants."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlake.contracts import TRANSITIONS
from roadlake.functions import boxes, scalar
from roadlake.operators import boxes_ops, datasets, integrity, joins, metrics, store, tracks
from roadlake.operators import validation as V

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize(
    "a,b,want",
    [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (20, 20, 30, 30), 0.0), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (0, 0, 5, 10), 0.5), ((0, 0, 10, 10), (None,) * 4, None), ((1, 1, 1, 1), (1, 1, 1, 1), None)],
)
def test_iou(spark, a, b, want):
    names = [p + c for p in "ab" for c in ("x1", "y1", "x2", "y2")]
    df = spark.createDataFrame([(*a, *b)], ", ".join(f"{n} int" for n in names))
    one, two = boxes.Box.prefixed("a"), boxes.Box.prefixed("b")
    assert df.select(boxes.iou(one, two), boxes.iou(two, one)).first() == (want, want)
    if want == 0.5:
        assert df.select(boxes.overlaps(one, two, F.lit(50)), boxes.overlaps(one, two, F.lit(55))).first() == (True, False)


@pytest.mark.parametrize("box,ok", [((5, 0, 5, 9), False), ((0, 0, 640, 480), True), ((0, 0, 641, 9), False), ((-1, 0, 5, 9), False), ((0, 0, None, 9), False)])
def test_box_validation(spark, box, ok):
    df = spark.createDataFrame([box], "x1 int, y1 int, x2 int, y2 int")
    assert df.select(boxes.is_valid(F.lit(640), F.lit(480))).first()[0] is ok


def test_confidence(spark):
    values = [0.0, 1.0, -0.0, 1.0001, math.nan, math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    assert [r[0] for r in df.select(scalar.valid_confidence(F.col("c"))).collect()] == [True, True, True, False, False, False, False]
    clamped = [r[0] for r in df.select(scalar.clamp(F.col("c"))).collect()]
    assert clamped[:4] == [0.0, 1.0, 0.0, 1.0] and clamped[4] is None and clamped[5] == 1.0 and clamped[6] is None


def test_frame_id_and_rejects(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, " ", 0.5), (3, "f", 2.0), (4, "f", 0.5)], "detection_id int, frame_id string, confidence double").withColumns({"x1": F.lit(0), "y1": F.lit(0), "x2": F.lit(1), "y2": F.lit(1)})
    ok, bad = V.split_valid(df, V.detection_reason(F.lit(10), F.lit(10)))
    assert [r.detection_id for r in ok.collect()] == [4]
    assert {r.detection_id: r.reason for r in bad.collect()} == {1: "missing_frame_id", 2: "missing_frame_id", 3: "invalid_confidence"}


def prediction(n, confidence, box, frame=1, label="a"):
    return (frame, n, label, confidence, *box)


PRED = "frame_id int, pred_id long, class string, confidence double, x1 int, y1 int, x2 int, y2 int"
TRUE = "frame_id int, gt_id long, class string, x1 int, y1 int, x2 int, y2 int"


def five(spark):
    """Confidences .9 to .5, hits 1 0 1 1 0, four boxes."""
    box = lambda n: (100 * n, 0, 100 * n + 10, 10)
    hits = [0, None, 1, 2, None]
    pred = [prediction(n, 0.9 - 0.1 * n, box(h if h is not None else 50 + n)) for n, h in enumerate(hits)]
    return spark.createDataFrame(pred, PRED), spark.createDataFrame([(1, n, "a", *box(n)) for n in range(4)], TRUE)


def test_average_precision_by_hand(spark):
    pred, truth = five(spark)
    claimed = metrics.claims(metrics.best_truth(metrics.pairs(pred, truth)), metrics.LADDER)
    ap = metrics.average_precision(claimed, truth)
    assert [round(r.ap, 12) for r in ap.where("threshold = 50").collect()] == [0.625]
    assert round(metrics.mean_ap(ap).first().map50_95, 12) == 0.625
    # Recalls 0 to 25 % at 1, to 75 % at 0.75: (26 + 50 * 0.75) / 101
    coarse = metrics.average_precision_101(claimed, truth).where("threshold = 50").first().ap
    assert coarse == pytest.approx((26 + 50 * 0.75) / 101)


def test_precision_envelope_takes_later_maxima(spark):
    """One miss first: precision rises with recall, and the envelope takes the later value."""
    box = lambda n: (100 * n, 0, 100 * n + 10, 10)
    pred = spark.createDataFrame([prediction(n, 0.9 - 0.01 * n, box(n if n else 99)) for n in range(4)], PRED)
    truth = spark.createDataFrame([(1, n, "a", *box(n)) for n in range(1, 4)], TRUE)
    claimed = metrics.claims(metrics.best_truth(metrics.pairs(pred, truth)), [50])
    assert metrics.average_precision(claimed, truth, [50]).first().ap == pytest.approx(0.75)


def test_matching_and_ties(spark):
    box = (0, 0, 10, 10)
    pred = spark.createDataFrame([prediction(7, 0.5, box), prediction(3, 0.5, box), prediction(9, 0.4, box, label="b"), prediction(10, 0.4, box, frame=2)], PRED)
    truth = spark.createDataFrame([(1, 1, "a", *box)], TRUE)
    judged = metrics.judge(metrics.claims(metrics.best_truth(metrics.pairs(pred, truth)), [50]), [50])
    assert {r.pred_id: r.tp for r in judged.collect()} == {3: 1, 7: 0, 9: 0, 10: 0}
    f = metrics.precision_recall_f1(judged, truth, ["class"], 0.0).collect()
    assert [(r["class"], r.tp, r.fp, r.fn, r.recall) for r in sorted(f)] == [("a", 1, 2, 0, 1.0), ("b", 0, 1, 0, None)]


def test_no_predictions(spark):
    _, truth = five(spark)
    none = spark.createDataFrame([], PRED)
    claimed = metrics.claims(metrics.best_truth(metrics.pairs(none, truth)), [50])
    assert metrics.average_precision(claimed, truth, [50]).first().ap == 0.0


def test_gap_boundary_and_isolation(spark):
    rows = [(1, "a", at(0)), (2, "a", at(10)), (3, "a", at(20) + dt.timedelta(microseconds=1)), (4, "b", at(5)), (5, "b", at(15))]
    df = spark.createDataFrame(rows, "detection_id int, source_id string, capture_timestamp timestamp")
    got = {r.detection_id: (r.source_id, r.track_seq) for r in tracks.gap_tracks(df, 10).collect()}
    assert got == {1: ("a", 1), 2: ("a", 1), 3: ("a", 2), 4: ("b", 1), 5: ("b", 1)}
    assert tracks.gap_tracks(df.repartition(5), 10).count() == 5


def test_bounded_buffer(spark):
    df = spark.createDataFrame([("s", f"f{n}", at(n)) for n in range(7)] + [("t", "g", at(0))], "source_id string, frame_id string, capture_timestamp timestamp")
    assert sorted(r.frame_id for r in tracks.newest(df, 5).collect()) == ["f2", "f3", "f4", "f5", "f6", "g"]
    assert {r.source_id: r.dropped for r in tracks.dropped(df, 5).collect()} == {"s": 2, "t": 0}


def test_transitions(spark):
    log = spark.createDataFrame([(1, 0, "active"), (1, 1, "expired"), (1, 2, "confirmed"), (2, 0, "active"), (2, 1, "confirmed"), (2, 2, "closed")], "k int, n int, state string")
    assert [(r.k, r.previous, r.state) for r in tracks.illegal_transitions(log, TRANSITIONS["track"], "k", ["n"]).collect()] == [(1, "expired", "confirmed")]


def test_store_is_idempotent(spark, tmp_path):
    events = spark.createDataFrame([("a", at(1)), ("b", at(2)), ("a", at(0))], "event_id string, timestamp timestamp")
    for _ in range(3):
        store.ingest_events(spark, events, f"{tmp_path}/e")
    got = spark.read.parquet(f"{tmp_path}/e").collect()
    assert sorted((r.event_id, r.timestamp) for r in got) == [("a", at(0)), ("b", at(2))]
    changes = lambda *rows: spark.createDataFrame(rows, "event_id string, state string, at timestamp")
    assert store.append_status(spark, f"{tmp_path}/s", changes(("a", "created", at(0)), ("b", "approved", at(0)))).count() == 1
    assert store.append_status(spark, f"{tmp_path}/s", changes(("a", "pending", at(1)))).count() == 0
    assert [r.state for r in store.current_status(spark.read.parquet(f"{tmp_path}/s")).collect()] == ["pending"]
    reports = spark.createDataFrame([("r1", "a", at(0)), ("r2", "a", at(1)), ("r3", "zz", at(0))], "report_id string, event_id string, submitted_at timestamp")
    rejects = store.add_reports(spark, reports, events, f"{tmp_path}/r")
    assert {r.report_id: r.reason for r in rejects.collect()} == {"r2": "second_report", "r3": "unknown_event"}
    again = store.add_reports(spark, reports.where("report_id = 'r1'"), events, f"{tmp_path}/r")
    assert [r.reason for r in again.collect()] == ["second_report"]


def test_splits_keep_groups_together(spark):
    df = spark.createDataFrame([(n, None if n % 2 else f"v{n % 6}", None, f"l{n % 4}", None, None) for n in range(200)], "image_id int, video string, trip string, location string, session string, sequence string").withColumn("group_key", datasets.group_key())
    placed = df.join(datasets.assign_splits(df), "group_key")
    assert placed.count() == 200 and datasets.leakage(placed).count() == 0
    with pytest.raises(ValueError):
        datasets.split_of(F.lit("x"), {"train": 50})


def test_as_of_ties_and_before(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "z", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 5, 10, "old"), ("k", 5, 11, "new"), ("k", 3, 1, "x")], "k string, t int, n int, v string")
    got = joins.as_of(left, right, "k", "t", "t", ["v"], "id", "n").collect()
    assert {r.id: r.v for r in got} == {1: "new", 2: None, 3: None}


def test_near_hashes_and_points(spark):
    rng = np.random.default_rng(1)
    h = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)]
    h += [v ^ (1 << int(b)) ^ (1 << int(c)) for v, b, c in zip(h[:30], rng.integers(0, 60, 30), rng.integers(0, 60, 30))]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(h)] + [(900, h[0])], "k int, h long")
    got = {(r.a, r.b) for r in joins.near_hashes(df, "k", "h", 3).collect()}
    distinct = {v: n for n, v in reversed(list(enumerate(h)))}
    want = {(min(a, b), max(a, b)) for va, a in distinct.items() for vb, b in distinct.items() if a != b and bin((va ^ vb) & (2**64 - 1)).count("1") <= 3}
    assert got == want
    assert {r.member: r.representative for r in joins.members_of(df, "k", "h").collect()}[900] == 0


def test_suppression_and_greedy_matching(spark):
    pred = spark.createDataFrame([prediction(1, 0.9, (0, 0, 10, 10)), prediction(2, 0.8, (1, 0, 11, 10)), prediction(3, 0.7, (50, 0, 60, 10)), prediction(4, 0.9, (0, 0, 10, 10), frame=2)], PRED)
    assert sorted(r.pred_id for r in boxes_ops.suppress(pred).collect()) == [1, 3, 4]
    # The second prediction prefers the box that the first took, and falls back to its second best.
    truth = spark.createDataFrame([(1, 10, "a", 0, 0, 10, 10), (1, 11, "a", 3, 0, 13, 10)], TRUE)
    got = {r.pred_id: (r.gt_id, r.tp) for r in boxes_ops.greedy_match(pred, truth).collect()}
    assert got == {1: (10, 1), 2: (11, 1), 3: (None, 0), 4: (None, 0)}


def test_overlap_tracker():
    tracker = boxes_ops.OverlapTracker(0.3, 2.0)
    assert tracker.step(0.0, np.array([[0, 0, 10, 10], [50, 50, 60, 60]])) == [0, 1]
    assert tracker.step(1.0, np.array([[51, 50, 61, 60], [1, 0, 11, 10]])) == [1, 0]
    assert tracker.step(3.5, np.array([[1, 0, 11, 10]])) == [2]


def test_integrity_checks(spark):
    models = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "model_version_id string, is_active boolean")
    assert sorted(r.model_version_id for r in integrity.active_models(models).collect()) == ["a", "b"]
    assert integrity.active_models(models.where("model_version_id != 'a'")).count() == 0
    keys = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert sorted((str(r.k), r.rows) for r in integrity.duplicate_keys(keys, "k").collect()) == [("1", 2), ("None", 1)]


def test_manifest_ignores_row_order(spark):
    df = spark.createDataFrame([(n, f"t{n}", None if n % 3 else "x") for n in range(50)], "k int, a string, b string")
    one, two = (datasets.manifest(d, "k", ["a", "b"], "1").first() for d in (df, df.orderBy(F.desc("k")).repartition(7)))
    assert one == two and datasets.manifest(df.where("k > 0"), "k", ["a", "b"], "1").first() != one


def test_moves_of_one_batch_are_judged_in_order(spark):
    schema = "event_id string, state string, at int"
    stored = spark.createDataFrame([("a", "created", 1), ("a", "pending", 2), ("b", "created", 1)], schema)
    changes = spark.createDataFrame([("a", "approved", 3), ("a", "rejected", 4), ("a", "closed", 5), ("b", "pending", 3), ("b", "approved", 4), ("c", "pending", 1), ("c", "created", 2), (None, "created", 1), ("d", None, 1)], schema)
    got = {(r.event_id, r.state): (r.previous, r.legal) for r in store.judge_moves(changes, stored).collect()}
    assert got == {
        ("a", "approved"): ("pending", True), ("a", "rejected"): ("approved", False), ("a", "closed"): ("approved", True),
        ("b", "pending"): ("created", True), ("b", "approved"): ("pending", True),
        ("c", "pending"): (None, False), ("c", "created"): (None, True), (None, "created"): (None, False), ("d", None): (None, False),
    }


def test_moves_stay_together_when_the_join_turns_into_a_broadcast(spark):
    """As on large tables: planned as a sorted join, since rows of an RDD have no known size, and a broadcast once the stored side is known to be small."""
    states, schema = ["created", "pending", "approved", "closed"], "event_id string, state string, at int"
    rows = [(f"k{k}", states[n % 4], n) for n in range(8) for k in range(40)]
    changes = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), schema)
    stored = spark.createDataFrame([(f"k{k}", "created", -1) for k in range(0, 40, 2)], schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one task's
    try:
        got = {(r.event_id, r.at): (r.previous, r.legal) for r in store.judge_moves(changes, stored).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k in range(40):
        current = None if k % 2 else "created"
        for n in range(8):
            good = current is None if n == 0 else n < 4 and current == states[n - 1]
            want[f"k{k}", n] = (current, good)
            current = states[n] if good else current
    assert got == want


def test_suppression_leaves_rows_with_nulls_out_and_keeps_types(spark):
    rows = [(1, "f", "a", 0.9, 0, 0, 10, 10, 5), (2, "f", "a", 0.8, 1, 0, 11, 10, None), (3, "f", "a", 0.7, None, 0, 60, 10, 1), (4, None, "a", 0.9, 0, 0, 10, 10, 1), (5, "g", "a", 0.5, 0, 0, 10, 10, None), (6, "g", "a", 0.4, 50, 0, 60, 10, 7)]
    df = spark.createDataFrame(rows, "pred_id long, frame_id string, class string, confidence double, x1 int, y1 int, x2 int, y2 int, extra int")
    assert {(r.pred_id, r.extra) for r in boxes_ops.suppress(df).collect()} == {(1, 5), (5, None), (6, 7)}
    assert {(r.pred_id, r.reason) for r in boxes_ops.unsuppressed(df).collect()} == {(3, "missing_x1"), (4, "missing_frame_id")}
    assert boxes_ops.suppress(df.limit(0)).count() == 0


def test_report_status_moves(spark, tmp_path):
    changes = lambda *rows: spark.createDataFrame(rows, "report_id string, state string, at int")
    log = f"{tmp_path}/reports"
    assert store.append_status(spark, log, changes(("r", "pending", 1), ("s", "approved", 1)), "report", "report_id").select("report_id", "previous").collect() == [("s", None)]
    assert store.append_status(spark, log, changes(("r", "resolved", 3), ("r", "approved", 2), ("r", "pending", 4)), "report", "report_id").select("state", "previous").collect() == [("pending", "resolved")]
    assert sorted(r.state for r in spark.read.parquet(log).collect()) == ["approved", "pending", "resolved"]


def test_near_pairs_meet_once_and_are_never_broadcast(spark):
    rnd = random.Random(3)
    rows = [(n, rnd.randint(-60, 60), rnd.randint(-60, 60)) for n in rnd.sample(range(1000), 150)]
    pairs = joins.near_pairs(spark.createDataFrame(rows, "k long, x long, y long"), "k", "x", "y", 10)
    want = sorted((a, b, (ax - bx) ** 2 + (ay - by) ** 2) for a, ax, ay in rows for b, bx, by in rows if a < b and (ax - bx) ** 2 + (ay - by) ** 2 <= 100)
    assert sorted(map(tuple, pairs.collect())) == want and len(want) > 50
    small = spark.range(50).selectExpr("id as k", "id * 7 as x", "id * 3 as y")  # a size that Spark would broadcast
    near = joins.near_pairs(small, "k", "x", "y", 10)
    near.collect()
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
