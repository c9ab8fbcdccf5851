"""Detection metrics.

Matching: every prediction takes its best ground truth of its frame and class (highest IoU, then least id). Among the
predictions that reach the threshold with one box, the most confident (then least id) is a true positive and the rest
are false. Precision, recall and F1 are null where they would divide 0 by 0; AP is null without ground truth. AP is the
area under the precision-recall curve with the precision envelope, over all points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions import boxes, scalar
from roadlake.functions.boxes import Box
from roadlake.session import written

LADDER = list(range(50, 100, 5))
_P, _G = Box.prefixed("p_"), Box.prefixed("g_")


def pairs(predictions: DataFrame, truths: DataFrame, keys: list[str] = ("frame_id", "class")) -> DataFrame:
    """Predictions with every ground truth of their frame and class, with the areas that give IoU. A left join: predictions without any stay."""
    p = predictions.select(*keys, "pred_id", "confidence", *[F.col(c).alias("p_" + c) for c in ("x1", "y1", "x2", "y2")])
    g = truths.select(*keys, "gt_id", *[F.col(c).alias("g_" + c) for c in ("x1", "y1", "x2", "y2")])
    both = p.join(g, list(keys), "left")
    return both.select(*keys, "pred_id", "confidence", "gt_id", boxes.intersection(_P, _G).alias("inter"), boxes.union_area(_P, _G).alias("uni"))


def best_truth(scored: DataFrame, keys: list[str] = ("frame_id", "class")) -> DataFrame:
    """One row for each prediction: its best ground truth, if any."""
    w = Window.partitionBy(*keys, "pred_id").orderBy(F.desc_nulls_last(scalar.ratio(F.col("inter"), F.col("uni"))), F.asc_nulls_last("gt_id"))
    return scored.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def claims(best: DataFrame, thresholds: list[int], keys: list[str] = ("frame_id", "class")) -> DataFrame:
    """Adds, for each prediction, ``reach``, the highest threshold (percent) that its IoU meets, and ``before``, the
    highest that a more confident prediction of the same box meets. It is a true positive at t just if before < t <= reach,
    so one window on each box's few claims serves all thresholds."""
    meets = [F.when(F.col("inter") * 100 >= t * F.col("uni"), t).otherwise(0) for t in sorted(thresholds)]
    reach = F.coalesce(F.when(F.col("gt_id").isNotNull(), F.greatest(*meets, F.lit(0))), F.lit(0))
    w = Window.partitionBy(*keys, "gt_id").orderBy(F.desc("confidence"), "pred_id").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("reach", reach).withColumn("before", F.coalesce(F.max("reach").over(w), F.lit(0)))


def judge(claimed: DataFrame, thresholds: list[int]) -> DataFrame:
    """A row for each prediction and threshold, with hit (the box it claims, if any) and tp 1 or 0."""
    each = claimed.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    met = F.col("reach") >= F.col("threshold")
    return each.withColumns({"hit": F.when(met, F.col("gt_id")), "tp": (met & (F.col("before") < F.col("threshold"))).cast("int")}).drop("reach", "before")


def precision_recall_f1(judged: DataFrame, truths: DataFrame, by: list[str], least_confidence: float = 0.5) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of each group and threshold, for predictions that are sure enough."""
    found = judged.where(F.col("confidence") >= least_confidence).groupBy(*by, "threshold").agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))
    total = truths.groupBy(*by).agg(F.count("*").alias("n_truths")) if by else truths.agg(F.count("*").alias("n_truths"))
    thresholds = judged.select("threshold").distinct()  # as many rows as thresholds
    frame = total.crossJoin(F.broadcast(thresholds))
    out = frame.join(found, [*by, "threshold"], "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tp", "n", "n_truths")})
    p, r = scalar.ratio(F.col("tp"), F.col("n")), scalar.ratio(F.col("tp"), F.col("n_truths"))
    return out.select(*by, "threshold", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("n_truths") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), scalar.f1(p, r).alias("f1"))


#: Steps of confidence by which long lines of predictions are cut into windows of their own.
STEPS = 1024


def _step():
    """0 for the most confident step."""
    return (F.lit(STEPS) - F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))) * STEPS)).cast("int")


def _running(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """Adds each row's place (from 1) by falling confidence, then id, in its group. Steps of confidence are numbered by
    themselves and moved by the counts of the steps before, so no group is one task's window."""
    rows = rows.withColumn("_step", _step())
    counts = rows.groupBy(*by, "_step").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)  # at most STEPS rows
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*by, "_step").orderBy(F.desc("confidence"), "pred_id")
    return rows.withColumn("_nth", F.row_number().over(within)).join(base, [*by, "_step"]).withColumn(out, F.col("_base") + F.col("_nth")).drop("_base", "_nth", "_step")


def _area(tps: DataFrame, by: list[str]) -> DataFrame:
    """Sum over true positives (with ``rank``) of the best precision at their recall or beyond: a suffix maximum, taken
    in each step of confidence from its far end, and over the steps beyond."""
    line = _running(tps, by, "hits").withColumns({"p": F.col("hits") / F.col("rank"), "_step": _step()})
    steps = line.groupBy(*by, "_step").agg(F.max("p").alias("_best"))
    beyond = Window.partitionBy(*by).orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)  # at most STEPS rows
    later = steps.withColumn("_later", F.coalesce(F.max("_best").over(beyond), F.lit(0.0))).drop("_best")
    within = Window.partitionBy(*by, "_step").orderBy(F.asc("confidence"), F.desc("pred_id")).rowsBetween(Window.unboundedPreceding, 0)
    hull = line.withColumn("_here", F.max("p").over(within)).join(later, [*by, "_step"])
    return hull.groupBy(*by).agg(F.sum(F.greatest("_here", "_later")).alias("area"))


def _per_truth(area: DataFrame, truths: DataFrame, by: list[str], thresholds: list[int]) -> DataFrame:
    total = truths.groupBy(*by).agg(F.count("*").alias("n_truths"))
    frame = total.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return frame.join(area, [*by, "threshold"], "left").select(*by, "threshold", "n_truths", (F.coalesce("area", F.lit(0.0)) / F.col("n_truths")).alias("ap"))


def average_precision(claimed: DataFrame, truths: DataFrame, thresholds: list[int] = LADDER, by: list[str] = ("class",)) -> DataFrame:
    """ap of each group and threshold.

    One window counts a step of confidence's hits at all thresholds, and the steps before move them; a second one, from
    the step's far end, takes the best precision at each hit's recall or beyond. Rows are never multiplied by thresholds.
    """
    by, steps = list(by), [*by, "_step"]
    tp = {t: (F.col("before") < t) & (F.col("reach") >= t) for t in thresholds}
    down = Window.partitionBy(*steps).orderBy(F.desc("confidence"), "pred_id")
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    rows = claimed.select(*by, "pred_id", "confidence", "reach", "before").withColumn("_step", _step())
    # Three branches read these: written once, the matching below is computed once.
    line = written(rows.withColumns({"_nth": F.row_number().over(down), **{f"_h{t}": F.sum(c.cast("int")).over(upto) for t, c in tp.items()}}))
    counts = line.groupBy(*steps).agg(F.max("_nth").alias("_nth"), *[F.max(f"_h{t}").alias(f"_h{t}") for t in tp])
    earlier = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)  # at most STEPS rows
    base = counts.select(*steps, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias("_before" + c) for c in ("_nth", *(f"_h{t}" for t in tp))])
    placed = line.join(base, steps).withColumns({f"_p{t}": F.when(c, (F.col(f"_before_h{t}") + F.col(f"_h{t}")) / (F.col("_before_nth") + F.col("_nth"))) for t, c in tp.items()})
    best = placed.groupBy(*steps).agg(*[F.max(f"_p{t}").alias(f"_best{t}") for t in tp])
    beyond = Window.partitionBy(*by).orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)  # at most STEPS rows
    later = best.select(*steps, *[F.coalesce(F.max(f"_best{t}").over(beyond), F.lit(0.0)).alias(f"_later{t}") for t in tp])
    up = Window.partitionBy(*steps).orderBy(F.asc("confidence"), F.desc("pred_id")).rowsBetween(Window.unboundedPreceding, 0)
    hull = placed.select(*steps, *[F.col(f"_p{t}") for t in tp], *[F.max(f"_p{t}").over(up).alias(f"_here{t}") for t in tp]).join(later, steps)
    areas = hull.groupBy(*by).agg(*[F.sum(F.when(F.col(f"_p{t}").isNotNull(), F.greatest(f"_here{t}", f"_later{t}"))).alias(f"_a{t}") for t in tp])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_a{t}").alias("area")) for t in tp]))
    return _per_truth(areas.select(*by, each.alias("_t")).select(*by, "_t.threshold", "_t.area"), truths, by, thresholds)


def average_precision_101(claimed: DataFrame, truths: DataFrame, thresholds: list[int] = LADDER, by: list[str] = ("class",)) -> DataFrame:
    """AP by interpolation at recalls 0, 0.01, ... 1: the mean of the best precision at that recall or beyond."""
    by = list(by)
    ranked = _running(claimed.select(*by, "pred_id", "confidence", "reach", "before"), by, "rank").where("reach > before")
    tps = ranked.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: (t <= F.col("reach")) & (t > F.col("before")))))
    group = [*by, "threshold"]
    total = truths.groupBy(*by).agg(F.count("*").alias("n_truths"))
    # The hit that takes recall to k / n serves the recalls from there down to the one before: keep each step's best.
    hits = _running(tps, group, "hits").join(total, by).withColumn("step", F.floor(F.col("hits") * 100 / F.col("n_truths")).cast("int"))
    steps = hits.groupBy(*group, "step").agg(F.max(F.col("hits") / F.col("rank")).alias("p"))
    grid = total.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(100))))
    up = Window.partitionBy(*group).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    hull = grid.join(steps, [*group, "step"], "left").withColumn("p", F.coalesce(F.max("p").over(up), F.lit(0.0)))
    return hull.groupBy(*group).agg(F.avg("p").alias("ap"))


def mean_ap(ap: DataFrame, by: list[str] = ()) -> DataFrame:
    """map50, map75 and map50_95: means over classes, and over the ladder's thresholds."""
    per = ap.groupBy(*by, "threshold").agg(F.avg("ap").alias("m"))
    return per.groupBy(*by).agg(*[F.max(F.when(F.col("threshold") == t, F.col("m"))).alias(f"map{t}") for t in (50, 75)], F.avg("m").alias("map50_95"))


def by_size(predictions: DataFrame, truths: DataFrame, small: int, large: int, thresholds: list[int]) -> DataFrame:
    """AP by size category: a prediction counts under the size of the box it claims, or under its own if it claims none."""
    cut = lambda a: boxes.size_category(a, F.lit(small), F.lit(large))
    sized = truths.withColumn("size", cut(boxes.area()))
    judged = judge(claims(best_truth(pairs(predictions, truths)), thresholds), thresholds)
    own = predictions.select("pred_id", cut(boxes.area()).alias("own_size"))
    placed = judged.join(sized.select(F.col("gt_id").alias("hit"), F.col("size").alias("hit_size")), "hit", "left").join(own, "pred_id").withColumn("size", F.coalesce("hit_size", "own_size"))
    group = ["class", "size", "threshold"]
    ranked = written(_running(written(placed.select(*group, "pred_id", "confidence", "tp")), group, "rank").where("tp = 1"))
    return _per_truth(_area(ranked, group), sized, ["class", "size"], thresholds)


def pareto(models: DataFrame, higher: list[str], key: str) -> DataFrame:
    """Models that no other beats or equals everywhere and beats somewhere. No single metric ranks them. Models with the same metrics meet once."""
    a, b = models.alias("a"), models.select(*[F.col(c).alias("o_" + c) for c in higher]).distinct()
    no_worse, better = F.lit(True), F.lit(False)
    for c in higher:
        no_worse, better = no_worse & (F.col("o_" + c) >= F.col(c)), better | (F.col("o_" + c) > F.col(c))
    return a.join(b, no_worse & better, "left_anti")


def comparable(experiments: DataFrame, fixed: list[str], key: str = "comparison") -> DataFrame:
    """Comparisons whose experiments differ in something that must be the same; empty means comparable."""
    return experiments.groupBy(key).agg(*[F.countDistinct(c).alias(c) for c in fixed]).where(" or ".join(f"{c} > 1" for c in fixed))


def baseline_delta(experiments: DataFrame, metrics: list[str], key: str = "comparison", order: str = "started_at", run: str = "experiment_id") -> DataFrame:
    """Each run's difference to the first run of its comparison."""
    w = Window.partitionBy(key).orderBy(order, run)
    return experiments.withColumns({f"{m}_delta": F.col(m) - F.first(m).over(w) for m in metrics})
