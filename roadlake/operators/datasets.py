"""Dataset preparation: duplicates, groups, splits, balance, versions and acceptance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.contracts import GROUP_KEYS

#: Percent of groups in each split.
SHARES = {"train": 70, "val": 15, "test": 15}


def combine(*parts: DataFrame) -> DataFrame:
    """Normalised candidate datasets as one; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def duplicate_groups(df: DataFrame, checksum: str, key: str) -> DataFrame:
    """(checksum, copies, first) of contents that occur more than once."""
    return df.groupBy(checksum).agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")


def deduplicated(df: DataFrame, checksum: str, key: str) -> DataFrame:
    """The row with the least key of each content: an aggregate of ids, so a heavy content stays one row a task."""
    first = df.groupBy(checksum).agg(F.min(key).alias(key)).select(key)
    return df.join(first, key, "left_semi")


def group_key(keys: list[str] = GROUP_KEYS) -> Column:
    """The coarsest group that is known: a sample's leakage group."""
    return F.coalesce(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(k + ":"), F.col(k).cast("string"))) for k in keys])


def split_of(group: Column, shares: dict[str, int] = SHARES) -> Column:
    """A group's split by hash: the same on every run and for every sample of the group."""
    if sum(shares.values()) != 100:
        raise ValueError("shares must sum to 100")
    place = F.pmod(F.conv(F.substring(F.sha2(group, 256), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    out, upto = F.lit(None).cast("string"), 0
    cuts = []
    for name, share in shares.items():
        upto += share
        cuts.append((upto, name))
    for upto, name in reversed(cuts):
        out = F.when(place < upto, name).otherwise(out)
    return out


def assign_splits(groups: DataFrame, group: str = "group_key", shares: dict[str, int] = SHARES) -> DataFrame:
    """(group, split) of each distinct group."""
    return groups.select(group).where(F.col(group).isNotNull()).distinct().withColumn("split", split_of(F.col(group), shares))


def leakage(samples: DataFrame, group: str = "group_key", split: str = "split") -> DataFrame:
    """Groups in several splits; empty means none leak."""
    return samples.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def disjoint(a: DataFrame, b: DataFrame, group: str = "group_key") -> DataFrame:
    """Groups that two splits share."""
    return a.select(group).intersect(b.select(group))


def split_distribution(samples: DataFrame, by: str, values: list, split: str = "split") -> DataFrame:
    """Samples of each split by class, a column each, and how many groups and samples it has."""
    counts = samples.groupBy(split).pivot(by, values).count().na.fill(0)
    totals = samples.groupBy(split).agg(F.count("*").alias("samples"), F.countDistinct("group_key").alias("groups"))
    return counts.join(totals, split)


def class_balance(df: DataFrame, column: str = "class", least_share: float = 0.05) -> DataFrame:
    """Count and share of each class, and whether it falls below ``least_share``."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    share = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).select(column, "n", share.alias("share"), (share < least_share).alias("imbalanced"))


def area_percentiles(df: DataFrame, area: Column, at: list[float]) -> DataFrame:
    """Exact percentiles of box areas, from which size cuts are taken."""
    return df.agg(*[F.percentile(area, p).alias(f"p{round(100 * p)}") for p in at])


def manifest(df: DataFrame, key: str, content: list[str], version: str) -> DataFrame:
    """One row: version, rows and a checksum that no order of rows changes."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in (key, *content)]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum")).withColumn("version", F.lit(version))


def version_bump(old: DataFrame, new: DataFrame, parts: list[str]) -> DataFrame:
    """Which parts of a manifest changed, and whether a new version is due. One row."""
    o = old.select(*[F.col(c).alias("o_" + c) for c in parts])
    changed = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col("o_" + c)), c) for c in parts]), lambda c: c.isNotNull())
    return new.crossJoin(F.broadcast(o)).select(changed.alias("changed")).withColumn("bump", F.size("changed") > 0)


def acceptance(checks: dict[str, DataFrame]) -> DataFrame:
    """(criterion, violations, accepted): each check returns its violating rows."""
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("criterion"), "violations") for name, df in checks.items()]
    return reduce(DataFrame.union, rows).withColumn("accepted", F.col("violations") == 0)


def taxonomy(errors: DataFrame, column: str, known: list[str], other: str = "other") -> DataFrame:
    """Counts of each error class, 0 for those without; what is unknown counts as ``other``."""
    session = errors.sparkSession
    name = F.when(F.col(column).isin(known), F.col(column)).otherwise(other)
    frame = session.createDataFrame([(k,) for k in dict.fromkeys([*known, other])], f"{column} string")
    counts = errors.select(name.alias(column)).groupBy(column).agg(F.count("*").alias("n"))
    return frame.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def generalization(judged: DataFrame, level: str, within: str) -> DataFrame:
    """tp and n of each domain, each level and all: a rollup."""
    return judged.rollup(level, within).agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))


def runtime_rollup(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median and 95th percentile of the end-to-end latency, its parts' means, frames a second and peak memory."""
    total = F.col("preprocess_ms") + F.col("forward_ms") + F.col("postprocess_ms")
    runs = runs.withColumn("total_ms", total)
    return runs.groupBy(*by).agg(
        F.count("*").alias("frames"), *[F.avg(c).alias(f"avg_{c}") for c in ("preprocess_ms", "forward_ms", "postprocess_ms", "total_ms")],
        F.percentile("total_ms", 0.5).alias("p50_total_ms"), F.percentile("total_ms", 0.95).alias("p95_total_ms"), (F.lit(1000.0) / F.avg("total_ms")).alias("fps"), F.max("memory_mb").alias("peak_memory_mb"), F.avg("utilization").alias("avg_utilization"),
    )


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two annotators' agreement by class: mean best IoU of the first's boxes, over (sum of best IoU, boxes)."""
    from roadlake.operators import metrics

    best = metrics.best_truth(metrics.pairs(a, b)).withColumn("iou", F.coalesce(F.try_divide(F.col("inter").cast("double"), F.col("uni").cast("double")), F.lit(0.0)))
    return best.groupBy("class").agg(F.count("*").alias("boxes"), F.avg("iou").alias("mean_iou"))


def newest_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """A page of the newest rows: per-partition top n, then one merge of n rows a partition."""
    return df.orderBy(*order).limit(n)


def ntiles(df: DataFrame, value: str, key: str, n: int = 3) -> DataFrame:
    """The other way to size classes: equal counts by rank. A single ordered line; prefer percentiles."""
    return df.withColumn("tile", F.ntile(n).over(Window.orderBy(value, key)))
