"""Balanced shards by sampled splitters.

A size-weighted sample of keys gives quantile boundaries, FINE to a shard; records are range-partitioned by them, and a
range that turns out overfull is divided by boundaries sampled inside it, until none is. A shard is a set of whole
ranges: the splitters alone decide what goes where. The key is the first 60 bits of the text's SHA-256, so equal texts
fall between the same splitters; only a group of copies heavier than a shard is divided, by splitters among its ids.
Groups heavier than a range go first, the heaviest to the emptiest shard; all other ranges fill the room that is left,
in key order. So shards differ by about a range's bytes, unless fewer groups than that make up the data.

The driver holds the sample and a row for each range: both are bounded by the number of shards, never by the records.
Only ids, sizes and hashes are shuffled, never texts.

Defined results: a null text counts as empty; null ids sort first; repeated rows each get a slot of their own (which of
them gets which is not defined); an empty table gives no rows; other columns are not read, so their names can't clash.
The same rows get the same shards however they are partitioned, but for null ids. Rows that share an id and a text go
to one shard, whatever they weigh.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from roadlake.llm.shared import Scratch

#: Bytes that a record needs besides its text.
RECORD_OVERHEAD = 16
#: Ranges for each shard, fewer where that gave more than MAX_RANGES in all.
FINE, MAX_RANGES = 64, 100_000
#: Sampled keys for each range.
SAMPLES_PER_RANGE = 12
#: A range with more bytes than this many times its share is divided, if it has two keys or is heavier than a shard.
OVERFULL = 2
#: Rounds of dividing; a range that is overfull after them makes its shard heavier, not wrong.
ROUNDS = 8
#: Rows of a range whose slots one task numbers, on average.
RANKED_ROWS = 50_000

_LOWEST = -(1 << 63)


def _sample(rows: DataFrame, share) -> dict[int, list[tuple[int, int, float]]]:
    """By range: (key, tie, weight) of a Poisson sample with chances ``share``, sorted; retries draw the same rows."""
    draw = F.xxhash64("key", "tie", F.lit("draw")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    drawn = rows.where(draw < share).select("range", "key", "tie", F.greatest(share, F.lit(1.0)).alias("share"))
    found = defaultdict(list)
    for r in drawn.collect():  # about SAMPLES_PER_RANGE rows a range, by the chances above
        found[r[0]].append((r[1], r[2], r[3]))
    return {k: sorted(v) for k, v in found.items()}


def _quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    total, upto, found = sum(s for *_, s in sample), 0.0, []
    for key, tie, share in sample:
        before, upto = upto, upto + share
        if int(before * parts / total) != int(upto * parts / total) and upto < total:
            found.append((key, tie))
    return found


def _place(cuts: list[tuple[int, int]]):
    """For mapInArrow: adds ``range``, the number of boundaries at or below (key, tie)."""
    keys = np.array([k for k, _ in cuts], np.int64)
    ties = np.array([t for _, t in cuts], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, tie = (b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "tie"))
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            at = lo.astype(np.int32)
            for first in np.unique(lo[lo < hi]):  # boundaries that share this row's key: the tie decides
                rows = (lo == first) & (hi > first)
                upto = int(hi[rows][0])
                at[rows] = first + np.searchsorted(ties[first:upto], tie[rows], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "range"])

    return run


def _divided(ranges: list, sample: dict[int, list[tuple[int, int, float]]], pieces: dict[int, int]) -> set[tuple[int, int]]:
    """Boundaries inside overfull ranges. Between keys a boundary comes before a key and after it, so that a heavy group gets a range of its own."""
    found: set[tuple[int, int]] = set()
    for r in ranges:
        for key, tie in _quantiles(sample.get(r.range, []), pieces[r.range]):
            found.update({(key, _LOWEST), (key + 1, _LOWEST)} if r.low < r.high else {(key, tie)})
    return found


def _assigned(ranges: list, shards: int, most: float) -> dict[int, int]:
    """The shard of each range."""
    out: dict[int, int] = {}
    loads = [(0, s) for s in range(shards)]
    for r in sorted((r for r in ranges if r.bytes > most), key=lambda r: (-r.bytes, r.range)):
        load, shard = heapq.heappop(loads)
        out[r.range] = shard
        heapq.heappush(loads, (load + r.bytes, shard))
    light = sorted((r for r in ranges if r.range not in out), key=lambda r: r.range)
    rest, load = sum(r.bytes for r in light), {s: n for n, s in loads}
    # The level up to which shards are filled: what is above it holds heavy groups alone.
    level, upto = 0.0, 0
    for n, taken in enumerate(sorted(load.values()), 1):
        upto += taken
        if n == shards or (rest + upto) / n <= sorted(load.values())[n]:
            level = (rest + upto) / n
            break
    room = np.cumsum([max(0.0, level - load[s]) for s in range(shards)])
    at = 0
    for r in light:
        middle = (at + r.bytes / 2) * room[-1] / max(1, rest)
        out[r.range] = min(int(np.searchsorted(room, middle, "right")), shards - 1)
        at += r.bytes
    return out


def balanced_shards(spark: SparkSession, docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard)."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    scratch = Scratch(spark, "shards")
    raw = F.coalesce(F.col(text_col), F.lit(""))
    integral = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    nameless = F.monotonically_increasing_id() + F.lit(_LOWEST)  # null ids are told apart by their places, so that even their copies can be divided
    tie = F.coalesce(F.col(id_col).cast("long"), nameless) if integral else F.when(F.col(id_col).isNull(), nameless).otherwise(F.xxhash64(id_col))
    rows = scratch.cut(
        docs.select(
            F.col(id_col).alias("id"),
            tie.alias("tie"),
            F.conv(F.substring(F.sha2(raw, 256), 1, 15), 16, 10).cast("long").alias("key"),
            (F.octet_length(raw) + RECORD_OVERHEAD).cast("long").alias("size"),
            F.crc32(raw.cast("binary")).alias("crc"),
        )
    )
    schema = StructType([*rows.schema, StructField("range", IntegerType())])
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ideal = max(1, total) / shards
    parts = max(1, min(shards * FINE, MAX_RANGES))
    most = OVERFULL * max(1, total) / parts
    first = _sample(rows.withColumn("range", F.lit(0)), F.col("size") * F.lit(parts * SAMPLES_PER_RANGE / max(1, total)))
    cuts = sorted({(key, _LOWEST) for key, _ in _quantiles(first.get(0, []), parts)})
    for round_ in range(ROUNDS + 1):
        placed = rows.mapInArrow(_place(cuts), schema) if cuts else rows.withColumn("range", F.lit(0))
        sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
        ranges = sums.collect()  # a row for each range
        over = [r for r in ranges if r.bytes > most and (r.low < r.high or r.bytes > ideal)]
        if not over or round_ == ROUNDS:
            break
        pieces = {r.range: int(OVERFULL * r.bytes / most) + 1 for r in over}
        shares = spark.createDataFrame([(r.range, pieces[r.range] * SAMPLES_PER_RANGE / r.bytes) for r in over], "range int, share double")
        inside = placed.join(F.broadcast(shares), "range")
        more = _divided(over, _sample(inside, F.col("size") * F.col("share")), pieces) - set(cuts)
        if not more:
            break
        cuts = sorted({*cuts, *more})
    if not ranges:
        return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    shard_of = _assigned(ranges, shards, most)
    plan = spark.createDataFrame([(r.range, shard_of[r.range], r.rows // RANKED_ROWS + 1) for r in ranges], "range int, shard int, deals long")
    dealt = placed.join(F.broadcast(plan), "range").select("id", "tie", "key", "size", "crc", "shard", "range", F.pmod(F.xxhash64("tie", "key"), F.col("deals")).alias("deal"))
    lined = scratch.cut(dealt.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "range", "deal").orderBy("key", "tie"))))
    counts = lined.groupBy("shard", "range", "deal").agg(F.count("*").alias("k"))
    before = Window.partitionBy("shard").orderBy("range", "deal").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "range", "deal", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    return lined.join(firsts, ["shard", "range", "deal"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return balanced_shards(spark, docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
