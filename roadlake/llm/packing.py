"""Length buckets of least padding, and token-budget batches inside them.

The global histogram of text lengths decides the bucket boundaries: dynamic programming over its bins finds the
boundaries that pad least when every text is padded to the longest of its bucket. Texts of one bucket form batches of as
many rows as fit the token budget at the bucket's length. A bucket may hold most of all rows, so places in it come from
two levels: rows are dealt by a hash into groups, each group is ranked by itself, and the groups' counts give the
offsets.

Every length is a bin of its own, so the boundaries are the best there are. The driver holds 16 bytes for each distinct
length and 8 for each bucket besides: lengths repeat, so these are far fewer than the texts.

Defined results: a null or empty text has length 0 and pads to its bucket like any other; a text longer than the budget
is a batch of its own size's bucket, one row a batch; repeated rows all get places; null and repeated ids are dealt like
any other;
an empty table gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from array import array

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlake.llm.shared import Scratch, table

BUCKETS = 16
#: Tokens that a batch may hold, padding included.
TOKEN_BUDGET = 16_384
#: Rows of one ranked group of a bucket, on average.
GROUP_ROWS = 50_000


def n_words(text: Column) -> Column:
    """Runs of non-space characters: the length that texts are packed by unless the caller has token counts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def best_buckets(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper lengths, ascending, of at most ``buckets`` buckets with the least padding; of equal ones, fewer buckets.

    ``histogram`` has (length, rows), ascending. With the rows before bin i summed as N[i], a bucket of the bins i+1..j
    costs length[j] * (N[j] - N[i]), less the tokens themselves, which no choice changes. So a layer of the programme is
    least over i of cost[i] - length[j] * N[i]: lines whose slopes fall, asked at lengths that rise, so that a pointer
    over their lower envelope answers each layer in linear time.
    """
    lengths = [x for x, _ in histogram]
    before = [0]
    for _, rows in histogram:
        before.append(before[-1] + rows)
    n = len(lengths)
    if not n:
        return []
    cost: list[int | None] = [0] + [None] * n
    layers: list[array] = []
    best, best_layer = None, 0
    for layer in range(min(buckets, n)):
        hull: list[int] = []
        at, nxt, choice = 0, [None] * (n + 1), array("q", bytes(8 * (n + 1)))

        def useless(a: int, b: int, c: int, cost=cost) -> bool:
            """Whether line b is nowhere below both a and c (slopes -before fall from a to c)."""
            return (cost[c] - cost[a]) * (before[b] - before[a]) <= (cost[b] - cost[a]) * (before[c] - before[a])

        for j in range(1, n + 1):
            i = j - 1
            if cost[i] is not None:
                while len(hull) >= 2 and useless(hull[-2], hull[-1], i):
                    hull.pop()
                hull.append(i)
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            x = lengths[j - 1]
            while at + 1 < len(hull) and cost[hull[at + 1]] - x * before[hull[at + 1]] < cost[hull[at]] - x * before[hull[at]]:
                at += 1
            nxt[j], choice[j] = cost[hull[at]] + x * (before[j] - before[hull[at]]), hull[at]
        layers.append(choice)
        cost = nxt
        if nxt[n] is not None and (best is None or nxt[n] < best):
            best, best_layer = nxt[n], layer
    uppers, j = [], n
    for layer in range(best_layer, -1, -1):
        uppers.append(lengths[j - 1])
        j = layers[layer][j]
    return uppers[::-1]


def pack(spark: SparkSession, rows: DataFrame, id_col: str, length_col: str, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """id, n_tokens, bucket, bucket_len, batch (from 0 in each bucket), slot (place in the batch)."""
    scratch = Scratch(spark, "packing")
    # Rows are known by their places in this table, so that no id, null or repeated, makes a group large.
    held = scratch.cut(rows.select(F.col(id_col).alias("id"), F.col(length_col).cast("bigint").alias("n"), F.monotonically_increasing_id().alias("row")))
    bins = held.groupBy("n").agg(F.count("*").alias("rows")).toArrow()
    histogram = sorted(zip(bins["n"].to_pylist(), bins["rows"].to_pylist(), strict=True))
    total = sum(k for _, k in histogram)
    uppers = best_buckets(histogram, buckets)
    if not uppers:
        return held.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.lit(0).alias("bucket"), F.lit(0).cast("bigint").alias("bucket_len"), F.lit(0).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("slot"))
    bucket = F.lit(len(uppers) - 1)
    for k, upper in reversed(list(enumerate(uppers[:-1]))):
        bucket = F.when(F.col("n") <= upper, k).otherwise(bucket)
    groups = total // GROUP_ROWS + 1
    order = F.xxhash64("row")
    dealt = held.select("id", "n", bucket.alias("bucket"), order.alias("h"), F.pmod(order, F.lit(groups)).cast("int").alias("deal"))
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "deal").orderBy("h")))
    counts = dealt.groupBy("bucket", "deal").agg(F.count("*").alias("k"))
    first = counts.withColumn("first", F.coalesce(F.sum("k").over(Window.partitionBy("bucket").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    lengths = F.array(*[F.lit(u).cast("bigint") for u in uppers])
    place = F.col("first") + F.col("nth") - 1
    out = ranked.join(first, ["bucket", "deal"]).select(
        "id", "n", "bucket", F.get(lengths, F.col("bucket")).alias("bucket_len"), place.alias("place")
    ).withColumn("rows", F.greatest(F.lit(1).cast("bigint"), F.expr(f"{budget}L div greatest(bucket_len, 1L)")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "bucket", "bucket_len", F.expr("place div rows").alias("batch"), F.expr("place % rows").alias("slot"))


def pack_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    return pack(spark, docs.select(F.col(id_col), n_words(F.col(text_col)).alias("_n")), id_col, "_n", buckets, budget)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the best 16 buckets, by words."""
    return pack_texts(spark, table(spark, sf_dir, "documents"))
