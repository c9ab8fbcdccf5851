"""The law of equal bytes, whole groups and gapless slots, counted by brute force from the rows."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from roadlake.llm import sharding as S


def corpus(seed=3, hot_every=3):
    rnd = random.Random(seed)
    hot = "hot " * 30
    rows = [(1, None), (2, ""), (3, "x" * 5_000)]
    rows += [(n + 10, hot if n % hot_every == 0 else "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 300)))) for n in range(2000)]
    rnd.shuffle(rows)
    return rows


def held(rows, got, shards):
    """Checks what holds by definition; the shards' bytes."""
    sized = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(sized, key=str)
    slots, loads = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return [loads[s] for s in range(shards)]


@pytest.mark.parametrize("hot_every,most", [(3, S.MAX_RANGES), (50, S.MAX_RANGES), (3, 200)])
def test_bytes_are_near_equal_and_groups_whole(spark, monkeypatch, hot_every, most):
    monkeypatch.setattr(S, "MAX_RANGES", most)
    rows, shards = corpus(hot_every=hot_every), 12
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    got = S.balanced_shards(spark, df, shards).collect()
    loads = held(rows, got, shards)
    ideal = sum(loads) / shards
    assert max(loads) - min(loads) <= max(0.1 * ideal, 2 * S.OVERFULL * sum(loads) / min(shards * S.FINE, most) + 5_016)
    of, texts = defaultdict(set), {i: t or "" for i, t in rows}
    weights = Counter()
    for r in got:
        of[texts[r.doc_id]].add(r.shard)
        weights[texts[r.doc_id]] += r.size
    assert all(len(of[t]) == 1 for t in of if weights[t] <= ideal)


def test_the_same_rows_get_the_same_shards_however_they_are_partitioned(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    one, two = (sorted(map(tuple, S.balanced_shards(spark, df.repartition(n), 7).collect())) for n in (1, 9))
    assert one == two


def test_groups_lighter_than_a_shard_stay_whole(spark):
    rows = [(n, f"text {n % 100} " * 5) for n in range(400)]
    got = S.balanced_shards(spark, spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    held(rows, got, 40)
    shards = {r.doc_id: r.shard for r in got}
    assert all(len({shards[n + 100 * k] for k in range(4)}) == 1 for n in range(100))
    assert sorted(Counter(Counter(shards.values()).values())) == [8, 12]  # two or three groups to a shard


def test_sampled_splitters_decide_at_every_size(spark, monkeypatch):
    """Without splitters all rows are one range, and so one shard."""
    rows = [(n, f"text {n}") for n in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r.shard for r in S.balanced_shards(spark, df, 5).collect()}) == 5
    monkeypatch.setattr(S, "_quantiles", lambda sample, parts: [])
    assert len({r.shard for r in S.balanced_shards(spark, df, 5).collect()}) == 1


def test_repeated_null_and_text_ids(spark):
    rows = [(None, "a"), (None, "a"), (4, "b"), (4, "b")]
    got = S.balanced_shards(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert held(rows, got, 2) == [34, 34]
    same = [(None, "a")] * 30
    assert held(same, S.balanced_shards(spark, spark.createDataFrame(same, "doc_id long, text string"), 2).collect(), 2) == [255, 255]
    named = spark.createDataFrame([("x", "a"), ("y", "b")], "doc_id string, text string")
    assert sorted(r.doc_id for r in S.balanced_shards(spark, named, 2).collect()) == ["x", "y"]
    empty = S.balanced_shards(spark, named.limit(0), 2)
    assert empty.count() == 0 and empty.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
