"""Bucket boundaries against every choice of boundaries, and the batches' invariants."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from roadlake.llm import packing as P


def padded(histogram, uppers):
    return sum(next(u for u in uppers if u >= n) * k for n, k in histogram)


@pytest.mark.parametrize("seed", range(25))
def test_boundaries_pad_least(seed):
    rnd = random.Random(seed)
    histogram = sorted((n, rnd.choice([1, 1, 2, 50, 1000])) for n in rnd.sample(range(0, 60), rnd.randint(1, 11)))
    lengths = [n for n, _ in histogram]
    for buckets in (1, 2, 3, 5, 20):
        got = P.best_buckets(histogram, buckets)
        choices = [(*c, lengths[-1]) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k)]
        assert len(got) <= buckets and got[-1] == lengths[-1] and got == sorted(set(got))
        assert padded(histogram, got) == min(padded(histogram, c) for c in choices)


def check(rows, lengths, buckets, budget):
    histogram = sorted(Counter(lengths).items())
    assert sorted(r.n_tokens for r in rows) == sorted(lengths)
    uppers = sorted({(r.bucket, r.bucket_len) for r in rows})
    assert [u for _, u in uppers] == P.best_buckets(histogram, buckets)
    batches = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bucket_len and (r.bucket == 0 or r.n_tokens > uppers[r.bucket - 1][1])
        batches[r.bucket, r.bucket_len, r.batch].append(r.slot)
    for (b, length, n), slots in batches.items():
        most = max(1, budget // max(1, length))
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= most
        assert len(slots) == most or (b, length, n + 1) not in batches  # only a bucket's last batch is short
        assert n == 0 or (b, length, n - 1) in batches


@pytest.mark.parametrize("group", [P.GROUP_ROWS, 7])
def test_batches(spark, monkeypatch, group):
    monkeypatch.setattr(P, "GROUP_ROWS", group)
    rnd = random.Random(1)
    lengths = [0, 0, 5000, *[rnd.choice([3, 3, 3, rnd.randint(1, 90)]) for _ in range(400)]]
    texts = [(n % 390 if n % 50 else None, None if not k and n else "w\t" * k) for n, k in enumerate(lengths)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("bucket", F.lit("clash")).withColumn("n", F.lit("x"))
    check(P.pack_texts(spark, df, buckets=6, budget=200).collect(), lengths, 6, 200)


@pytest.mark.parametrize("buckets,uppers", [(9, [1, 70_001, 70_002, 70_003, 1 << 40, (1 << 40) + 5]), (3, [1, 70_003, (1 << 40) + 5])])
def test_very_long_lengths_are_told_apart(spark, buckets, uppers):
    lengths = [1, 70_001, 70_001, 70_002, 70_003, 1 << 40, (1 << 40) + 5]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, k long")
    rows = P.pack(spark, df, "doc_id", "k", buckets, 100).collect()
    assert sorted({r.bucket_len for r in rows}) == uppers
    check(rows, lengths, buckets, 100)


def test_rows_of_one_id_are_dealt_apart(spark, monkeypatch):
    """A third of all rows have no id, and a third have one: no ranked group holds either third."""
    monkeypatch.setattr(P, "GROUP_ROWS", 20)
    seen = []
    original = P.Window.partitionBy
    monkeypatch.setattr(P.Window, "partitionBy", staticmethod(lambda *c: seen.append(c) or original(*c)))
    lengths = [5] * 900
    df = spark.createDataFrame([(None if n % 3 == 0 else 7 if n % 3 == 1 else n, 5) for n in range(900)], "doc_id long, k long")
    rows = P.pack(spark, df, "doc_id", "k", 2, 50).collect()
    check(rows, lengths, 2, 50)
    held = P.Scratch.cut
    deals = df.withColumn("row", F.monotonically_increasing_id()).groupBy(F.pmod(F.xxhash64("row"), F.lit(900 // 20 + 1))).count().agg(F.max("count")).first()[0]
    assert ("bucket", "deal") in seen and held and deals < 60


def test_empty_table(spark):
    found = P.pack_texts(spark, spark.createDataFrame([], "doc_id long, text string"))
    assert found.count() == 0 and found.columns == ["doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot"]
