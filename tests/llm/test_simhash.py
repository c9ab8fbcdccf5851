"""Fingerprints and components against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadlake.llm import simhash as S


def fingerprint(text, size=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, most=4):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def texts():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    out = [None, "", "One", "one", "A b c", "tab\tand\x0bfeed\x0c and\nline  two", "x\x1cy z"]
    for _ in range(25):
        words = rnd.choices(vocabulary, k=rnd.randint(1, 200))
        for _ in range(rnd.randint(1, 4)):
            out.append(" ".join(words))
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
    return out


def test_groups_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([*rows, (None, "one"), (3, "one")], "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    got = [(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in S.simhash_groups(spark, df).collect()]
    prints = {i: fingerprint(t) for i, t in rows}
    want = groups(prints)
    expected = [(i, prints[i], want[i]) for i, _ in rows] + [(None, prints[3], None), (3, prints[3], want[3])]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_groups(spark, df).count() == 0 and S.wide_groups(spark, df).count() == 0


def test_ring_keys_miss_no_pair():
    rnd = random.Random(5)
    for ring in (S.Ring(4, 6, 4), S.Ring(3, 4, 1), S.Ring(0, 1, 1)):
        for _ in range(3000):
            x = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, ring.t)))
            at = np.array([x], np.uint64)
            assert any(not x & m and ring.passes(at, k)[0] for k, m in enumerate(ring.key_masks))


@pytest.mark.parametrize("blocks", [1 << 14, 40])
def test_dense_ball_keeps_every_link(spark, monkeypatch, blocks):
    monkeypatch.setattr(S, "BLOCK", blocks)
    rnd = random.Random(7)
    centre = rnd.getrandbits(64)
    prints = {n: centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for n in range(400)}
    rows = [(n, f - 2**64 if f >= 2**63 else f) for n, f in prints.items()]
    given = spark.createDataFrame(rows, "id long, f0 long")
    monkeypatch.setattr(S, "fingerprints", lambda *_: given)
    got = {r.doc_id: r.component_id for r in S.simhash_groups(spark, spark.createDataFrame([], "doc_id long, text string")).collect()}
    assert got == groups(prints)


def jaccard(a, b):
    a, b = (set(S.shingles(t.encode(), 5)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_wide_groups_find_near_copies_and_leave_others(spark):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(2000)]
    rows, near = [], []
    for n in range(150):
        words = rnd.choices(vocabulary, k=rnd.randint(150, 500))
        rows.append((2 * n, " ".join(words)))
        for at in rnd.sample(range(len(words)), 1 + n % 5):
            words[at] = rnd.choice(vocabulary)
        if n % 3:
            rows.append((2 * n + 1, " ".join(words)))
            near.append((2 * n, 2 * n + 1, jaccard(rows[-2][1], rows[-1][1])))
    got = {r.doc_id: r.component_id for r in S.wide_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    clear = [(a, b) for a, b, j in near if j >= 0.85]
    assert sum(got[a] == got[b] for a, b in clear) >= 0.98 * len(clear)
    assert all(got[i] in (i, i - 1) and got[i] // 2 == i // 2 for i in got)
