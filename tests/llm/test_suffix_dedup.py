"""Removed bytes against a dictionary of every 50-byte string, and the suffix sort against sorted()."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlake.llm import suffix_dedup as D


def brute(rows, length=50):
    low = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, x in texts:
        if i is not None:
            for p in range(len(x) - length + 1):
                low[x[p : p + length]] = min(i, low.get(x[p : p + length], i))
    out = []
    for i, x in texts:
        gone = bytearray(len(x))
        if i is not None:
            for p in range(len(x) - length + 1):
                if low[x[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        runs = sum(1 for p in range(len(x)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 5)))
    passages = [" ".join(word() for _ in range(rnd.randint(8, 80))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 300), (5, "y" + "x" * 120 + "z"), (6, "ab" * 200), (7, "b" + "ab" * 90), (8, passages[0]), (8, passages[0]), (8, passages[0] + passages[1]), (9, passages[0])]
    for i in range(10, 60):
        t = " ".join(rnd.choice([rnd.choice(passages), word(), word(), passages[0][rnd.randrange(40) :]]) for _ in range(rnd.randint(1, 8)))
        rows.append((rnd.choice([i, None]) if i % 10 == 0 else i, t))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("kept", F.lit(1)).withColumn("tag", F.lit("clash"))
    got = [tuple(r) for r in D.remove_repeats(spark, df, keep_bytes=False).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    assert D.remove_repeats(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def run_in_one_process(rows, buckets=3):
    """The whole method without Spark, so that its bounds can be made small."""
    import pyarrow as pa

    def grouped(batches, f):
        t = pa.Table.from_batches(batches) if batches else None
        out = [f(t.filter(pa.compute.equal(t.column("bucket"), b))) for b in set(t.column("bucket").to_pylist())] if t else []
        return pa.concat_tables(out).to_pylist() if out else []

    tag = lambda t: hash(t) % 2**62
    batch = pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in rows], pa.int64()), "tag": pa.array([tag(t) for _, t in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    found = grouped(list(D._find(buckets, 50, D.GRAM)(iter([batch]))), D._shared)
    by_kind = {kind: {} for kind in (D._ASK, D._GONE, D._SINGLY)}
    for r in found:
        by_kind[r["kind"]].setdefault((r["id"], r["tag"]), []).append(r["data"])
    spans, asked, singly = by_kind[D._GONE], by_kind[D._ASK], by_kind[D._SINGLY]
    texts = {(i, tag(t)): t for i, t in rows}
    lists = pa.list_(pa.binary())
    want = pa.RecordBatch.from_pylist(
        [{"id": k[0], "tag": k[1], "asked": asked.get(k, []), "singly": singly.get(k, []), "text": texts[k]} for k in {**asked, **singly}],
        pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("asked", lists), ("singly", lists), ("text", pa.string())]),
    )
    for r in grouped([b for b in D._fetch(buckets, 50)(iter([want])) if len(b)], D._repeats(50)) if len(want) else []:
        assert r["kind"] == D._GONE
        spans.setdefault((r["id"], r["tag"]), []).append(r["data"])
    last = pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": batch.column("text"), "data": pa.array([spans.get((i, tag(t))) for i, t in rows], lists)})
    out = [r for b in D._cut(False)(iter([last])) for r in b.to_pylist()]
    return sorted((tuple(r.values()) for r in out), key=str)


@pytest.mark.parametrize("piece,group,windows", [(3 << 20, 24 << 20, 1 << 19), (64, 500, 64), (37, 1, 16), (1000, 5000, 100)])
def test_bounds_do_not_change_the_result(monkeypatch, piece, group, windows):
    monkeypatch.setattr(D, "PIECE", piece)
    monkeypatch.setattr(D, "GROUP", group)
    monkeypatch.setattr(D, "WINDOWS", windows)
    monkeypatch.setattr(D, "CHUNK", windows * 20)
    rows = corpus(3)
    assert run_in_one_process(rows) == brute(rows)


@pytest.mark.parametrize("crowd,hot,group", [(1, 1 << 15, 300), (3, 1 << 15, 2000), (64, 2, 300), (2, 4, 1)])
def test_crowded_anchors_do_not_change_the_result(monkeypatch, crowd, hot, group):
    monkeypatch.setattr(D, "CROWD", crowd)
    monkeypatch.setattr(D, "HOT", hot)
    monkeypatch.setattr(D, "GROUP", group)
    rows = corpus(5)
    assert run_in_one_process(rows) == brute(rows)


def test_a_filler_in_every_document_gathers_nowhere(monkeypatch):
    """The contexts at the filler's ends differ from document to document; no bucket of either step grows with them."""
    rnd = random.Random(6)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    filler = letters(200)
    rows = [(i, letters(60) + filler + letters(60)) for i in range(800)]
    monkeypatch.setattr(D, "CROWD", 8)
    most = []
    repeats = D._repeats

    def counted(length):
        run = repeats(length)

        def seen(t):
            live = t.filter(t.column("anchors").is_valid())
            records = D._unship(live)[2] if len(live) else np.zeros(0, D._ANCHOR)
            most.append(int(np.unique(records["a"], return_counts=True)[1].max(initial=0)))
            return run(t)

        return seen

    monkeypatch.setattr(D, "_repeats", counted)
    assert run_in_one_process(rows, 5) == brute(rows)
    assert max(most) <= 8


def test_very_long_text(monkeypatch):
    rnd = random.Random(7)
    long = "".join(rnd.choice("abcd ") for _ in range(700_000))
    got = {r[0]: r for r in run_in_one_process([(1, long), (2, "q" * 10 + long[300_000:400_000] + "z"), (3, long)])}
    assert [got[i][2] for i in (1, 2, 3)] == [0, 100_000, 700_000]


def test_collisions_are_verified(monkeypatch):
    """With base 1 a hash is the sum of the bytes, so anagrams collide."""
    monkeypatch.setattr(D, "_BASE", 1)
    monkeypatch.setattr(D, "_INVERSE", 1)
    monkeypatch.setattr(D, "_tables", {})
    rows = [(1, "ab" * 40), (2, "ba" * 40), (3, "aabb" * 20), (4, "c" + "ab" * 40)]
    assert run_in_one_process(rows, 1) == brute(rows)


def test_suffix_sort_is_sorted():
    rnd = random.Random(4)
    raw = bytes(rnd.choice(b"ab") for _ in range(3000))
    buffer = np.frombuffer(raw, np.uint8)
    group = np.sort(np.array([rnd.randrange(7) for _ in range(900)]))
    start = np.array([rnd.randrange(2900) for _ in range(900)])
    size = np.array([rnd.randint(1, 90) for _ in range(900)])
    order = D.suffix_sort(D.PrefixHash(buffer), buffer, group, start, size)
    assert order.tolist() == sorted(range(900), key=lambda i: (group[i], raw[start[i] : start[i] + size[i]], i))
