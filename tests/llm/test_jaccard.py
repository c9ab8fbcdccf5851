"""Links at a Jaccard similarity of 0.8 against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from roadlake.llm import jaccard as J
from roadlake.llm import simhash as S


def plain(text, size=5):
    return set(S.shingles((text or "").encode(), size))


def brute(rows):
    """Components of the pairs with 5 * shared >= 4 * all, by their least id, and the linked pairs."""
    sets = {i: plain(t) for i, t in rows}
    parent, linked = {i: i for i in sets}, set()

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                linked.add((j, i))
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}, linked


def corpus(seed, families):
    """Copies with edits that put them on both sides of 0.8, shared passages, and short and odd texts."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(2000)]
    line = rnd.choices(vocabulary, k=30)
    texts = [None, "", " ", "One", "one", "a b c d e", "A b c d e f", "a b c d e f g"]
    for n in range(families):
        words = rnd.choices(vocabulary, k=rnd.choice([6, 12, 40, 60, 200, 1000]))
        if n % 3 == 0:
            words += line
        for _ in range(rnd.randint(2, 5)):
            texts.append(" ".join(words))
            words = list(words)
            for at in rnd.sample(range(len(words)), max(1, len(words) * rnd.randint(1, 5) // 100)):
                words[at] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                words += rnd.choices(vocabulary, k=len(words) // rnd.randint(6, 30))
    return list(enumerate(texts))


@pytest.mark.parametrize("short", [16, 2])
def test_groups_equal_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(J, "SHORT", short)
    rows = corpus(short, 200)
    want, linked = brute(rows)
    assert len(linked) > 100
    got = {r.doc_id: r.component_id for r in S.wide_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_dense_cluster_and_common_passage(spark):
    """Runs longer than SHORT: 40 near copies of one text, and 40 texts that share a passage and are not similar."""
    rnd = random.Random(9)
    vocabulary = [f"w{n}" for n in range(3000)]
    base, line = rnd.choices(vocabulary, k=120), rnd.choices(vocabulary, k=40)
    rows = []
    for n in range(40):
        words = list(base)
        for at in rnd.sample(range(120), 2):
            words[at] = rnd.choice(vocabulary)
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(line + rnd.choices(vocabulary, k=rnd.randint(20, 60))))]
    want, _ = brute(rows)
    got = {r.doc_id: r.component_id for r in S.wide_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_similar_sets_share_a_prefix_key():
    """Every pair at 0.8 or more meets: an index key of the smaller set is a probe key of the larger, in any order."""
    rnd = random.Random(4)
    met = 0
    for _ in range(4000):
        n = rnd.choice([1, 4, 5, 9, 10, 50, 300])
        shared = list(range(n))
        a = shared + [n + k for k in range(rnd.randint(0, n // 4))]
        b = shared + [3 * n + k for k in range(rnd.randint(0, n // 4))]
        if 5 * n < 4 * (len(a) + len(b) - n):
            continue
        order = list(range(5 * n + 1))
        rnd.shuffle(order)
        small, large = sorted(([order[x] for x in a], [order[x] for x in b]), key=len)
        assert set(sorted(small)[: J.index(len(small))]) & set(sorted(large)[: J.probe(len(large))])
        met += 1
    assert met > 1000


def test_pigeonring_links_come_first_and_do_not_meet_again(spark, monkeypatch):
    rows, made = corpus(16, 40), []
    link = S._link
    monkeypatch.setattr(S, "_link", lambda *a: made.append(link(*a)) or made[-1])
    groups = S.wide_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in groups.collect()} == brute(rows)[0]
    assert len(made) == 1 and made[0].count() > 0
    for size in (3, 40):  # runs of both kinds
        rows = [(5, c, 0 if c < 2 else c, 100, True) for c in range(size)]
        kind = J._dealt(1)[1]
        batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.array(rows, kind).tobytes()], pa.binary())], ["bucket", "rows"])
        pairs = {(u, v) for b in J._meet(kind)(iter([batch])) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True) if u is not None}
        assert (0, 1) not in pairs and (0, 2) in pairs


def met_in_buckets(sets, buckets):
    """The pairs that _meet gives for sets of keys in order, over all buckets."""
    deal, kind = J._dealt(buckets)
    given = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([len(s) * 5 for s in sets], pa.int32()), pa.array(range(len(sets))), pa.array([np.array(s, "<u8").tobytes() for s in sets])], ["cid", "n", "label", "keys"])
    dealt = pa.Table.from_batches(deal(iter([given]))).sort_by("bucket").to_batches()
    return [(u, v) for b in J._meet(kind)(iter(dealt)) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True) if u is not None]


def test_a_pair_is_given_once_for_each_stretch_of_shared_keys():
    keys = [int(k) for k in np.random.default_rng(2).integers(1 << 60, size=40)]
    assert met_in_buckets([keys, keys], 64) == [(0, 1)]
    other = [*keys[:9], 7, *keys[9:]]
    assert 1 <= len(met_in_buckets([keys, other], 64)) <= 2
    assert met_in_buckets([keys, [5, 6, keys[3], 8]], 64) == []  # the smaller set is too small for the similarity
    assert len(met_in_buckets([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4]], 3)) == 3


def test_runs_of_one_label_give_no_members():
    kind = J._dealt(1)[1]
    rows = np.array([(5, c, 0, 100, True) for c in range(40)], kind)
    assert not list(J._meet(kind)(iter([pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([rows.tobytes()])], ["bucket", "rows"])])))


def test_many_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "BUCKET", 1 << 12)
    rows = corpus(31, 80)
    got = {r.doc_id: r.component_id for r in S.wide_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)[0]


def test_common_shingles_are_found_at_every_size(spark, monkeypatch):
    """The sample grows with the documents: a shingle of a tenth of them is common, however few SAMPLE are."""
    monkeypatch.setattr(J, "SAMPLE", 5)
    rows = [(n, f"w{n} x{n} y{n} z{n} " + ("one two three four five" if n % 10 == 0 else f"v{n}")) for n in range(600)]
    at, chars = J.text_hash(J.F.col("text"))
    docs = spark.createDataFrame(rows, "id long, text string").withColumns({"hash": at, "chars": chars})
    assert J.shingle_set(b"one two three four five", 5)[0] in J.common_shingles(docs, 5)[0]
