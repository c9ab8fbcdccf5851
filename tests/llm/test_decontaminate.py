"""Hits against a plain search of every window."""

import random
import re

import pytest
from pyspark.sql import functions as F

from roadlake.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items):
    windows = []
    for item, t in items:
        w = WORD.findall(lower(t))
        if item is not None and w:
            windows += [(str(item), w[i : i + 10]) for i in range(max(1, len(w) - 9))]
    out = []
    for i, t in docs:
        spots = [m.span() for m in WORD.finditer(lower(t))]
        w = [lower(t)[a:b] for a, b in spots]
        hit, found = set(), set()
        for item, x in windows:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    found.add(item)
        runs = [p for p in sorted(hit) if p - 1 not in hit], [p for p in sorted(hit) if p + 1 not in hit]
        out.append((i, len(w), len(hit), sorted(found), [(spots[a][0], spots[b][1]) for a, b in zip(*runs)], bool(hit)))
    return out


def corpus():
    rnd = random.Random(9)
    vocabulary = ["a", "B", "é", "Ünder", "x1", "42", "the", "Long"]
    word = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(word(rnd.choice([3, 9, 10, 11, 25])))) for i in range(30)] + [(None, "the the the"), (77, None), (78, "?!"), (79, ""), (5, "the Long the")]
    docs = [(1, None), (2, ""), (3, "...")]
    for i in range(60):
        parts = word(rnd.randint(0, 30)) + (rnd.choice(items[:30])[1] or "").split() + word(rnd.randint(0, 9))
        docs.append((rnd.choice([i, None]), "".join(w + rnd.choice([" ", ", ", "\n", "--"]) for w in parts)))
    return docs, items


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 150])
def test_hits_equal_brute_force(spark, block):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash")).withColumn("items", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans], r.contaminated) for r in D.contamination(spark, df, bench, block_bytes=block).collect()]
    want = brute(docs, items)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    kept = D.keep_clean(spark, df, bench, block_bytes=block)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == sorted(d for d, w in zip(docs, want) if not w[5] and d[0] is not None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    one = spark.createDataFrame([(1, 1, "a b c")], none.schema)
    assert D.contamination(spark, none, one).count() == 0
    assert [r.contaminated for r in D.contamination(spark, one, none).collect()] == [False]
    assert D.keep_clean(spark, one, none).count() == 1
