"""Rows that share an id and have different texts are judged apart by the near-duplicate stage."""

import random

import corpus_pipeline as C


def test_clean_text_stays_beside_a_near_copy_of_its_id(spark):
    rnd = random.Random(2)
    one, other = ([f"w{rnd.randrange(5000)}" for _ in range(80)] for _ in range(2))
    near = [*one[:-1], "changed"]
    rows = [(1, " ".join(one)), (7, " ".join(near)), (7, " ".join(other)), (7, " ".join(other)), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in C.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
