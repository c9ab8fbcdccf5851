"""Each stage on a small corpus with cases planted in it."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, k):
    return ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(k)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(6)
    rows, labels, planted = [], [], {}
    for i in range(400):
        w = words(rnd, rnd.randint(60, 200))
        if i % 8 == 0:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["scum", "idiot", "trash"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 8 == 0)))
    exam = " ".join(words(rnd, 30))
    by = dict(rows)
    near = by[17].split()
    near[30] = "changed"
    rows += [(1000, by[15]), (1001, " ".join(near)), (1002, by[19] + " " + exam[40:]), (1003, by[21] + " password=Abc123def456 " + by[22]), (1004, None), (1005, ""), (1006, None), (None, "no id here"), (None, "no id here"), (23, by[23])]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], SCHEMA).withColumn("bucket", F.lit("clash")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    clean = C.toxic_documents(spark, docs, folder)
    assert clean.columns == columns
    toxic = {i for i in range(400) if i % 8 == 0}
    ids = [r.doc_id for r in clean.collect()]
    assert not toxic & set(ids) and len(ids) == len(rows) - len(toxic)
    unique = C.near_duplicates(spark, docs, folder)
    assert unique.columns == columns
    ids = [r.doc_id for r in unique.collect()]
    gone = {i for i, _ in rows} - set(ids)
    assert gone == {1000, 1001, 1005, 1006} and ids.count(23) == 1 and ids.count(None) == 2
    fair = C.benchmark_leaks(spark, docs, folder)
    assert fair.columns == columns and {i for i, _ in rows} - {r.doc_id for r in fair.collect()} == {1002}
    safe = C.secrets(spark, docs, folder)
    assert safe.columns == columns
    changed = {r.doc_id: r for r in safe.collect() if r.doc_id is not None and r.text != dict(rows)[r.doc_id]}
    assert set(changed) == {1003} and "[SECRET]" in changed[1003].text and changed[1003].n_chars == len(changed[1003].text)
    assert C.batches(spark, docs, folder).count() == len(rows)


def test_run(spark, corpus):
    folder, rows = corpus
    got = [r.doc_id for r in C.run(spark, folder).collect()]
    assert len(got) == len(rows) - 50 - 5 - 1


def test_empty(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, corpus[0]).count() == 0
