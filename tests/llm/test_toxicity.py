"""Held-out accuracy, out-of-fold training, and odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from roadlake.llm import toxicity as X

BAD = ["scum", "idiot", "trash"]


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(2, 6))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(vocabulary, k=rnd.randint(5, 400))
        toxic, junk = rnd.random() < 0.15, rnd.random() < 0.2
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD).title())
        docs.append((i, (" %%% " if junk else " ").join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(1500, 1)
    odd = [(None, "you idiot scum"), (5000, None), (5001, ""), (5002, "word " * 200_000 + "idiot scum trash")]
    df = spark.createDataFrame([*docs, *odd], "doc_id long, text string").withColumn("p_toxic", F.lit("clash")).withColumn("id", F.lit(1))
    given = spark.createDataFrame([*labels[:900], (99_999, 1, 1), (1499, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = X.train(spark, df, given)
    got = {r.doc_id: r for r in X.score(spark, df, model).collect()}
    truth = {i: (q, t) for i, q, t in labels}
    held = range(900, 1500)
    assert sum((got[i].p_toxic >= 0.5) == bool(truth[i][1]) for i in held) >= 0.99 * len(held)
    assert sum((got[i].p_low_quality >= 0.5) == (truth[i][0] == 0) for i in held) >= 0.97 * len(held)
    assert got[None].p_toxic >= 0.5 and got[5002].p_toxic >= 0.5 and got[5000].p_toxic < 0.5 and got[5001].p_toxic < 0.5
    kept = X.keep_clean(spark, df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.p_toxic < X.THRESHOLD}


def test_later_models_see_out_of_fold_probabilities(monkeypatch):
    docs, labels = corpus(400, 2)
    texts, dense = [X.words(t.encode()) for _, t in docs], np.array([X.ratios(t.encode()) for _, t in docs])
    y = np.array([[1 - q, t] for _, q, t in labels])
    folds = np.arange(400) % X.FOLDS
    seen, original = [], X.fit
    monkeypatch.setattr(X, "fit", lambda w, some, d, v: seen.append((len(some), d.shape[1])) or original(w, some, d, v))
    words = X.Words([X.hashed(t) for t in texts])
    chain = X.Chain.train(words, dense, y, folds)
    assert seen == [(400, 5), *[(320, 5)] * 5, (400, 6)]
    names = {}
    for w in set().union(*texts):
        names.setdefault(int(X.hashed({w})[0]), []).append(w)
    p = chain.name_words(words, names).predict(texts, dense)
    assert p.shape == (400, 2) and {w for w in chain.models[1].words} >= {w.encode() for w in BAD}
    assert ((p[:, 1] >= 0.5) == (y[:, 1] == 1)).mean() >= 0.99


def test_no_labels_one_class_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.p_toxic for r in X.score(spark, df, X.train(spark, df, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.p_toxic for r in X.score(spark, df, X.train(spark, df, one)).collect()} == {1.0}
    assert X.score(spark, df.limit(0), X.train(spark, df.limit(0), one)).count() == 0


def test_scores_equal_those_of_one_process_that_sees_every_word(spark):
    """Brute force: all words of the labelled texts in one process, and a plain sum for each text."""
    docs, labels = corpus(600, 3)
    df, given = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels[:500], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.score(spark, df, X.train(spark, df, given)).collect()}
    draws = dict(spark.createDataFrame([(i,) for i in range(500)], "id long").selectExpr("id", "xxhash64(id)").collect())
    order = sorted(range(500), key=lambda i: draws[i])
    texts = {i: t.encode() for i, t in docs}
    words = X.Words([X.hashed(X.words(texts[i])) for i in order])
    y = np.array([[1 - labels[i][1], labels[i][2], labels[i][2] * (1 - labels[i][1])] for i in order])
    chain = X.Chain.train(words, np.array([X.ratios(texts[i]) for i in order]), y, np.array([draws[i] % X.FOLDS for i in order]))
    for i, text in texts.items():
        known = set(X.hashed(X.words(text)).tolist())
        dense = list(X.ratios(text))
        for model, (name, _) in zip(chain.models, X.CHAIN):
            inside = [float(int(words.hashes[c]) in known) for c in model.codes]
            x = inside + [(v - m) / s for v, m, s in zip(dense, model.mean, model.scale)]
            p = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(x, model.weights)) + model.bias)))
            assert abs(got[i][f"p_{name}"] - p) < 1e-6
            dense.append(p)
