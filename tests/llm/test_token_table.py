"""Shards against the tokenizer on each whole text, and lookups."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadlake.llm import token_table as T
from roadlake.llm.files import write
from roadlake.llm.shared import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rnd = random.Random(1)
    bits = ["the", "Don't", "é", "straße", "12,345", "\n", "\n\n", "\t", " ", "  ", "   ", " ", "　x", "\x1c", "!\x1c!", "😀", "<|endoftext|>", "a\r\n", "'s", "…", "x" * 60, "tail ", "end.", "end", "50%", "%%%", "it's", "it's'", "é,", "ß.", "字。", "\x01", "\x01a", ",", "a_", "_", "²!", "x\n", "\ny", "w.\nV", "\u00a0", "\u2003z"]
    return [None, "", " ", "  ", "a ", " a", "a  b", "a \nb", "a\n b", "a  \n b "] + [rnd.choice(["", " "]).join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))) for _ in range(900)]


def test_encoder_equals_the_tokenizer_on_whole_texts():
    tokenizer = Tokenizer.from_file(PATH)
    encoder, given = T.Encoder(PATH, 2), [t or "" for t in texts()]
    given += ["a\x02b", "\x02", "\x02 \x02"]
    for _ in range(2):  # the second time from memory
        got = encoder.encode(pa.array(given))
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in given]


@pytest.mark.parametrize("roll", [T.ROLL, 2000])
def test_round_trip(spark, roll):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(n * 37 % 311 - 100, t) for n, t in enumerate(texts())] + [(None, "null id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("start", F.lit(1)).withColumn("id", F.lit("clash"))
    shards = T.write_tokens(spark, df, new_path(spark, "t"), PATH, roll=roll)
    got = [tuple(r) for r in T.read_tokens(shards).collect()]
    want, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    named = shards.orderBy("part", "nth").collect()
    assert sum(s.records for s in named) == len(rows)
    found = [x for s in named for x in T.Shard(s.path).get(5)]
    assert len(found) == sum(r[0] == 5 for r in rows) and not any(T.Shard(s.path).get(10**6) for s in named)


def test_lookup_over_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 64)
    w = T.ShardWriter(4)
    ids = sorted([*range(-500, 500, 3), 7, 7, 7, 7, 7, 7, 7, 7, -(2**63), 2**63 - 1])
    for n in ids:
        w.add(T.key_of(n), np.arange(abs(n) % 9, dtype="<u4").tobytes())
    write(f"file://{tmp_path}/x", w.finish())
    shard = T.Shard(f"file://{tmp_path}/x")
    assert len(shard.index) > 50 and [T.id_of(k) for k, _ in shard.records()] == ids
    for n in {*ids, 1, 2, 8, 10**9}:
        assert [x.tolist() for x in shard.get(n)] == [list(range(abs(n) % 9))] * ids.count(n)
    with pytest.raises(ValueError):
        w.add(T.key_of(0), b"")


def test_empty_table(spark):
    shards = T.write_tokens(spark, spark.createDataFrame([], "doc_id long, text string"), new_path(spark, "t"), PATH)
    assert T.read_tokens(shards).count() == 0


def test_long_texts_are_cut_where_words_end(monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    monkeypatch.setattr(T, "SLICE", 300)
    monkeypatch.setattr(T, "PART", 40)
    encoder = T.Encoder(PATH)
    given = [(t or "") * 5 for t in texts()] + ["x" * 2000, "ab cd " * 400, "ab  cd " * 400]
    got = list(encoder.documents(pa.array(given)))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in given]


def test_words_are_remembered_in_two_generations(monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    monkeypatch.setattr(T, "WORDS", 20)
    encoder = T.Encoder(PATH)
    for t in texts():
        assert np.frombuffer(encoder.encode(pa.array([t or ""]))[0], "<u2").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_a_large_vocabulary_takes_four_bytes_and_other_tokenizers_see_whole_texts(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    vocab = {"<unk>": 0} | {f"w{n}": n for n in range(1, 70_000)}
    large = Tokenizer(models.WordLevel(vocab, unk_token="<unk>"))
    large.pre_tokenizer = pre_tokenizers.Whitespace()
    path = f"{tmp_path}/large.json"
    large.save(path)
    rows = [(1, "w1 w69999"), (2, "w65536,  w65535"), (3, None)]
    shards = T.write_tokens(spark, spark.createDataFrame(rows, "doc_id long, text string"), new_path(spark, "t"), path)
    found = {doc: [x.tolist() for s in shards.collect() for x in T.Shard(s.path).get(doc)] for doc, _ in rows}
    assert found == {1: [[1, 69999, 0]], 2: [[65536, 0, 65535, 0]], 3: [[0]]}
