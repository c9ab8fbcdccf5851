"""Round trips, ranges of every size, and revisit records."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from roadlake.llm import warc as W
from roadlake.llm.files import write
from roadlake.llm.shared import new_path

BIG = "é" * 600
ROWS = [
    (1, "http://a/é b", "<p>one</p>"), (2, None, None), (3, "http://a/\r\nX-Page-ID: 9", ""), (4, "u", BIG), (9, "u", BIG), (7, "u", BIG),
    (9, "u", BIG), (5, "v", "x" * 999), (6, "v", "x" * 999), (10, "w", "y" * 1000), (11, "w", "y" * 1000), (None, "w", "y" * 1000), (None, "w", "z" * 2000), (12, "w", "long " * 400_000),
]


def expected():
    out = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        ids = [p for p, _, h in ROWS if h == html and p is not None]
        top = max(ids, default=None) if len(body) >= 1000 else None
        revisit = top is not None and top != page
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("roll,split", [(W.ROLL, W.SPLIT), (300, 64)])
def test_round_trip(spark, roll, split):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1))
    files = W.write_warc(spark, pages, new_path(spark, "t"), roll=roll)
    got = W.read_warc(spark, files, split=split)
    rows = got.collect()
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == expected()
    assert all(r.record_type == "revisit" or (r.payload and hashlib.sha1(r.payload).hexdigest() == r.payload_digest) or r.payload_bytes == 0 for r in rows)
    for f in files.collect():  # any gzip reader can read them
        with gzip.open(f.path.removeprefix("file://")) as g:
            assert g.read().count(b"WARC/1.1\r\n") == f.records


def test_ranges_own_each_record_once(tmp_path):
    rnd = random.Random(2)
    records = [W.record(n, "u", bytes(rnd.choice(b"ab\x1f\x8b\x08") for _ in range(rnd.randint(0, 3000))), "", None) for n in range(30)]
    data = b"".join(map(W.member, records)) + b"junk \x1f\x8b\x08 after"
    write(f"file://{tmp_path}/x.warc.gz", data)
    source = W._Bytes(f"file://{tmp_path}/x.warc.gz")
    for step in (1, 2, 3, 50, 999, 10**6):
        assert [c for at in range(0, len(data), step) for c in W.members(source, at, min(len(data), at + step))] == records
    write(f"file://{tmp_path}/cut.warc.gz", W.member(records[0] + bytes(rnd.randbytes(9000)))[:-20])
    with pytest.raises(ValueError):
        list(W.members(W._Bytes(f"file://{tmp_path}/cut.warc.gz"), 0, 100))


def test_empty_table(spark):
    files = W.write_warc(spark, spark.createDataFrame([], "page_id long, url string, html string"), new_path(spark, "t"))
    assert files.count() == 0 and W.read_warc(spark, files).count() == 0
