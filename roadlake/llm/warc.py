"""WARC archives: a writer with revisit records and a splittable reader of gzip members.

Writing: every record is a gzip member of its own. Of records with equal payloads of ``least`` bytes or more, the one
with the largest id is a response; the others are revisit records that refer to it and carry no payload.

Reading: archives are cut into byte ranges. A task searches its range for the gzip magic, validates a candidate member
by decoding its first bytes and looking for a WARC version line, and owns the records that start inside its range, the
last of which it reads to its end beyond the range. From a valid member on, the next one starts where it ends. So any
archive is read by as many tasks as it has ranges, without an index, and each record exactly once.

Defined results: a null payload counts as empty; a null id is written as absent and read back as null, and is never the
largest; rows that share the largest id are all responses; a null URL is left out; an empty table gives no files and no
rows; other columns are not read, so their names can't clash. Archives that end inside a member raise an error.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm.files import filesystem, write
from roadlake.llm.shared import Scratch, new_path, table

#: Least payload that a revisit record stands for.
LEAST = 1000
#: Compressed bytes after which a task begins another file.
ROLL = 64 << 20
#: Bytes of a range.
SPLIT = 4 << 20
_CHUNK = 1 << 16
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}').urn}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _write(folder: str, roll: int):
    """For mapInArrow over (id, url, body, digest, refers_to): a row (path, size, records) for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            write(path, b"".join(parts))
            return pa.RecordBatch.from_pydict({"path": [path], "size": pa.array([held], pa.int64()), "records": pa.array([len(parts)], pa.int64())})

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("id", "url", "digest", "refers_to")]
            for (page, url, digest, refers_to), body in zip(zip(*cols, strict=True), b.column("body").cast(pa.binary()).to_pylist(), strict=True):
                parts.append(member(record(page, url, body, digest, refers_to)))
                held += len(parts[-1])
                if held >= roll:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    return run


def write_warc(spark: SparkSession, pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Writes archives into ``folder``; (path, size, records) of each, a table that names only finished files."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"))
    large = rows.where(F.col("n") >= least)
    latest = large.groupBy("digest", "n").agg(F.max("id").alias("latest"), F.count("*").alias("times")).where("times > 1").drop("times")
    refers_to = F.when(F.col("id").eqNullSafe(F.col("latest")), F.lit(None)).otherwise(F.col("latest"))
    cols = ["id", "url", "body", "digest"]
    judged = large.join(latest, ["digest", "n"], "left").select(*cols, refers_to.alias("refers_to"))
    small = rows.where(F.col("n") < least).select(*cols, F.lit(None).cast("bigint").alias("refers_to"))
    files = judged.unionByName(small).mapInArrow(_write(folder, roll), "path string, size bigint, records bigint")
    return Scratch(spark, "warc-manifest").cut(files)


class _Bytes:
    """Reads of a file by position."""

    def __init__(self, uri: str) -> None:
        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(min(n, max(0, self.size - at)), at)


def _decode(source: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The content of the member at ``at`` and where it ends; None if no WARC record starts there."""
    inflate = zlib.decompressobj(31)
    out, pos, sure = [], at, False
    while not inflate.eof:
        data = source.read(pos, _CHUNK)
        if not data:
            if sure:
                raise ValueError(f"the archive ends inside the record at byte {at}")
            return None
        try:
            out.append(inflate.decompress(data))
        except zlib.error:
            if sure:
                raise
            return None
        pos += len(data)
        if not sure and sum(map(len, out)) >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None
            sure = True
    return (b"".join(out), pos - len(inflate.unused_data)) if sure else None


def members(source: _Bytes, start: int, end: int) -> Iterator[bytes]:
    """Contents of the records that start in [start, end)."""
    at = start
    while at < end:
        window = source.read(at, min(_CHUNK, end - at) + len(_MAGIC) - 1)  # magic may lie across the end
        hit = window.find(_MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(_MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        found = _decode(source, at)
        if found is None:
            at += 1
            continue
        yield found[0]
        at = found[1]


def parse(content: bytes) -> dict:
    """The fields of a record as this module writes it; other records have a null id and their own payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block
    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        digest, size = stated, int(fields.get("x-payload-length", 0))
    else:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        if len(stated) == 40 and stated != digest:
            raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"id": number("x-page-id"), "uri": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id"), "payload": payload}


def _read(with_payload: bool):
    """For mapInArrow over (path, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"id": pa.int64(), "uri": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if with_payload else {})
        schema = pa.schema(list(kinds.items()))
        for b in batches:
            for r in b.to_pylist():
                rows, held = [], 0
                for content in members(_Bytes(r["path"]), r["start"], r["end"]):
                    row = parse(content)
                    rows.append({k: row[k] for k in kinds})
                    held += len(content) if with_payload else 200
                    if held >= 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_warc(spark: SparkSession, files: DataFrame, with_payload: bool = True, split: int = SPLIT) -> DataFrame:
    """id, uri, payload_bytes, payload_digest, record_type, refers_to and, with ``with_payload``, payload.

    ``files`` has (path, size); paths are URIs that the executors can open.
    """
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split).cast("bigint"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, F.col("size")).alias("end"))
    total = files.agg(F.coalesce(F.sum(F.ceil(F.col("size") / split)), F.lit(0))).first()[0]
    schema = "id bigint, uri string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    return ranges.repartition(int(max(1, min(total, 100_000)))).mapInArrow(_read(with_payload), schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back from them."""
    files = write_warc(spark, table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_warc(spark, files, with_payload=False).drop("uri").withColumnRenamed("id", "page_id")


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), l AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS latest FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN latest IS NULL OR latest IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN latest IS NULL OR latest IS NOT DISTINCT FROM page_id THEN NULL ELSE latest END AS refers_to
FROM l
"""
