"""Benchmark decontamination: which documents repeat windows of test questions and answers.

Texts and test items are normalised alike: A-Z become lower case and words are runs of digits, letters a-z and
non-ASCII characters, set apart by one space. Every window of ``window`` consecutive item words (a shorter item is one
window) is a pattern of one Aho-Corasick automaton; each normalised text is scanned once, and hits are mapped back to
code-point offsets of the original text.

The automaton is broadcast, so its size is bounded: test items are dealt by hash into blocks of at most BLOCK_BYTES of
text, with one automaton and one scan for each block. Any ordinary benchmark is one block. Documents are never shuffled.

Defined results: a null or empty text has no words and is not contaminated; a null item text has no windows and items
with a null id are left out; repeated rows are judged one by one; empty tables give no rows or no hits; other columns
are not read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm.shared import Scratch, table

WINDOW = 10
#: Most bytes of item texts in one automaton; it takes some hundred times as much memory in each Python worker.
BLOCK_BYTES = 400_000

#: By byte of UTF-8: A-Z to a-z, what no word has to a space, the rest to itself.
_NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_automata: dict[str, object] = {}


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def _windows(text: str, window: int) -> set[str]:
    """Normalised windows with a space at both ends; characters stand for UTF-8 bytes."""
    w = words(text.encode())
    return {" " + b" ".join(w[i : i + window]).decode("latin-1") + " " for i in range(max(1, len(w) - window + 1))} if w else set()


def _automaton(patterns: Broadcast):
    """Built once in each Python worker."""
    import ahocorasick

    if patterns.value["key"] not in _automata:
        _automata.clear()
        a = ahocorasick.Automaton()
        for pattern, items in patterns.value["windows"].items():
            a.add_word(pattern, (pattern.count(" ") - 1, items))
        a.make_automaton()
        _automata[patterns.value["key"]] = a
    return _automata[patterns.value["key"]]


def _hits(automaton, joined: str) -> tuple[list[int], set[str]]:
    """Flat, sorted, disjoint word intervals [from, to, from, to ...] and the items hit."""
    flat: list[int] = []
    items: set[str] = set()
    seen = at = 0
    for end, (n, ids) in automaton.iter(joined):
        seen += joined.count(" ", at, end)
        at = end
        start = seen - n
        while flat and start <= flat[-1]:  # longer windows can start before earlier hits
            start = min(start, flat[-2])
            del flat[-2:]
        flat += [start, seen]
        items.update(ids)
    return flat, items


def _merge(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _scan(patterns: Broadcast | None, first: bool, last: bool, keep_text: bool):
    """For mapInArrow over (id, text[, n_words, hits, items]): adds one block's hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(patterns) if patterns and patterns.value["windows"] else None
        for b in batches:
            ns, hits, found, spans = [], [], [], []
            texts = b.column("text")
            before = [([], [])] * len(b) if first else zip(b.column("hits").to_pylist(), b.column("items").to_pylist(), strict=True)
            for text, (old, old_items) in zip(texts.cast(pa.binary()).to_pylist(), before, strict=True):
                w = words(text) if text else []
                flat, items = _hits(automaton, f" {b' '.join(w).decode('latin-1')} ") if w and automaton else ([], set())
                if old:
                    flat, items = _merge(old, flat), items.union(old_items)
                ns.append(len(w))
                hits.append(flat)
                found.append(sorted(items))
                if last:
                    if flat:
                        at = [m.span() for m in _ORIGINAL_WORD.finditer(text.decode())]
                        spans.append([{"start": at[x][0], "end": at[y - 1][1]} for x, y in zip(flat[::2], flat[1::2], strict=True)])
                    else:
                        spans.append([])
            cols = {"id": b.column("id")}
            if keep_text:
                cols["text"] = texts
            cols |= {"n_words": pa.array(ns, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int64())), "items": pa.array(found, pa.list_(pa.string()))}
            if last:
                cols["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def _blocks(items: DataFrame, item_id_col: str, item_text_col: str, window: int, block_bytes: int) -> Iterator[tuple[dict[str, tuple[str, ...]], bool]]:
    """(windows and their items, whether it is the last) of each block."""
    items = items.select(F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    blocks = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // block_bytes + 1
    for n in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == n) if blocks > 1 else items
        windows: dict[str, set[str]] = defaultdict(set)
        for item, text in block.collect():  # about block_bytes
            for x in _windows(text, window):
                windows[x].add(item)
        yield {k: tuple(v) for k, v in windows.items()}, n == blocks - 1


def contamination(
    spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """id, n_words, n_hit, items (ids as sorted strings), spans (code points, end exclusive), contaminated."""
    id_type = docs.schema[id_col].dataType.simpleString()
    df, scratch = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), Scratch(spark, "contamination")
    first = True
    for windows, last in _blocks(items, item_id_col, item_text_col, window, block_bytes):
        patterns = spark.sparkContext.broadcast({"key": uuid4().hex, "windows": windows})
        schema = f"id {id_type}, " + "text string, " * (not last) + "n_words bigint, hits array<bigint>, items array<string>" + ", spans array<struct<start:bigint,end:bigint>>" * last
        df = df.mapInArrow(_scan(patterns, first, last, not last), schema)
        first = False
        if not last:
            df = scratch.cut(df)
    n_hit = F.expr("aggregate(sequence(0, size(hits) div 2), 0L, (n, i) -> n + coalesce(get(hits, 2 * i + 1) - get(hits, 2 * i), 0L))")
    return df.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans", (F.size("hits") > 0).alias("contaminated"))


def keep_clean(
    spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has no window of a test item."""
    text_at = docs.columns.index(text_col)

    def without(patterns: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(patterns) if patterns.value["windows"] else None
            for b in batches:
                clean = []
                for text in b.column(text_at).cast(pa.binary()).to_pylist():
                    w = words(text) if text and automaton else []
                    clean.append(not w or next(automaton.iter(f" {b' '.join(w).decode('latin-1')} "), None) is None)
                yield b.filter(pa.array(clean, pa.bool_()))

        return run

    for windows, _ in _blocks(items, item_id_col, item_text_col, window, block_bytes):
        docs = docs.mapInArrow(without(spark.sparkContext.broadcast({"key": uuid4().hex, "windows": windows})), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every test item."""
    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


OP1_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
    row_number() OVER () AS r
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)
), spot AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT r, i, spot.n, item_id FROM spot JOIN win ON spot.n = win.n AND spot.s = win.s
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
