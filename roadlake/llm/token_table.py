"""Token ids of documents in sorted-string-table shards.

A shard is a file of records sorted by document id. Records are stored in blocks of about BLOCK bytes; in a block, a key
shares its prefix with the one before it, and the block is compressed and has a checksum. After the blocks come a sparse
index (the first key of each block), a Bloom filter over the ids, and a footer that says where they are. A lookup asks
the filter, finds the block by binary search in the index, and reads that block alone.

    file    = magic, block*, index, filter, footer JSON, footer length (u32), magic
    block   = zstd(record*), crc32 (u32) of the compressed bytes
    record  = varint shared key bytes, varint other key bytes, varint value bytes, other key bytes, value
    key     = 0 (null id) or 1 and the id, big-endian with the sign bit turned, so that bytes sort as ids do
    value   = token ids, little-endian, 2 bytes each where the vocabulary's ids allow it, else 4

Documents are range-partitioned by id, so that shards follow each other in id order, and a task encodes and writes its
range as it streams by. Words recur, and the pre-tokens of a byte-level tokenizer never reach over the space before a
word, so a task encodes each spaced word once and remembers its ids; texts where that is less plain, and all texts of
other tokenizers, go to the tokenizer whole. Texts are encoded SLICE bytes at a time; longer ones are cut before spaces
between letters or digits, where pre-tokens end.

Defined results: a null or empty text has the end id alone; null ids sort first; rows with one id are all kept, in text
order; an empty table gives no files and no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlake.llm.files import filesystem, write
from roadlake.llm.shared import Scratch, new_path, table

_MAGIC = b"RLSST001"
#: Bytes of records in a block before compression.
BLOCK = 1 << 16
#: Bytes of a shard after which a task begins another.
ROLL = 64 << 20
#: Bytes of text that one task encodes.
TASK = 24 << 20
_BITS_PER_KEY, _PROBES = 10, 7
#: Bytes of text that are encoded at a time, and of a long text's parts.
SLICE, PART = 8 << 20, 1 << 20
#: Words that a worker remembers (those not met for longest go first), and the longest of them.
WORDS, WORD_CHARS = 800_000, 48
#: Parts that are numbered together.
NUMBERED = 1000

_FIRST, _JOIN = "\x02", "\x01"
#: A run of punctuation between a letter or digit and a space: a pre-token of its own. Words without it recur more often.
_TAIL, _TAIL_KEY = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~]+)( |$)", rf"\1 {_JOIN}\2\3"
#: Letters alone, after what may stand in front of a key: one pre-token, besides a line end.
_MARKS = (_FIRST, _JOIN, "\n")
_LETTERS = re.compile(rf"[{_FIRST}{_JOIN}\n]?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: White space but " ": a space between two of it is inside a pre-token.
_SPACE = r"[\t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CUT = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = data[at]
        at += 1
        n |= (c & 0x7F) << shift
        if c < 0x80:
            return n, at
        shift += 7


def key_of(doc: int | None) -> bytes:
    return b"\0" if doc is None else b"\1" + struct.pack(">Q", (doc & (1 << 64) - 1) ^ 1 << 63)


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">q", struct.pack(">Q", struct.unpack(">Q", key[1:])[0] ^ 1 << 63))[0]


def _probes(key: bytes, bits: int) -> list[int]:
    from xxhash import xxh64_intdigest

    a, b = xxh64_intdigest(key, 0), xxh64_intdigest(key, 1) | 1
    return [(a + n * b) % bits for n in range(_PROBES)]


class ShardWriter:
    """Builds one shard; keys must be added in order."""

    def __init__(self, width: int) -> None:
        import zstandard

        self.squeeze = zstandard.ZstdCompressor(level=1)
        self.width, self.parts, self.size = width, [_MAGIC], len(_MAGIC)
        self.block, self.block_size, self.last, self.first = [], 0, b"", b""
        self.index: list[list] = []
        self.keys: list[bytes] = []
        self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must be added in order")
        if not self.block:
            self.first = key
        shared = len(os.path.commonprefix([key, self.last]))
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.block_size += len(entry) + len(value)
        self.last = key
        self.keys.append(key)
        self.tokens += len(value) // self.width
        if self.block_size >= BLOCK:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            data = self.squeeze.compress(b"".join(self.block))
            self.index.append([self.first.hex(), self.size, len(data)])
            self.parts += [data, struct.pack("<I", zlib.crc32(data))]
            self.size += len(data) + 4
            self.block, self.block_size, self.last = [], 0, b""

    def finish(self) -> bytes:
        self._end_block()
        bits = max(64, -(-len(self.keys) * _BITS_PER_KEY // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        index, bloom = json.dumps(self.index).encode(), np.packbits(bloom, bitorder="little").tobytes()
        footer = json.dumps({"width": self.width, "records": len(self.keys), "tokens": self.tokens, "index": [self.size, len(index)], "filter": [self.size + len(index), len(bloom)], "bits": bits}).encode()
        return b"".join([*self.parts, index, bloom, footer, struct.pack("<I", len(footer)), _MAGIC])


class Shard:
    """Reads one shard."""

    def __init__(self, uri: str) -> None:
        import zstandard

        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        self.inflate = zstandard.ZstdDecompressor()
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != _MAGIC or self.file.read_at(len(_MAGIC), 0) != _MAGIC:
            raise ValueError(f"{uri} is no shard")
        n = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self.file.read_at(n, size - 12 - n))
        at, n = self.footer["index"]
        self.index = [(bytes.fromhex(k), at, n) for k, at, n in json.loads(self.file.read_at(n, at))]
        self.dtype = np.dtype(f"<u{self.footer['width']}")

    def block(self, n: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size = self.index[n]
        raw = self.file.read_at(size + 4, at)
        if zlib.crc32(raw[:size]) != struct.unpack("<I", raw[size:])[0]:
            raise ValueError("a block differs from its checksum")
        data, key, at = self.inflate.decompress(raw[:size], max_output_size=1 << 31), b"", 0
        while at < len(data):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + n]
            at += n

    def records(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for n in range(len(self.index)):
            for key, value in self.block(n):
                yield key, np.frombuffer(value, self.dtype)

    def may_have(self, key: bytes) -> bool:
        at, n = self.footer["filter"]
        bloom = self.file.read_at(n, at)
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.footer["bits"]))

    def get(self, doc: int | None) -> list[np.ndarray]:
        """The token ids of each record of a document."""
        key, out = key_of(doc), []
        if not self.may_have(key):
            return out
        n = max(0, bisect.bisect_left([k for k, *_ in self.index], key) - 1)  # its records may begin in the block before
        while n < len(self.index) and self.index[n][0] <= key:
            out += [np.frombuffer(v, self.dtype) for k, v in self.block(n) if k == key]
            n += 1
        return out


class Encoder:
    """A tokenizer that remembers the ids of words."""

    def __init__(self, path: str, width: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = width or (2 if max(vocabulary.values(), default=0) < 1 << 16 else 4)
        self.dtype = np.dtype(f"<u{self.width}")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        before, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.by_words = self.tokenizer.normalizer is None and isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space
        self.cuts = self.by_words and not any(" " in t for t in self.added)
        self.by_letters = self.by_words and isinstance(model, models.BPE) and not model.dropout
        if self.by_letters:  # how the model spells bytes
            spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.space, self.line = spell(" ")[0][0], np.array(self.newline, self.dtype).tobytes()
            self.spelt = {c: spell(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of keys of letters: each is one pre-token, so it goes to the tokenizer's model as it stands."""
        model, kind, out = self.tokenizer.model.tokenize, self.dtype.char, {}
        for k in keys:
            word = k if k.isascii() else k.translate(self.spelt)
            if k[0] in _MARKS:
                ids = array(kind, [t.id for t in model(word[1:])]).tobytes()
                out[k] = self.line + ids if k[0] == "\n" else ids
            else:
                out[k] = array(kind, [t.id for t in model(self.space + word)]).tobytes()
        return out

    def _words(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of each key's text. Printable words go as lines of one text, in which each line's end is a pre-token."""
        out = self._letters(list(filter(_LETTERS.fullmatch, keys))) if self.by_letters else {}
        if out:
            keys = [k for k in keys if k not in out]
        plain = [k for k in keys if k.isprintable() and k] if len(self.newline) == 1 else []  # of white space, only " " is printable
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" " + "\n ".join(plain)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == self.newline[0]) * ids.itemsize
            if len(ends) == len(plain) - 1:
                raw = ids.tobytes()
                out |= {k: raw[a:b] for k, a, b in zip(plain, [0, *(ends + ids.itemsize).tolist()], [*ends.tolist(), len(raw)], strict=True)}
        rest = [k for k in keys if k not in out]
        return out | dict(zip(rest, self._encode([k.lstrip(_FIRST + _JOIN) if k[:1] in (_FIRST, _JOIN, "\n") else " " + k for k in rest]), strict=True))

    def _recall(self, keys: list[str]) -> list[bytes]:
        """Ids of the keys' texts, remembered or new. Of two generations the older goes when the newer is full."""
        ids = list(map(self.known.get, keys))
        missed = [k for k, i in zip(keys, ids, strict=True) if i is None]
        if not missed:
            return ids
        fresh = {k: i for k, i in zip(missed, map(self.older.get, missed), strict=True) if i is not None}
        new = [k for k in missed if k not in fresh]
        if new:
            fresh |= self._words(new)
        ids = [fresh[k] if i is None else i for k, i in zip(keys, ids, strict=True)]
        if len(self.known) > WORDS // 2:
            self.known, self.older = {}, self.known
        self.known.update((k, i) for k, i in fresh.items() if len(k) <= WORD_CHARS)
        return ids

    def documents(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as bytes, whatever the texts' lengths."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(texts):
            if sizes[at] > SLICE:
                yield b"".join(x for part in self._parts(texts[at].as_py()) for x in self.encode(pa.array([part], pa.string())))
                at += 1
                continue
            upto = at + 1
            total = sizes[at]
            while upto < len(texts) and total + sizes[upto] <= SLICE:
                total += sizes[upto]
                upto += 1
            yield from self.encode(texts.slice(at, upto - at))
            at = upto

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while self.cuts and len(text) - at > PART:
            found = _CUT.search(text, at + PART)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as bytes.

        Texts are split before each space and, where no other white space is near, before each line end and before the
        punctuation that ends a word: pre-tokens end there. Words become numbers of a dictionary in Arrow, so only distinct ones become Python objects, and their ids
        are put together by a take. A key stands for a space and itself; with a line end in front for itself; with
        _FIRST or _JOIN in front for what follows that. Texts where this could go wrong are encoded whole.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_words:
            return self._encode(texts.to_pylist())
        has = lambda t: pc.match_substring(texts, t)
        printable = pc.utf8_is_printable(pc.replace_substring(texts, "\n", ""))  # of white space, only " " and line ends
        others = pc.if_else(printable, "", texts)
        odd = reduce(pc.or_, [*map(has, ["  ", " \n", *self.added]), pc.match_substring_regex(others, f"[{_FIRST}{_JOIN}]|{_SPACE} {_SPACE}")])
        lines = pc.and_not(printable, pc.or_(has("\n "), has("\n\n")))
        tails = pc.replace_substring_regex(pc.replace_substring(pc.if_else(lines, texts, ""), "\n", " \n"), _TAIL, _TAIL_KEY)
        split = pc.if_else(lines, tails, texts)
        pieces = pc.split_pattern(pc.if_else(odd, "", pc.binary_join_element_wise(_FIRST, split, "")), " ")
        numbers = pieces.flatten().dictionary_encode()
        taken = pa.array(self._recall(numbers.dictionary.to_pylist()), pa.binary()).take(numbers.indices)
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int32, len(taken) + 1) if len(taken) else np.zeros(1, np.int32)
        bounds = ends[np.asarray(pieces.offsets)].tolist()
        raw = data.to_pybytes() if data else b""
        out = [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for n, i in zip(whole, self._encode([texts[n].as_py() for n in whole]), strict=True):
            out[n] = i
        return out


_encoders: dict[tuple, Encoder] = {}


def _write(folder: str, tokenizer: str, end_id: int, width: int | None, roll: int):
    """For mapInArrow over sorted (id, text): a row (path, part, nth, records, tokens) for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, width) not in _encoders:
            _encoders[tokenizer, width] = Encoder(tokenizer, width)
        encoder = _encoders[tokenizer, width]
        end = np.array([end_id], encoder.dtype).tobytes()
        part, nth, shard = TaskContext.get().partitionId(), 0, ShardWriter(encoder.width)

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{nth:04d}-{uuid.uuid4().hex}.sst"
            write(path, shard.finish())
            return pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "records": pa.array([len(shard.keys)], pa.int64()), "tokens": pa.array([shard.tokens], pa.int64())})

        for b in batches:
            for doc, ids in zip(b.column("id").to_pylist(), encoder.documents(b.column("text")), strict=True):
                shard.add(key_of(doc), ids + end)
                if shard.size >= roll:
                    yield flush()
                    nth, shard = nth + 1, ShardWriter(encoder.width)
        if shard.keys:
            yield flush()

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, width: int | None = None, id_col: str = "doc_id", text_col: str = "text", roll: int = ROLL) -> DataFrame:
    """Writes shards into ``folder``; (path, part, nth, records, tokens, base) of each finished one, base being the tokens of all shards before it.

    ``width`` is the bytes of an id, 2 or 4; by default what the vocabulary's largest id needs.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK + 1)
    ordered = rows.repartitionByRange(tasks, "id").sortWithinPartitions("id", "text")
    shards = Scratch(spark, "token-manifest").cut(ordered.mapInArrow(_write(folder, tokenizer, end_id, width, roll), "path string, part int, nth int, records bigint, tokens bigint"))
    held = shards.withColumn("block", F.floor(F.col("part") / NUMBERED))
    line = Window.partitionBy("block").orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.groupBy("block").agg(F.sum("tokens").alias("all")).withColumn("first", F.coalesce(F.sum("all").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    based = held.withColumn("inner", F.coalesce(F.sum("tokens").over(line), F.lit(0))).join(blocks, "block")
    return based.select("path", "part", "nth", "records", "tokens", (F.col("first") + F.col("inner")).alias("base"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (path, base): a row for each record."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in batches:
        for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
            rows: list[tuple] = []
            for key, ids in Shard(path).records():
                rows.append((id_of(key), base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                base += len(ids)
                if len(rows) == 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)


def read_tokens(shards: DataFrame) -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every record, read from the shards' files."""
    n = max(1, min(100_000, shards.count()))
    return shards.select("path", "base").repartition(n).mapInArrow(_read, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as shards of byte-level BPE ids and read back from them."""
    import public_tokenizers

    shards = write_tokens(spark, table(spark, sf_dir, "documents"), new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(shards).withColumnRenamed("id", "doc_id")
