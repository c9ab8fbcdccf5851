"""Removal of byte strings that repeat across documents, exact to the byte.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. Sorting every suffix
of a corpus in one place is out of the question, so suffixes are dealt out by content first: every window of LENGTH
bytes names the smallest hash among its GRAM-byte strings (a minimizer, found with prefix polynomial hashes), and equal
windows name equal anchors. A context is the stretch of windows in a row that name one anchor; each window is in exactly
one context, and only contexts under equal anchors can share one. Then

1. tasks find the anchors of their documents. A context that the task saw in a smaller document is removed right there;
   the others ship their anchor's hash and place,
2. anchors that one document alone has are dropped,
3. the others fetch their context's bytes from the text,
4. each anchor's contexts are suffix-sorted: a radix pass over the first bytes, then a mergesort whose comparisons
   find the common extension by binary search over prefix hashes, so a comparison takes logarithmic time. Equal strings
   are neighbours in that order; they are verified byte by byte, and a chunk with a collision is grouped by its bytes
   instead. Runs of equal contexts collapse to one with the least id; where an anchor has several contexts, their windows
   are suffix-sorted the same way,
5. the spans are cut out of the texts.

No anchor gathers in one task. A context that a task has seen in a smaller document never travels, so a passage that a
third of all documents share ships about once a group of GROUP bytes. The contexts at such a passage's ends differ from
document to document; an anchor with more than CROWD of them in a group, or more than HOT in all, is crowded: its contexts
are dealt as single windows, each under a hash of its own bytes, after the group's repeats of a window are removed.

Defined results: a null text counts as empty; texts shorter than LENGTH keep all; rows with a null id keep all and count
as no document for others; rows with one id are no smaller than each other (64-bit hashes of their texts tell them apart); an empty table gives no
rows; other columns are not read, so their names can't clash. Long texts are hashed in pieces. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm.shared import Scratch, table

LENGTH = 50
GRAM = 18
#: Bytes of text that are hashed at a time; it takes some 60 times as much memory.
PIECE = 1 << 18
#: Bytes of texts whose contexts a task ships together.
GROUP = 8 << 20
#: Bytes of text that one bucket of anchors stands for.
BUCKET = 4 << 20
#: Contexts of one anchor, in a group or in all, beyond which they are dealt as single windows.
CROWD, HOT = 256, 1 << 15
#: Bytes of contexts, and windows, that are sorted at a time, unless one anchor alone has more.
CHUNK, WINDOWS = 1 << 20, 1 << 16
#: Bytes by which strings are sorted before the mergesort.
RADIX = 16

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ANCHOR = np.dtype([("a", "<u8"), ("s", "<u4"), ("n", "u1")])
_SPAN = np.dtype([("s", "<u4"), ("e", "<u4")])  # Spark's strings end below 2 ** 31 bytes
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, 1 << 16), np.uint64(base))
            p[0] = 1
            _tables[name] = np.cumprod(p)
    return _tables["up"], _tables["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class PrefixHash:
    """Polynomial hashes, modulo 2 ** 64, of any substring of a buffer."""

    def __init__(self, buffer: np.ndarray) -> None:
        self.up, self.down = _powers(len(buffer) + 1)
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * self.up[: len(buffer)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _extension(ph: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, up to ``most``, by binary search over prefix hashes."""
    low, high = np.zeros_like(most), most.copy()
    for _ in range(int(most.max(initial=0)).bit_length()):
        mid = (low + high + 1) >> 1
        same = ph.of(a, a + mid) == ph.of(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _compare(ph: PrefixHash, buffer: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for the suffixes at a (na bytes) and b (nb bytes)."""
    most = np.minimum(na, nb)
    out = np.sign(na - nb)
    unequal = np.flatnonzero((ph.of(a, a + most) != ph.of(b, b + most)))
    if len(unequal):
        a, b, most = a[unequal], b[unequal], most[unequal]
        n = _extension(ph, a, b, most)
        out[unequal] = np.where(n < most, np.sign(buffer[np.minimum(a + n, len(buffer) - 1)].astype(np.int64) - buffer[np.minimum(b + n, len(buffer) - 1)]), out[unequal])
    return out


def suffix_sort(ph: PrefixHash, buffer: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stable order of the suffixes within their groups; ``group`` must be sorted.

    Bottom-up mergesort of all groups at once: an element's place in a merged run is its own place plus the number of
    elements of the other half that go before it, found by binary search with `_compare`.
    """
    n = len(group)
    order = np.arange(n)
    if not n:
        return order
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, n])
    base, total = np.repeat(first, sizes), np.repeat(sizes, sizes)
    width = 1
    while width < sizes.max():
        at = np.flatnonzero(total > width)  # elements of groups that are not whole runs yet
        place = at - base[at]
        left = base[at] + (place // (2 * width)) * (2 * width)
        mid = np.minimum(left + width, base[at] + total[at])
        right = np.minimum(left + 2 * width, base[at] + total[at])
        in_left = at < mid
        low, high = np.where(in_left, mid, left), np.where(in_left, right, mid)
        bottom = low.copy()
        mine = order[at]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            probe = (low[open_] + high[open_]) >> 1
            x, y = order[probe], mine[open_]
            c = _compare(ph, buffer, start[x], size[x], start[y], size[y])
            before = (c < 0) | ((c == 0) & ~in_left[open_])
            low[open_] = np.where(before, probe + 1, low[open_])
            high[open_] = np.where(before, high[open_], probe)
        to = np.where(in_left, at, left + (at - mid)) + (low - bottom)
        nxt = order.copy()
        nxt[to] = mine
        order = nxt
        width *= 2
    return order


def _same_bytes(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of ``size`` bytes at a and b are equal, byte by byte."""
    out = np.ones(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        part = slice(at, at + (1 << 16))
        n = size[part]
        ends = np.cumsum(n)
        inner = np.arange(ends[-1]) - np.repeat(ends - n, n)
        same = buffer[np.repeat(a[part], n) + inner] == buffer[np.repeat(b[part], n) + inner]
        out[part] = np.logical_and.reduceat(same, ends - n)
    return out


def _leading(buffer: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """n bytes, up to 8, of the strings at ``start`` as numbers that sort as the bytes do."""
    out = np.zeros(len(start), np.uint64)
    for at in range(n):
        out = (out << np.uint64(8)) | buffer[start + at].astype(np.uint64)
    return out


def _classes(ph: PrefixHash, buffer: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each element, equal for equal strings of one group and ascending with the group, which is sorted.

    Equal strings are neighbours in the suffix order. Strings that tie on their group and first bytes are mergesorted.
    """
    if not len(group):
        return np.zeros(0, np.int64)
    n = min(RADIX, int(size.min()))
    heads = [_leading(buffer, start + at, min(8, n - at)) for at in range(0, n, 8)]
    order = np.lexsort((*heads[::-1], group))
    tie = np.ones(len(order) - 1, bool)
    for x in (group, *heads):
        tie &= x[order][1:] == x[order][:-1]
    run = np.cumsum(np.r_[True, ~tie]) - 1
    some = np.flatnonzero(np.r_[tie, False] | np.r_[False, tie])
    inner = order[some]
    order[some] = inner[suffix_sort(ph, buffer, run[some], start[inner], size[inner])]
    a, b = order[:-1], order[1:]
    pairs = np.flatnonzero(tie & (size[a] == size[b]))
    pairs = pairs[ph.of(start[a[pairs]], start[a[pairs]] + size[a[pairs]]) == ph.of(start[b[pairs]], start[b[pairs]] + size[b[pairs]])]
    if not _same_bytes(buffer, start[a[pairs]], start[b[pairs]], size[a[pairs]]).all():  # a collision: group by the bytes
        raw = buffer.tobytes()
        text = lambda i: raw[start[i] : start[i] + size[i]]
        order = np.array(sorted(range(len(group)), key=lambda i: (group[i], text(i))), np.int64)
        a, b = order[:-1], order[1:]
        pairs = np.array([n for n in range(len(a)) if group[a[n]] == group[b[n]] and text(a[n]) == text(b[n])], np.int64)
    new = np.ones(len(group), bool)
    new[pairs + 1] = False
    out = np.empty(len(group), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _anchors(buffer: np.ndarray, ends: list[int], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, windows) of the contexts of the pieces of text that end at ``ends``."""
    windows = len(buffer) - length + 1
    none = np.zeros(0, np.uint64)
    if windows <= 0:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    ph = PrefixHash(buffer)
    at = np.arange(len(buffer) - gram + 1)
    hashes = _mix(ph.of(at, at + gram))
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # of equal ones, the leftmost
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: windows], least[span - width :])
    whole = np.ones(windows, bool)
    for end in ends:  # windows that would reach over a piece's end
        whole[max(0, end - length + 1) : end] = False
    places = np.flatnonzero(whole)
    if not len(places):
        return none, none, none.astype(np.int64), none.astype(np.int64)
    named = (least[places] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (places[1:] != places[:-1] + 1)])
    first, count = places[new], np.diff(np.r_[new, len(places)])
    context = ph.of(first, first + count + length - 1) + (named[new] - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + count.astype(np.uint64)
    return hashes[named[new]], _mix(context), first, count


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of a structured array as binary values."""
    raw = np.ascontiguousarray(data)
    offsets = (bounds * raw.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def _by_doc(ids: np.ndarray, tags: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids, tags, values): the data of each document as one binary value."""
    order = np.lexsort((tags, ids))
    ids, tags, data = ids[order], tags[order], data[order]
    new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]) if len(ids) else np.zeros(0, np.int64)
    return ids[new], tags[new], _binary(data, np.r_[new, len(ids)])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that few texts are Python objects at once."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


_SHIPPED = "bucket bigint, ids binary, tags binary, doc binary, anchors binary, contexts binary"


def _ship(buckets: int, ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, records: np.ndarray, contexts=None) -> pa.RecordBatch:
    """A row for each bucket: its records, their documents, and the bytes of their contexts."""
    bucket = ((records["a"] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows: list[tuple] = []
    new = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(new, np.r_[new[1:], len(order)], strict=True):
        mine = order[a:b]
        docs, index = np.unique(doc[mine], return_inverse=True)
        rows.append((int(bucket[mine[0]]), ids[docs].tobytes(), tags[docs].tobytes(), index.astype("<u4").tobytes(), records[mine].tobytes(), contexts(mine) if contexts else None))
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    names = ["bucket", "ids", "tags", "doc", "anchors", "contexts"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if not n else pa.binary()) for n, c in enumerate(cols)], names)


def _unship(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tags, records) of all rows of a bucket."""
    ids, tags, records = [], [], []
    for i, g, d, a in zip(*(t.column(c).to_pylist() for c in ("ids", "tags", "doc", "anchors")), strict=True):
        index = np.frombuffer(d, "<u4")
        ids.append(np.frombuffer(i, "<i8")[index])
        tags.append(np.frombuffer(g, "<i8")[index])
        records.append(np.frombuffer(a, _ANCHOR))
    return np.concatenate(ids), np.concatenate(tags), np.concatenate(records)


def _local(serial: int, ids: np.ndarray, tags: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """Spans that a task has found, or contexts that it asks for as windows: they have no bucket and go along with any.

    Such a row has null ``anchors``; ``doc`` is null for spans and empty for contexts.
    """
    doc = b"" if data.dtype == _ANCHOR else None
    rows = [pa.array([serial], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, tags)), pa.array([doc], pa.binary()), pa.array([None], pa.binary()), pa.array([data.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(rows, ["bucket", "ids", "tags", "doc", "anchors", "contexts"])


def _find(buckets: int, length: int, gram: int):
    """For mapInArrow over (id, tag, text): rows of _SHIPPED; spans found by the task itself have null anchors."""

    def flush(texts: list[bytes], ids: list[int], tags: list[int], serial: int) -> Iterator[pa.RecordBatch]:
        joined = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.r_[0, np.cumsum([len(x) for x in texts])]
        parts = []
        piece: list[tuple[int, int, int]] = []  # (document, from, to) in joined

        def hashed() -> None:
            if not piece:
                return
            buffer = np.concatenate([joined[a:b] for _, a, b in piece])
            ends = np.cumsum([b - a for _, a, b in piece])
            a, c, first, count = _anchors(buffer, ends.tolist(), length, gram)
            which = np.searchsorted(ends, first, "right")
            moved = np.array([x for _, x, _ in piece]) - np.r_[0, ends[:-1]]
            parts.append((a, c, first + moved[which], count, np.array([d for d, *_ in piece])[which]))
            piece.clear()

        held = 0
        for n in range(len(texts)):
            at, end = int(offsets[n]), int(offsets[n + 1])
            while end - at >= length:  # a long text is hashed in pieces that overlap by a window less a byte
                upto = min(end, at + PIECE + length - 1)
                piece.append((n, at, upto))
                held += upto - at
                if held >= PIECE:
                    hashed()
                    held = 0
                if upto == end:
                    break
                at = upto - length + 1
        hashed()
        if not parts:
            return
        anchor, context, place, count, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids_, tags_ = np.array(ids, "<i8"), np.array(tags, "<i8")
        owner = ids_[doc]
        order = np.lexsort((owner, context))
        new = np.r_[True, context[order][1:] != context[order][:-1]]
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        again = np.flatnonzero(owner[order] > owner[first])
        mine, other = order[again], first[again]
        same = count[mine] == count[other]
        mine, other = mine[same], other[same]
        mine = mine[_same_bytes(joined, place[mine], place[other], count[mine] + length - 1)] if len(mine) else mine
        inside = place - offsets[doc]
        keep = np.ones(len(doc), bool)
        keep[mine] = False
        records = np.zeros(int(keep.sum()), _ANCHOR)
        records["a"], records["s"], records["n"] = anchor[keep], inside[keep], count[keep]
        doc_ = doc[keep]
        _, which, times = np.unique(records["a"], return_inverse=True, return_counts=True)
        crowded = times[which] > CROWD
        if crowded.any():
            yield _local(serial % buckets, ids_[doc_[crowded]], tags_[doc_[crowded]], records[crowded])
            said = np.zeros(int((times > CROWD).sum()), _ANCHOR)  # a record without windows says that its anchor is crowded
            said["a"] = np.unique(records["a"][crowded])
            records, doc_ = np.concatenate([records[~crowded], said]), np.r_[doc_[~crowded], np.zeros(len(said), doc_.dtype)]
        yield _ship(buckets, ids_, tags_, doc_, records)
        if len(mine):
            spans = np.zeros(len(mine), _SPAN)
            spans["s"], spans["e"] = inside[mine], inside[mine] + count[mine] + length - 1
            spans, doc_ = _joined_spans(spans, doc[mine])
            yield _local(serial % buckets, ids_[doc_], tags_[doc_], spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        ids: list[int] = []
        tags: list[int] = []
        held = 0
        for b in _slices(batches):
            for i, g, x in zip(b.column("id").to_pylist(), b.column("tag").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if i is None or x is None or len(x) < length:
                    continue
                texts.append(x)
                ids.append(i)
                tags.append(g)
                held += len(x)
                if held >= GROUP:
                    yield from flush(texts, ids, tags, ids[0] & 0x7FFFFFFF)
                    texts, ids, tags, held = [], [], [], 0
        if texts:
            yield from flush(texts, ids, tags, ids[0] & 0x7FFFFFFF)

    return run


def _joined_spans(spans: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of one document that touch or overlap become one."""
    if not len(spans):
        return spans, doc
    order = np.lexsort((spans["s"], doc))
    spans, doc = spans[order], doc[order]
    shift = np.r_[0, np.cumsum(doc[1:] != doc[:-1])].astype(np.int64) << 32  # documents one after the other
    reach = np.maximum.accumulate(spans["e"].astype(np.int64) + shift)
    new = np.flatnonzero(np.r_[True, (spans["s"].astype(np.int64) + shift)[1:] > reach[:-1]])
    last = np.r_[new[1:], len(spans)] - 1
    out = np.zeros(len(new), _SPAN)
    out["s"], out["e"] = spans["s"][new], reach[last] - shift[last]
    return out, doc[new]


#: Kinds of found rows: contexts to fetch, spans to remove, contexts to fetch as windows.
_ASK, _GONE, _SINGLY = 0, 1, 2
_FOUND = "kind int, id bigint, tag bigint, data binary"


def _found(kind: int, ids: np.ndarray, tags: np.ndarray, data: np.ndarray) -> pa.Table:
    ids, tags, data = _by_doc(ids, tags, data)
    return pa.table({"kind": pa.array(np.full(len(ids), kind, np.int32)), "id": pa.array(ids.astype(np.int64)), "tag": pa.array(tags.astype(np.int64)), "data": data})


def _nothing() -> pa.Table:
    return _found(_ASK, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _SPAN))


def _passed(t: pa.Table) -> Iterator[pa.Table]:
    """The rows of ``_local``."""
    local = t.filter(t.column("anchors").is_null())
    for i, g, d, x in zip(*(local.column(c).to_pylist() for c in ("ids", "tags", "doc", "contexts")), strict=True):
        ids, tags = np.frombuffer(i, "<i8"), np.frombuffer(g, "<i8")
        yield _found(_GONE, ids, tags, np.frombuffer(x, _SPAN)) if d is None else _found(_SINGLY, ids, tags, np.frombuffer(x, _ANCHOR))


def _shared(t: pa.Table) -> pa.Table:
    """A bucket's contexts whose anchors two documents have, by document, and what the tasks pass on."""
    out = [_nothing(), *_passed(t)]
    t = t.filter(t.column("anchors").is_valid())
    if len(t):
        ids, tags, records = _unship(t)
        order = np.argsort(records["a"], kind="stable")
        a, i, n = records["a"][order], ids[order], records["n"][order]
        new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        times = np.diff(np.r_[new, len(a)])
        singly = (times > HOT) | (np.minimum.reduceat(n, new) == 0)
        several = np.minimum.reduceat(i, new) != np.maximum.reduceat(i, new)
        for kind, anchors in ((_ASK, several & ~singly), (_SINGLY, singly)):
            keep = order[np.repeat(anchors, times) & (n > 0)]
            out.append(_found(kind, ids[keep], tags[keep], records[keep]))
    return pa.concat_tables(out)


def _windows(joined: np.ndarray, at: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of the contexts at ``at``, one after the other."""
    out = []
    size = count + length - 1
    step = max(1, PIECE // (2 * length))
    for low in range(0, len(at), step):
        n, c = size[low : low + step], count[low : low + step]
        base = np.cumsum(n) - n
        buffer = joined[np.repeat(at[low : low + step] - base, n) + np.arange(n.sum())]
        begin = np.repeat(base - (np.cumsum(c) - c), c) + np.arange(c.sum())
        out.append(_mix(PrefixHash(buffer).of(begin, begin + length)))
    return np.concatenate(out)


def _fetch(buckets: int, length: int):
    """For mapInArrow over (id, tag, asked, text): rows of _SHIPPED with the contexts' bytes."""

    def flush(texts: list[bytes], asked: list[np.ndarray], singly: list[np.ndarray], ids: list[int], tags: list[int]) -> Iterator[pa.RecordBatch]:
        import zstandard

        joined = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.r_[0, np.cumsum([len(x) for x in texts])][:-1]
        ids_, tags_ = np.array(ids, "<i8"), np.array(tags, "<i8")
        records, doc = np.concatenate(asked), np.repeat(np.arange(len(texts)), [len(a) for a in asked])
        crowded, owners = np.concatenate(singly), np.repeat(np.arange(len(texts)), [len(a) for a in singly])
        if len(crowded):
            count = crowded["n"].astype(np.int64)
            each = np.zeros(int(count.sum()), _ANCHOR)
            each["a"] = _windows(joined, crowded["s"].astype(np.int64) + offsets[owners], count, length)
            each["s"] = np.repeat(crowded["s"] - (np.cumsum(count) - count), count) + np.arange(len(each))
            each["n"] = 1
            owners = np.repeat(owners, count)
            order = np.lexsort((ids_[owners], each["a"]))
            each, owners = each[order], owners[order]
            head = np.maximum.accumulate(np.where(np.r_[True, each["a"][1:] != each["a"][:-1]], np.arange(len(each)), 0))
            at = each["s"].astype(np.int64) + offsets[owners]
            again = np.flatnonzero(ids_[owners] > ids_[owners[head]])
            again = again[_same_bytes(joined, at[again], at[head[again]], np.full(len(again), length))]
            if len(again):
                spans = np.zeros(len(again), _SPAN)
                spans["s"], spans["e"] = each["s"][again], each["s"][again] + length
                spans, of = _joined_spans(spans, owners[again])
                yield _local(ids[0] % buckets, ids_[of], tags_[of], spans)
            stay = np.ones(len(each), bool)
            stay[again] = False
            records, doc = np.concatenate([records, each[stay]]), np.r_[doc, owners[stay]]
        squeeze = zstandard.ZstdCompressor(level=3)
        at, size = records["s"].astype(np.int64) + offsets[doc], records["n"].astype(np.int64) + length - 1

        def contexts(rows: np.ndarray) -> bytes:
            n = size[rows]
            ends = np.cumsum(n)
            return squeeze.compress(joined[np.repeat(at[rows] - (ends - n), n) + np.arange(ends[-1])].tobytes())

        yield _ship(buckets, ids_, tags_, doc, records, contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, _ANCHOR)
        held: list[list] = [[], [], [], [], []]
        size = 0
        for b in _slices(batches):
            cols = [b.column(c).to_pylist() for c in ("id", "tag", "asked", "singly")]
            for i, g, d, w, x in zip(*cols, b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                records, windows = (np.frombuffer(b"".join(v), _ANCHOR) if v else none for v in (d, w))
                for to, value in zip(held, (x, records, windows, i, g), strict=True):
                    to.append(value)
                size += len(x) + 100 * len(records) + 50 * int(windows["n"].sum())
                if size >= GROUP:
                    yield from flush(*held)
                    held, size = [[], [], [], [], []], 0
        if held[0]:
            yield from flush(*held)

    return run


def _spans(buffer: np.ndarray, group: np.ndarray, start: np.ndarray, count: np.ndarray, ids: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(spans, element of each) of the windows that a smaller document of the group has too; ``group`` is sorted."""
    ph = PrefixHash(buffer)
    klass = _classes(ph, buffer, group, start, count + length - 1)
    by = np.argsort(klass, kind="stable")
    head = np.flatnonzero(np.r_[True, np.diff(klass[by]) != 0])
    rep, least = by[head], np.minimum.reduceat(ids[by], head)
    rep_group = group[rep]
    several = np.repeat(*(lambda n: (n > 1, n))(np.bincount(rep_group)[np.unique(rep_group)]))  # class of an anchor with others
    # The least id of each window of each class.
    n_windows = count[rep]
    base = np.cumsum(n_windows) - n_windows
    low = np.repeat(least, n_windows)
    todo = np.flatnonzero(several)
    at = 0
    while at < len(todo):  # whole anchors, up to WINDOWS windows at a time
        upto = at + max(1, int(np.searchsorted(np.cumsum(n_windows[todo[at:]]), WINDOWS, "right")))
        while upto < len(todo) and rep_group[todo[upto]] == rep_group[todo[upto - 1]]:
            upto += 1
        c = todo[at:upto]
        n = n_windows[c]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where = np.repeat(base[c], n) + inner
        begin = np.repeat(start[rep[c]], n) + inner
        same = _classes(ph, buffer, np.repeat(rep_group[c], n), begin, np.full(len(begin), length))
        o = np.argsort(same, kind="stable")
        h = np.flatnonzero(np.r_[True, np.diff(same[o]) != 0])
        low[where[o]] = np.repeat(np.minimum.reduceat(low[where[o]], h), np.diff(np.r_[h, len(o)]))
        at = upto
    spans, owners = [np.zeros(0, _SPAN)], [np.zeros(0, np.int64)]
    for a in range(0, len(ids), max(1, WINDOWS // 4)):
        part = slice(a, a + max(1, WINDOWS // 4))
        n = count[part]
        rows = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(ids[part][rows] > low[base[klass[part]][rows] + inner])
        if not len(hit):
            continue
        new = np.flatnonzero(np.r_[True, (rows[hit][1:] != rows[hit][:-1]) | (inner[hit][1:] != inner[hit][:-1] + 1)])
        last = np.r_[new[1:], len(hit)] - 1
        s = np.zeros(len(new), _SPAN)
        s["s"] = first[part][rows[hit[new]]] + inner[hit[new]]
        s["e"] = first[part][rows[hit[new]]] + inner[hit[last]] + length
        spans.append(s)
        owners.append(rows[hit[new]] + a)
    return np.concatenate(spans), np.concatenate(owners)


def _repeats(length: int):
    """For applyInArrow: the spans of a bucket's contexts that a smaller document has too."""

    def run(t: pa.Table) -> pa.Table:
        import zstandard

        out = [_nothing(), *_passed(t)]
        t = t.filter(t.column("anchors").is_valid())
        if not len(t):
            return pa.concat_tables(out)
        inflate = zstandard.ZstdDecompressor()
        ids, tags, records = _unship(t)
        data = np.frombuffer(b"".join(map(inflate.decompress, t.column("contexts").to_pylist())), np.uint8)
        size = records["n"].astype(np.int64) + length - 1
        at = np.cumsum(size) - size
        order = np.argsort(records["a"], kind="stable")
        anchor, upto = records["a"][order], np.cumsum(size[order])
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])  # where anchors start, and the end
        begin = 0
        while begin < len(new) - 1:  # whole anchors, up to CHUNK bytes at a time
            before = upto[new[begin] - 1] if new[begin] else 0
            end = max(begin + 1, int(np.searchsorted(upto[new[begin + 1 :] - 1], before + CHUNK, "right")) + begin)
            rows = order[new[begin] : new[end]]
            n = size[rows]
            start = np.cumsum(n) - n
            buffer = data[np.repeat(at[rows] - start, n) + np.arange(n.sum())]
            group = np.repeat(np.arange(end - begin), np.diff(new[begin : end + 1]))
            spans, owner = _spans(buffer, group, start, records["n"][rows].astype(np.int64), ids[rows], records["s"][rows].astype(np.int64), length)
            out.append(_found(_GONE, ids[rows][owner], tags[rows][owner], spans))
            begin = end
        return pa.concat_tables(out)

    return run


def _cut(keep_bytes: bool):
    """For mapInArrow over (id, text, data): what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            size, gone, runs, digest, kept = [], [], [], [], []
            for x, d in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("data").to_pylist(), strict=True):
                x = x or b""
                n = 0
                spans = np.zeros(0, _SPAN)
                left = x
                if d:
                    spans = np.frombuffer(b"".join(d), _SPAN)
                    spans, _ = _joined_spans(spans, np.zeros(len(spans), np.int64))
                    n = int((spans["e"].astype(np.int64) - spans["s"]).sum())
                    starts, ends = [0, *spans["e"].tolist()], [*spans["s"].tolist(), len(x)]
                    left = b"".join(x[a:e] for a, e in zip(starts, ends, strict=True))
                size.append(len(x))
                gone.append(n)
                runs.append(len(spans))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            cols = {"id": b.column("id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if keep_bytes:
                cols["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with ``keep_bytes``, kept (binary)."""
    if not 0 < gram <= length <= 255:
        raise ValueError("gram must be from 1 to length, and length at most 255")
    scratch = Scratch(spark, "repeats")
    ids = docs.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null")
    repeated = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    # The tag tells rows with one id and different texts apart; it travels with all records, so it is 0 where no id repeats.
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), (F.xxhash64(text_col) if repeated else F.lit(0).cast("bigint")).alias("tag"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = total // BUCKET + 1
    shared = rows.mapInArrow(_find(buckets, length, gram), _SHIPPED).groupBy("bucket").applyInArrow(_shared, _FOUND)
    shared = scratch.cut(shared)
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("data")))
    asked = shared.where(F.col("kind") != _GONE).groupBy("id", "tag").agg(of(_ASK).alias("asked"), of(_SINGLY).alias("singly"))
    contexts = rows.join(asked, ["id", "tag"]).mapInArrow(_fetch(buckets, length), _SHIPPED)
    spans = scratch.cut(contexts.groupBy("bucket").applyInArrow(_repeats(length), _FOUND))
    every = spans.union(shared.where(F.col("kind") == _GONE)).groupBy("id", "tag").agg(F.collect_list("data").alias("data"))
    out = rows.join(every, ["id", "tag"], "left").select("id", "text", "data")
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_bytes
    return out.mapInArrow(_cut(keep_bytes), schema).withColumnRenamed("id", id_col)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without strings of 50 bytes that a smaller document has."""
    return remove_repeats(spark, table(spark, sf_dir, "documents"), keep_bytes=False)


OP6_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), g AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50 AND doc_id IS NOT NULL)
), m AS (
  SELECT s, min(doc_id) AS low FROM g GROUP BY s
), f AS (
  SELECT r, i, i > lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) + 50 AS new FROM g JOIN m USING (s) WHERE doc_id > low
), k AS (
  SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS nth FROM f
), p AS (
  SELECT r, nth, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY r, nth
), q AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM p
), c AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM q JOIN d USING (r) GROUP BY r
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""
