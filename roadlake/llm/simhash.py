"""SimHash fingerprints and near-duplicate groups.

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's word shingles. Equal fingerprints are one
class; links between classes are looked for by pigeonring filtering (Qin and Xiao, 2018). The bits are split into m
segments on a ring. If two fingerprints differ in at most t bits, some segment starts a chain in which, for every l, the
first l consecutive segments differ in at most l * t / m bits together. A chain of c segments then holds at least
c - floor(c * t / m) equal ones, and the budgets say which sets of places those can be: each such set is a key under
which classes meet. Pairs that meet go through the chain's cumulative budgets before the full Hamming check.

A meeting place is one run of rows sorted by key. Its classes are joined with a leader first, and only classes of
different groups are compared after that, so a dense ball of near copies costs about one comparison a class. It emits
the edges of a spanning forest, never all pairs. Runs longer than BLOCK are dealt out as pairs of blocks, so no task
holds an unbounded group. Components follow by star rounds over the classes' least ids.

``wide_groups`` serves a looser similarity (Jaccard of shingles of 0.8 and more), which no number of differing bits stands
for. The same pigeonring search on the first 64 bits of the fingerprints of the sets of shingles comes first, and its links
are counted. For the rest texts meet under shingles (``jaccard``), fingerprints of 256 bits drop the pairs that differ in
more bits than such a similarity leaves room for, and the shingles of the other pairs are counted.

Defined results: a null or empty text has no words and the fingerprint zero, linked like any other; rows with a null id
are returned with a null component and link nothing; repeated rows are all returned; empty tables give no rows; other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm.components import components
from roadlake.llm.fingerprints import LOWER as _LOWER
from roadlake.llm.fingerprints import simhash
from roadlake.llm.jaccard import jaccard_groups
from roadlake.llm.shared import Scratch, table

SEED = 42
_SPACES = b" \t\n\x0b\x0c\r"  # what bytes.split() takes as white space
#: Rows of one run that are compared in one task.
BLOCK = 1 << 14
#: Runs of up to this many rows are compared all together with array operations.
SHORT = 16


def shingles(text: bytes, size: int) -> list[bytes]:
    """Space-joined runs of ``size`` lower-cased words, repeats included; of fewer words, all of them."""
    words = text.translate(_LOWER).split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    return [joined[a : b - 1] for a, b in zip(at, at[size:], strict=False)]


def _fingerprints(size: int):
    """For mapInArrow over (id, text): (id, f0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            out = np.zeros(len(b), "<u8")
            for row, text in enumerate(b.column("text").cast(pa.binary())):
                hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles(text.as_py() or b"", size)], "<u8")
                if len(hashes):
                    out[row] = simhash(hashes, 1)[0]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out.view("<i8"))], ["id", "f0"])

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id and f0, the 64-bit SimHash of each row."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, f0 bigint"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(size), schema)


class Ring:
    """The segments of 64 bits on a ring, the budgets of a chain, and the keys that no pair within t bits can miss."""

    def __init__(self, t: int, segments: int, chain: int) -> None:
        edges = [round(64 * n / segments) for n in range(segments + 1)]
        self.t, self.chain = t, chain
        self.masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        self.budgets = [n * t // segments for n in range(1, chain + 1)]
        free = self.budgets[-1]
        found: dict[tuple[int, ...], list[int]] = {}
        for differing in combinations(range(chain), self.budgets[-1]):
            if all(sum(d < n for d in differing) <= self.budgets[n - 1] for n in range(1, chain + 1)):
                for start in range(segments):
                    found.setdefault(tuple(sorted((start + p) % segments for p in range(chain) if p not in differing)), []).append(start)
        self.keys = sorted(found.items())
        self.key_masks = [sum(self.masks[p] for p in k) for k, _ in self.keys]

    def passes(self, x: np.ndarray, slot: int) -> np.ndarray:
        """Whether the differing bits x keep the budgets along a chain that has this slot's key."""
        viable = np.zeros(x.shape, bool)
        for start in self.keys[slot][1]:
            total, good = np.zeros(x.shape, np.uint8), np.ones(x.shape, bool)
            for n, most in enumerate(self.budgets):
                total += np.bitwise_count(x & np.uint64(self.masks[(start + n) % len(self.masks)]))
                good &= total <= most
            viable |= good
        return viable


def _near(ring: Ring, slot: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a and b differ in at most ring.t bits; the chain's budgets come first."""
    x = a ^ b
    good = ring.passes(x, slot)
    good[good] = np.bitwise_count(x[good]) <= ring.t
    return good


def _forest(ring: Ring, slot: int, f: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the rows of f."""
    n = len(f)
    root = np.arange(n)
    edges: list[tuple[int, int]] = []
    waiting, leaders = np.arange(n), []
    while len(waiting):  # each leader takes what is near it: those form one group from now on
        lead = int(waiting[0])
        near = _near(ring, slot, f[lead], f[waiting])
        near[0] = True
        edges += [(lead, int(i)) for i in waiting[near][1:]]
        root[waiting[near]] = lead
        leaders.append(lead)
        waiting = waiting[~near]
    # What remains are links between members of different groups; the largest group need not ask.
    members = {lead: np.flatnonzero(root == lead) for lead in leaders} if len(leaders) > 1 else {}
    for lead in sorted(members, key=lambda k: len(members[k]))[:-1]:
        for i in members[lead]:
            others = np.flatnonzero(root != root[i])
            if not len(others):
                return edges
            for j in others[_near(ring, slot, f[i], f[others])]:
                if root[i] != root[j]:
                    edges.append((int(i), int(j)))
                    root[root == root[j]] = root[i]
    return edges


def _runs(ring: Ring):
    """For mapInArrow over rows sorted by (slot, key, part): (u, v) edges between classes' least ids."""

    def short(f: np.ndarray, group: np.ndarray, slot: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links inside runs of up to SHORT rows, by comparing the rows with themselves moved by 1, 2, ..."""
        for step in range(1, SHORT):
            same = np.flatnonzero(group[step:] == group[:-step])
            if not len(same):
                return
            near = same[_near(ring, slot, f[same], f[same + step])]
            yield near, near + step

    def work(slot: int, key: np.ndarray, part: np.ndarray, f: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        change = np.ones(len(key), bool)
        change[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(change) - 1
        sizes = np.bincount(group)
        rows = np.flatnonzero(sizes[group] <= SHORT)
        for a, b in short(f[rows], group[rows], slot):
            yield from zip(ids[rows[a]], ids[rows[b]], strict=True)
        starts = np.flatnonzero(change)
        for g in np.flatnonzero(sizes > SHORT):
            at = starts[g]
            for a, b in _forest(ring, slot, f[at : at + sizes[g]]):
                yield ids[at + a], ids[at + b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table_: pa.Table) -> pa.RecordBatch:
            slots, key, part, ids = (table_.column(c).to_numpy() for c in ("slot", "key", "part", "rep"))
            f = table_.column("f0").to_numpy().view(np.uint64)
            found = set()
            for slot in np.unique(slots):  # the rows are sorted by slot
                at = slice(np.searchsorted(slots, slot, "left"), np.searchsorted(slots, slot, "right"))
                found.update((min(a, b), max(a, b)) for a, b in work(int(slot), key[at], part[at], f[at], ids[at]))
            u, v = ([e[n] for e in found] for n in (0, 1))
            kind = table_.schema.field("rep").type
            return pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], ["u", "v"])

        rows = 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= 4 * BLOCK:  # up to the last run, which may go on
                t = pa.Table.from_batches(held)
                slot, key, part = (t.column(c).to_numpy() for c in ("slot", "key", "part"))
                same = (slot == slot[-1]) & (key == key[-1]) & (part == part[-1])
                cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield flush(t.slice(0, cut))
                    rest = t.slice(cut)
                    held, rows = rest.combine_chunks().to_batches(), len(rest)
        if held and rows:
            yield flush(pa.Table.from_batches(held))

    return run


def _link(scratch: Scratch, keyed: DataFrame, ring: Ring) -> DataFrame:
    """Edges (u, v) of spanning forests of all meeting places. ``keyed``: slot, key, rep, f0."""
    long_runs = scratch.cut(keyed.groupBy("slot", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    part = F.lit(0).cast("bigint")
    if long_runs.limit(1).count():
        blocks = F.ceil(F.col("n") / BLOCK).cast("bigint")
        mine = F.pmod(F.xxhash64("rep"), blocks)
        pair = lambda o: F.least(mine, o) * blocks + F.greatest(mine, o)
        dealt = keyed.join(long_runs, ["slot", "key"], "left").withColumn("part", F.when(F.col("n").isNull(), F.array(part)).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), pair)))
        keyed = dealt.withColumn("part", F.explode("part")).drop("n")
    else:
        keyed = keyed.withColumn("part", part)
    rep = dict(keyed.dtypes)["rep"]
    # "part" belongs to the partitioning so that the blocks of a long run spread over tasks.
    return keyed.select("slot", "key", "part", "rep", "f0").repartition("slot", "key", "part").sortWithinPartitions("slot", "key", "part").mapInArrow(_runs(ring), f"u {rep}, v {rep}")


def _keyed(classes: DataFrame, ring: Ring) -> DataFrame:
    """(slot, key, rep, f0): each class of (rep, f0) under every key of the ring."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in ring.key_masks]
    each = F.explode(F.array(*[F.struct(F.lit(n).cast("short").alias("slot"), F.col("f0").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(signed)]))
    return classes.withColumn("_k", each).select("_k.slot", "_k.key", "rep", "f0")


def simhash_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, max_bits: int = 4) -> DataFrame:
    """id, fingerprint (64 bits as a long), component_id: exact components of the links at ``max_bits`` (up to 4) or fewer bits."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the chain keys are selective up to 4 bits; use wide_groups beyond")
    scratch = Scratch(spark, "simhash")
    prints = scratch.cut(fingerprints(docs, id_col, text_col, size))
    ring = Ring(max_bits, 6, 4) if max_bits == 4 else Ring(max_bits, max_bits + 1, 1)
    classes = scratch.cut(prints.where("id is not null").groupBy("f0").agg(F.min("id").alias("rep")))
    found = components(spark, scratch.cut(_link(scratch, _keyed(classes, ring), ring)), scratch)
    named = classes.join(found, classes["rep"] == found["node"], "left").select("f0", F.coalesce("component", "rep").alias("component"))
    out = prints.join(named, "f0", "left")
    return out.select(F.col("id").alias(id_col), F.col("f0").alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def wide_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """id, component_id and the text's text_hash and text_chars: exact components of the links between texts whose shingles have a Jaccard similarity of 0.8 or more.

    The hash (``jaccard.text_hash``) and length tell rows apart that share an id and have different texts.
    """
    ring = Ring(4, 6, 4)

    def links(scratch: Scratch, classes: DataFrame) -> DataFrame:
        return _link(scratch, _keyed(classes.withColumnRenamed("cid", "rep"), ring), ring)

    out = jaccard_groups(spark, docs, id_col, text_col, size, links)
    return out.select(F.col("id").alias(id_col), F.col("component").alias("component_id"), F.col("hash").alias("text_hash"), F.col("chars").alias("text_chars"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_groups(spark, table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
