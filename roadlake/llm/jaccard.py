"""Groups of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, exactly.

Candidates come from prefix filtering (Chaudhuri et al., 2006; Xiao et al., 2008). All shingles have one order, common ones
last. Two sets that reach the similarity share a shingle among the first ``probe`` ones of the larger set and the first
``index`` ones of the smaller, so texts that meet under no such key can't be similar, whatever the order is. A sample says
which shingles are common: it affects the number of candidates and never the result. It is a share of the documents: with
a fixed number of them, shingles that are too rare for it would get longer runs as the input grows. Every candidate pair's similarity is
counted on the texts' own sets, and only pairs that reach the threshold are linked.

Most candidates share little, so fingerprints come first: the SimHash, of BITS bits, of each set of shingles. At a
similarity of 0.8 the cosine of two sets is 8/9 at least, so a bit differs with a chance of acos(8/9)/pi = 0.15 at most.
A pair of sets of LEAST shingles or more that differs in over MOST bits is dropped unread: of 256 bits, a pair of the
similarity has over 80 differing ones with a chance of 3e-11.

Equal sets are one class. Classes that the caller's ``links`` finds (pigeonring on the first word of the fingerprints) are
counted first; each has the least class that it is linked with as its label. Keys travel with labels, and classes of one
label don't meet again.

Keys travel as arrays dealt to buckets by key, and a bucket sorts its keys. A key brings the one before it in its set's
order: two classes with the same key before have met there, so a pair is given once for each stretch of keys that it
shares, not by each bucket that has one of them. Runs of up to SHORT
classes give their pairs at once. In longer ones each class meets the run's least class first, then those that its
fingerprint is nearest to, and all others at last; a pair whose classes are in one group by then is never counted. So a
ball of near copies costs a few comparisons a class. Runs beyond BLOCK are dealt out as pairs of blocks. The partners of
a class travel as one list; lists of one neighbourhood are counted together, PARTNERS of them at a time, so that a set of
shingles ships once for many pairs.

Shingles are told apart by 64-bit hashes, as are texts by hash and length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm.components import components
from roadlake.llm.fingerprints import LOWER, simhash
from roadlake.llm.shared import Scratch, conf

#: The least similarity as a fraction: exact in integers.
NUM, DEN = 4, 5
#: One of so many documents says which shingles are common, as do SAMPLE at least; in how many of them such a shingle occurs, and how many are told apart.
SHARE, SAMPLE, COMMON, LISTED = 5, 10_000, 3, 200_000
#: Words of 64 bits of a fingerprint, the bits that may differ, and the shingles from which on fingerprints are trusted.
WIDTH, MOST, LEAST = 4, 80, 64
#: Runs of up to this many classes give all their pairs at once.
SHORT = 16
#: Places, by nearness, of the classes that a class of a longer run meets in each round.
ROUNDS = ((0, 8), (8, None))
#: Keys before a key that say whether two classes have met already.
BEFORE = 1
#: Rows of a run that one task compares.
BLOCK = 1 << 14
#: Classes whose partners are counted together, and partners at a time, on average.
TOGETHER, PARTNERS = 64, 4096
#: Characters of text whose keys make a bucket, at about one key for 30 characters.
BUCKET = 1 << 23
#: Rows of an Arrow batch.
ROWS = 2048
#: Keys or pairs that are held before they are passed on.
HELD = 1 << 18

_POWERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


_WORDS = [f"f{n}" for n in range(WIDTH)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` lower-cased words; of fewer words, of all of them."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    total = np.full(len(w) - size + 1, size, np.uint64)
    for n in range(size):
        total = _mix(total + w[n : len(w) - size + 1 + n]) * np.uint64(_POWERS[n % len(_POWERS)])
    return np.unique(_mix(total))


def probe(n):
    """How many first shingles of a set of n some set of the similarity must share one of."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def index(n):
    """The same for sets that are no larger than the other: they share NUM * 2n / (NUM + DEN) or more."""
    return n - (2 * NUM * n + NUM + DEN - 1) // (NUM + DEN) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * shared >= NUM * (len(a) + len(b) - shared)


def _keys(size: int, common: np.ndarray, counts: np.ndarray):
    """For mapInArrow over (id, text, hash, chars): (id, hash, chars, n, h1, h2, f0 .., keys), the keys in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, h1, h2, keys, prints = [], [], [], [], np.zeros((len(b), WIDTH), "<u8")
            for row, text in enumerate(b.column("text").cast(pa.binary())):
                s = shingle_set(text.as_py(), size)
                if len(s):
                    prints[row] = simhash(s, WIDTH)
                ns.append(len(s))
                h1.append(int(_mix(s).sum(dtype=np.uint64)))
                h2.append(int(_mix(s ^ np.uint64(_POWERS[1])).sum(dtype=np.uint64)))
                if len(s) and len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, counts[at], 0), kind="stable")]
                keys.append(s[: probe(len(s))].tobytes() if len(s) else b"")
            whole = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            words = [pa.array(prints[:, n].view("<i8")) for n in range(WIDTH)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("hash"), b.column("chars"), pa.array(ns, pa.int32()), whole(h1), whole(h2), *words, pa.array(keys, pa.binary())], ["id", "hash", "chars", "n", "h1", "h2", *_WORDS, "keys"])

    return run


def _sampled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), size) for t in b.column("text").cast(pa.binary())]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["key"])

    return run


def _dealt(buckets: int):
    """For mapInArrow over (cid, n, label, keys): (bucket, rows), rows being arrays of (key, cid, label, n, before).

    ``before`` has whether the key is an index key as its lowest bit, and the keys before it in the others: 0 where there is none.
    """
    kind = np.dtype([("key", "<u8"), ("cid", "<i8"), ("label", "<i8"), ("n", "<i4"), ("before", "<u8", (BEFORE,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            bucket = _bucket(rows["key"], buckets)
            rows = rows[np.argsort(bucket, kind="stable")]
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            parts = [(n, rows[a:b].tobytes()) for n, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["bucket", "rows"])

        for b in batches:
            for cid, n, label, keys in zip(*(b.column(c).to_pylist() for c in ("cid", "n", "label", "keys")), strict=True):
                if n:
                    part = np.empty(len(keys) // 8, kind)
                    part["key"], part["cid"], part["label"], part["n"] = np.frombuffer(keys, "<u8"), cid, label, n
                    part["before"] = (np.arange(len(part)) < index(n))[:, None]
                    for back in range(1, min(BEFORE + 1, len(part))):
                        part["before"][back:, back - 1] |= part["key"][:-back] & ~np.uint64(1)
                    held.append(part)
            if sum(map(len, held)) >= HELD:
                yield flush()
        if held:
            yield flush()

    return run, kind


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(key ^ np.uint64(_POWERS[2])) % np.uint64(buckets)).astype(np.int64)


def _pairs(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0) if len(u) else np.zeros((0, 2), np.int64)


def _meet(kind: np.dtype):
    """For mapInArrow over (bucket, rows) sorted by bucket: candidate pairs (u, v, null ..), and the members (run, cid, n, index) of long runs.

    Rows that have the same key before are no pair here. Keys are first ones of their sets, so both classes have that key
    too, in the same roles: they are a pair or members of a long run there, or at the first of the keys that go on so.
    Runs of one label give nothing.
    """

    def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = rows[np.lexsort((rows["cid"], rows["n"], rows["key"]))]
        key, cid, label, n, before = (np.ascontiguousarray(rows[c]) for c in ("key", "cid", "label", "n", "before"))
        first, before = (before[:, 0] & np.uint64(1)).astype(bool), before >> np.uint64(1)
        starts = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(starts) - 1
        at = np.flatnonzero(starts)
        sizes = np.bincount(group)
        sizes[np.minimum.reduceat(label, at) == np.maximum.reduceat(label, at)] = 1
        few = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= SHORT))
        found = []
        for step in range(1, SHORT):
            a, b = few[:-step], few[step:]
            a, b = (x[group[a] == group[b]] for x in (a, b))
            if not len(a):
                break
            good = first[a] & (NUM * n[b] <= DEN * n[a]) & (label[a] != label[b])
            for x, y in product(range(BEFORE), repeat=2):
                good &= (before[a, x] != before[b, y]) | (before[a, x] == 0)
            found.append(np.stack([cid[a[good]], cid[b[good]]], axis=1))
        many = np.flatnonzero(sizes[group] > SHORT)
        if len(many):
            least = np.full(len(sizes), np.iinfo(np.int64).max)
            np.minimum.at(least, group[many], cid[many])
            found.append(np.stack([least[group[many]], cid[many]], axis=1)[label[many] != least[group[many]]])
        every = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        every = every[every[:, 0] != every[:, 1]]
        every = _pairs(every[:, 0], every[:, 1])
        none = lambda t, k: pa.nulls(k, t)
        names = ["u", "v", "run", "cid", "n", "index"]
        if len(every):
            k = len(every)
            yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1]), none(pa.int64(), k), none(pa.int64(), k), none(pa.int32(), k), none(pa.bool_(), k)], names)
        if len(many):
            k = len(many)
            yield pa.RecordBatch.from_arrays([none(pa.int64(), k), none(pa.int64(), k), pa.array(key[many].view(np.int64)), pa.array(cid[many]), pa.array(n[many]), pa.array(first[many])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            for at, rows in zip(b.column("bucket").to_pylist(), b.column("rows").to_pylist(), strict=True):
                if at != bucket and held:
                    yield from work(np.concatenate(held))
                    held = []
                bucket = at
                held.append(np.frombuffer(rows, kind))
        if held:
            yield from work(np.concatenate(held))

    return run


def _rest(low: int, high: int | None):
    """For mapInArrow over (run, part, cid, n, index, component, f0 ..) sorted by (run, part, n, cid): (run, u, vs).

    A class and its partners in other components that fingerprints leave; of them, by nearness, those from ``low`` to ``high``.
    """
    columns = ("cid", "n", "index", "component", *_WORDS)

    def work(cid: np.ndarray, n: np.ndarray, first: np.ndarray, component: np.ndarray, *words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if (component == component[0]).all():
            return
        f = np.stack(words, axis=1).view(np.uint64)
        ends = np.searchsorted(NUM * n.astype(np.int64), DEN * n.astype(np.int64), "right")
        for i in np.flatnonzero(first):
            others = np.arange(i + 1, ends[i])
            differing = np.bitwise_count(f[others] ^ f[i]).sum(axis=1, dtype=np.int32)
            if n[i] >= LEAST:
                others, differing = others[differing <= MOST], differing[differing <= MOST]
            if low or high is not None:
                others = others[np.argsort(differing, kind="stable")[low:high]]
            others = others[component[others] != component[i]]
            if len(others):
                yield cid[i], cid[others]

    def pack(found: list[tuple]) -> pa.RecordBatch:
        runs, us, vs = zip(*found, strict=True)
        offsets = np.r_[0, np.cumsum([len(v) for v in vs])].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(us, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(vs))], ["run", "u", "vs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, found, rows = None, [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal found, rows
            for u, vs in work(*(np.concatenate(c) for c in zip(*held, strict=True))):
                found.append((last[0], u, vs))
                rows += len(vs)
                if rows >= HELD:
                    yield pack(found)
                    found, rows = [], 0

        for b in batches:
            if not len(b):
                continue
            runs, parts = b.column("run").to_numpy(), b.column("part").to_numpy()
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
            edges = np.r_[0, np.flatnonzero((runs[1:] != runs[:-1]) | (parts[1:] != parts[:-1])) + 1, len(runs)]
            for a, z in zip(edges, edges[1:], strict=False):
                if (runs[a], parts[a]) != last and held:
                    yield from done()
                    held = []
                last = (runs[a], parts[a])
                held.append([c[a:z] for c in cols])
        if held:
            yield from done()
        if found:
            yield pack(found)

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """Adds ``part``: the pairs of blocks of BLOCK rows to which a row of a longer run is dealt, else 0."""
    blocks = F.ceil(F.col("rows") / BLOCK).cast("bigint")
    mine = F.pmod(F.xxhash64("cid"), blocks)
    pair = lambda o: F.least(mine, o) * blocks + F.greatest(mine, o)
    sized = members.join(members.groupBy("run").agg(F.count("*").alias("rows")), "run")
    return sized.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), pair))).drop("rows")


def _sets(size: int):
    """For mapInArrow over (cid, text): (cid, shingles), the set as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), size).tobytes() for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (u, v, a, b): (u, v) of the pairs whose sets a and b reach the similarity."""
    for batch in batches:
        good = [similar(*(np.frombuffer(x.as_py(), np.uint64) for x in pair)) for pair in zip(batch.column("a"), batch.column("b"), strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def _linked(lists: pa.Table, sets: pa.Table) -> pa.Table:
    """For a cogroup of (u, vs) and (cid, shingles): links (u, v) of the pairs that reach the similarity, a forest of them."""
    known = {c: np.frombuffer(x, np.uint64) for c, x in zip(sets.column("cid").to_pylist(), sets.column("shingles").to_pylist(), strict=True)}
    root: dict[int, int] = {}
    found: list[tuple[int, int]] = []

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    for u, vs in zip(lists.column("u").to_pylist(), lists.column("vs").to_pylist(), strict=True):
        for v in vs:
            if top(u) != top(v) and similar(known[u], known[v]):
                found.append((u, v))
                root[top(u)] = top(v)
    return pa.table({n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate("uv")})


def text_hash(text: Column) -> tuple[Column, Column]:
    """What tells texts apart: a hash and the length, -1 for a null text."""
    return F.xxhash64(text), F.coalesce(F.length(text), F.lit(-1))


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that are most frequent in a sample."""
    rows = docs.count()
    share = min(1.0, max(SAMPLE, rows / SHARE) / max(1, rows))
    some = docs.where(F.pmod(F.col("hash"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).dropDuplicates(["hash"]).select("text")
    found = some.mapInArrow(_sampled(size), "key bigint").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = found.orderBy(F.desc("n"), "key").limit(LISTED).toArrow()
    key, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def jaccard_groups(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, size: int, links: Callable[[Scratch, DataFrame], DataFrame]) -> DataFrame:
    """id, hash and chars (-1 for null) of the text, component: the least id of the texts linked with it; null for a null id, which links nothing.

    ``links`` takes (cid, f0), the classes and the first words of their fingerprints, and returns pairs (u, v), u < v, to count first.
    """
    with conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS)):
        return _groups(spark, docs, id_col, text_col, size, links)


def _groups(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, size: int, links: Callable[[Scratch, DataFrame], DataFrame]) -> DataFrame:
    scratch = Scratch(spark, "jaccard")
    text = F.col(text_col)
    given = docs.select(F.col(id_col).alias("id"), text.alias("text"), *(c.alias(n) for c, n in zip(text_hash(text), ("hash", "chars"), strict=True)))
    used = given.where("id is not null")
    id_type = dict(given.dtypes)["id"]
    key, counts = common_shingles(used, size)
    prints = scratch.cut(used.mapInArrow(_keys(size, key, counts), f"id {id_type}, hash bigint, chars int, n int, h1 bigint, h2 bigint, " + "".join(f"{w} bigint, " for w in _WORDS) + "keys binary"))
    total = prints.where("chars > 0").agg(F.sum("chars")).first()[0] or 0
    merged = prints.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.min(F.struct("hash", "chars")).alias("of"), *(F.first(c).alias(c) for c in (*_WORDS, "keys")))
    classes = scratch.cut(merged.withColumn("cid", F.monotonically_increasing_id()))
    texts = given.withColumnRenamed("hash", "hash_").withColumnRenamed("chars", "chars_")

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs that fingerprints leave."""
        for side in ("u", "v"):
            pairs = pairs.join(classes.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), *(F.col(w).alias(f"{w}_{side}") for w in _WORDS)), side)
        differing = sum((F.bit_count(F.col(f"{w}_u").bitwiseXOR(F.col(f"{w}_v"))) for w in _WORDS), F.lit(0))
        return pairs.where((F.least("n_u", "n_v") < LEAST) | (differing <= MOST)).select("u", "v")

    def shingles_of(wanted: DataFrame) -> DataFrame:
        """(cid, shingles) of the distinct wanted classes."""
        of = scratch.cut(classes.select("cid", F.col("of.hash").alias("h"), F.col("of.chars").alias("c")).join(wanted, "cid", "left_semi"))
        found = texts.join(of, (texts["hash_"] == of["h"]) & (texts["chars_"] == of["c"])).dropDuplicates(["cid"])  # equal texts, once
        read = scratch.cut(found.select("cid", "text").mapInArrow(_sets(size), "cid bigint, shingles binary"))
        scratch.drop(of)
        return read

    def verified(pairs: DataFrame) -> DataFrame:
        read = shingles_of(pairs.select(F.col("u").alias("cid")).union(pairs.select("v")).distinct())
        sides = pairs.join(read.withColumnsRenamed({"cid": "v", "shingles": "b"}), "v").join(read.withColumnsRenamed({"cid": "u", "shingles": "a"}), "u")
        out = scratch.cut(sides.select("u", "v", "a", "b").mapInArrow(_similar, "u bigint, v bigint"))
        scratch.drop(read)
        return out

    def verified_lists(lists: DataFrame) -> DataFrame:
        """Links of (run, u, vs). Lists whose least run is the same are counted together."""
        asked = scratch.cut(lists.groupBy("u").agg(F.min("run").alias("run"), F.array_distinct(F.flatten(F.collect_list("vs"))).alias("vs")))
        sizes = asked.groupBy("run").agg(F.ceil(F.count("*") / TOGETHER).alias("deals"), F.ceil(F.max(F.size("vs")) / PARTNERS).alias("blocks"))
        dealt = asked.join(sizes, "run").withColumn("deal", F.pmod(F.xxhash64("u"), F.col("deals"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        by = ["run", "deal", "block"]
        held = scratch.cut(dealt.select(*by, "u", F.filter("vs", lambda v: F.pmod(F.xxhash64(v), F.col("blocks")) == F.col("block")).alias("vs")))
        used = held.groupBy(*by).agg(F.array_distinct(F.concat(F.collect_list("u"), F.flatten(F.collect_list("vs")))).alias("cids"))
        used = scratch.cut(used.select(*by, F.explode("cids").alias("cid")))
        read = shingles_of(used.select("cid").distinct())
        out = scratch.cut(held.groupBy(*by).cogroup(used.join(read, "cid").groupBy(*by)).applyInArrow(_linked, "u bigint, v bigint"))
        scratch.drop(asked, held, used, read)
        return out

    buckets = max(1, total // BUCKET + 1)
    deal, kind = _dealt(buckets)
    linked = verified(scratch.cut(near(links(scratch, classes.where("n > 0").select("cid", "f0")).distinct())))
    labels = linked.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("label"))
    labelled = classes.select("cid", "n", "keys").join(labels, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cid"))
    met = labelled.select("cid", "n", "label", "keys").mapInArrow(deal, "bucket int, rows binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    met = scratch.cut(met.mapInArrow(_meet(kind), "u bigint, v bigint, run bigint, cid bigint, n int, index boolean"))
    first = scratch.cut(near(met.where("run is null").select("u", "v").distinct()))
    edges = linked.union(verified(first))
    long_runs = met.where("run is not null").select("run", "cid", "n", "index")
    if long_runs.limit(1).count():
        members = scratch.cut(_blocks(long_runs.select("run", "cid", "index")).join(classes.select("cid", "n", *_WORDS), "cid"))
        for nth, (low, high) in enumerate(ROUNDS):
            # For the first round, the least class that one is linked with says enough.
            known = components(spark, edges, scratch) if nth else edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
            marked = members.join(known, members["cid"] == known["node"], "left").drop("node").withColumn("component", F.coalesce("component", "cid"))
            edges = edges.union(verified_lists(marked.repartition("run", "part").sortWithinPartitions("run", "part", "n", "cid").mapInArrow(_rest(low, high), "run bigint, u bigint, vs array<bigint>")))
    found = components(spark, edges, scratch)
    named = classes.select("n", "h1", "h2", "rep", "cid").join(found, classes["cid"] == found["node"], "left").withColumn("group", F.coalesce("component", "cid"))
    least = named.groupBy("group").agg(F.min("rep").alias("least"))
    named = named.join(least, "group").select("n", "h1", "h2", F.col("least").alias("component"))
    out = prints.drop("keys", *_WORDS).join(named, ["n", "h1", "h2"]).select("id", "hash", "chars", "component")
    return out.unionByName(given.where("id is null").select("id", "hash", "chars", F.col("id").alias("component")))
