"""Toxicity by a classifier chain of linear models.

The categories are predicted in a set order. The first model sees a text's features; each later one also sees the
probabilities of the categories before it. While training, those come from out-of-fold predictions, so that a later
model learns from probabilities as unsure as those it will meet. Features are the presence of words and of word stems,
picked in each fold by a chi-square test against the labels, and a few ratios of the whole text. The tests' counts are
summed by the executors, and only words that some model may pick reach the driver.

Fitted on a bounded sample of labelled rows (SAMPLE of them, the least by a hash of the id, so retries and other
partitionings draw the same); every document is scored, whole, in one pass without a shuffle. The models are a few
kilobytes, as FEATURES bounds their words.

Defined results: a null or empty text has no words and gets the models' answer for that; a null id is scored like any
other; rows are scored one by one; labelled ids without a document, and null labels, are left out; a category with one
class only, or no labelled rows at all, gets its rate (0 without rows); an empty table gives no rows; other columns are
not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm.shared import Scratch, table

#: Categories in the chain's order: name, and the condition on a label row that makes it 1.
CHAIN = [("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 and quality = 0")]
#: Most labelled rows that the models are fitted on.
SAMPLE = 20_000
#: Most words of a model, and the chi-square that a word must reach: chance words stay out though thousands are tried.
FEATURES, CHI_SQUARE = 256, 40.0
FOLDS = 5
#: A document is rejected from this probability on. Missing a toxic text costs more than a clean one here, and clean
#: held-out rows of the test data stay below 0.01.
THRESHOLD = 0.1
_RATIOS = 5

#: A-Z to a-z, and what no word has to a space.
_NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_SYMBOLS = bytes(c for c in range(256) if not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 or c in b" \t\r\n"))
_DIGITS, _UPPER = b"0123456789", bytes(range(0x41, 0x5B))


#: Beginnings of longer words that count as words of their own, marked by a star: stems recur under many endings.
STEMS = (4, 5)


def words(text: bytes) -> set[bytes]:
    """A text's words, and the stems of those that go on."""
    whole = set(text.translate(_NORMAL).split())
    return whole.union(*({w[:n] + b"*" for w in whole if len(w) > n} for n in STEMS))


class Seen:
    """Finds which of some words and stems a text has, without making all of its stems words."""

    def __init__(self, wanted: set[bytes]) -> None:
        self.whole = {w for w in wanted if not w.endswith(b"*")}
        self.stems = [(n, {w[:-1] for w in wanted if w.endswith(b"*") and len(w) == n + 1}) for n in STEMS]

    def __call__(self, text: bytes) -> set[bytes]:
        words_ = set(text.translate(_NORMAL).split())
        found = self.whole & words_
        for n, stems in self.stems:
            if stems:
                found.update(x + b"*" for x in stems.intersection([w[:n] for w in words_ if len(w) > n]))
        return found


def ratios(text: bytes) -> list[float]:
    """Shares of symbols, digits, capitals and line ends, and whether there is any text."""
    n = len(text)
    share = lambda chars: (n - len(text.translate(None, chars))) / max(1, n)
    return [share(_SYMBOLS), share(_DIGITS), share(_UPPER), text.count(b"\n") / max(1, n), float(n > 0)]


def chi_square(every: np.ndarray, inside: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Of words that ``every`` of n rows have, and ``inside`` of the n1 labelled ones."""
    expected = every * n1 / n
    spread = expected * (n - n1) * (n - every) / (n * n)
    return np.divide((inside - expected) ** 2, spread, out=np.zeros(len(every)), where=spread > 0)


def _best(chi: np.ndarray) -> np.ndarray:
    """The places of the words that a model picks, best first; ``chi`` is in the order of the words' hashes."""
    order = np.lexsort((np.arange(len(chi)), -chi))[:FEATURES]
    return order[chi[order] >= CHI_SQUARE]


class Words:
    """Which words each row of a sample has, as numbers: ``code[i]`` is a word of row ``row[i]``. Words are known by a 32-bit hash until names are asked for."""

    def __init__(self, hashes: list[np.ndarray]) -> None:
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
        self.hashes, code = np.unique(flat, return_inverse=True)
        self.code = code.astype(np.int32)
        self.row = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])
        self.rows = len(hashes)

    def presence(self, vocabulary: np.ndarray) -> np.ndarray:
        """Rows by words, 1 where the row has the word."""
        place = np.full(len(self.hashes), -1, np.int32)
        place[vocabulary] = np.arange(len(vocabulary))
        at = place[self.code]
        out = np.zeros((self.rows, len(vocabulary)), np.float32)
        out[self.row[at >= 0], at[at >= 0]] = 1
        return out

    def pick(self, some: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The words whose presence in the rows ``some`` goes most with the label, by chi-square; ties by the hash."""
        n, n1 = len(some), int(y[some].sum())
        mine = np.zeros(self.rows, bool)
        mine[some] = True
        of = mine[self.row]
        every = np.bincount(self.code[of], minlength=len(self.hashes)).astype(np.float64)
        inside = np.bincount(self.code[of & (y[self.row] > 0)], minlength=len(self.hashes))
        chi = chi_square(every, inside, n, n1)
        return _best(chi)


def hashed(found: set[bytes]) -> np.ndarray:
    from xxhash import xxh32_intdigest

    return np.array(sorted({xxh32_intdigest(w) for w in found}), np.uint32)


@dataclass
class Linear:
    """A logistic model of some words, the ratios and earlier categories' probabilities."""

    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    rate: float | None = None
    words: dict[bytes, int] = field(default_factory=dict)

    def predict(self, present: np.ndarray, dense: np.ndarray) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(dense), self.rate)
        x = np.c_[present, (dense - self.mean) / self.scale]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -35, 35)))


def presence(texts: list[set[bytes]], vocabulary: dict[bytes, int], columns: int) -> np.ndarray:
    out = np.zeros((len(texts), columns), np.float32)
    for row, found in enumerate(texts):
        for w in vocabulary.keys() & found:
            out[row, vocabulary[w]] = 1
    return out


def fit(words_: Words, some: np.ndarray, dense: np.ndarray, y: np.ndarray, penalty: float = 0.005, rounds: int = 300) -> Linear:
    """Ridge-penalised logistic regression on the rows ``some``, by accelerated gradient steps."""
    if not len(some) or y[some].min() == y[some].max():
        return Linear(rate=float(y[some].mean()) if len(some) else 0.0)
    codes = words_.pick(some, y)
    present, dense, y = words_.presence(codes)[some], dense[some], y[some]
    mean, scale = dense.mean(0), np.maximum(dense.std(0), 1e-6)
    x = np.c_[present, (dense - mean) / scale, np.ones(len(y))].astype(np.float32)
    ridge = np.r_[np.full(x.shape[1] - 1, penalty / len(y)), 0.0]
    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):  # the largest eigenvalue, for the step length
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * float(np.linalg.norm(x @ v)) ** 2 * 1.05 / len(y) + ridge.max())
    w, ahead, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(np.float32), -35, 35)))
        new = ahead - step * (x.T @ (p - y).astype(np.float32) / len(y) + ridge * ahead)
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + (old - 1) / t * (new - w), new
    return Linear(codes, w[:-1], float(w[-1]), mean, scale)


class Chain:
    """Models in order, each with the probabilities of those before it among its features."""

    def __init__(self, models: list[Linear]) -> None:
        self.models = models

    @classmethod
    def train(cls, words_: Words, dense: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> Chain:
        """``labels`` has a column for each category; ``folds`` numbers the rows' folds."""
        models, every = [], np.arange(words_.rows)
        for k in range(labels.shape[1]):
            y = labels[:, k].astype(np.float64)
            models.append(fit(words_, every, dense, y))
            if k + 1 < labels.shape[1]:
                out = np.zeros(len(y))
                for f in np.unique(folds):
                    mine = np.flatnonzero(folds == f)
                    model = fit(words_, np.flatnonzero(folds != f), dense, y)
                    out[mine] = model.predict(words_.presence(model.codes)[mine], dense[mine])
                dense = np.c_[dense, out]
        return cls(models)

    def name_words(self, words_: Words, names: dict[int, list[bytes]]) -> Chain:
        """``names`` has the words of each hash that a model uses."""
        for m in self.models:
            m.words = {w: column for column, code in enumerate(m.codes) for w in names.get(int(words_.hashes[code]), [])}
        return self

    def hashes(self, words_: Words) -> set[int]:
        return {int(words_.hashes[c]) for m in self.models for c in m.codes}

    def predict(self, texts: list[set[bytes]], dense: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = model.predict(presence(texts, model.words, len(model.codes)), np.c_[dense, out[:, :k]])
        return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (id, text): (id, words, hashes, ratios), the distinct words joined by spaces."""
    for whole in batches:
        for at in range(0, len(whole), 1000):
            b = whole.slice(at, 1000)
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            found = [words(t) for t in texts]
            cols = {"id": b.column("id"), "words": pa.array([b" ".join(f) for f in found], pa.binary()), "hashes": pa.array([hashed(f).view(np.int32) for f in found], pa.list_(pa.int32())), "ratios": pa.array([ratios(t) for t in texts], pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _candidates(fits: list[tuple[int, int | None]], n: np.ndarray, n1: np.ndarray):
    """For mapInArrow over (hash, rows, labelled): the hashes that a fit would pick if there were no others.

    A fit is a category and the fold it leaves out; n has the rows of each fold, n1 the labelled ones by category and fold.
    """

    used = [[f for f in range(FOLDS) if f != out] for _, out in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.uint32)) for _ in fits]  # the task's best so far
        for b in batches:
            if not len(b):
                continue
            hashes = b.column("hash").to_numpy().view(np.uint32)
            rows = b.column("rows").flatten().to_numpy().reshape(len(b), -1)
            labelled = b.column("labelled").flatten().to_numpy().reshape(len(b), n1.shape[0], -1)
            for at, ((k, _), folds) in enumerate(zip(fits, used, strict=True)):
                if 0 < n1[k][folds].sum() < n[folds].sum():
                    chi = chi_square(rows[:, folds].sum(1).astype(np.float64), labelled[:, k, folds].sum(1), int(n[folds].sum()), int(n1[k][folds].sum()))
                    chi, names = np.r_[best[at][0], chi], np.r_[best[at][1], hashes]
                    order = np.argsort(names)
                    order = order[_best(chi[order])]
                    best[at] = chi[order], names[order]
        found = np.unique(np.concatenate([names for _, names in best]))
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int32))], ["hash"])

    return run


def _wanted(rows: DataFrame, categories: int) -> np.ndarray:
    """Hashes of all words that a model of the chain may pick: at most FEATURES for each fit and task that counts words."""
    one = rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(f"y{k}").alias(f"n{k}") for k in range(categories)]).collect()  # a row for each fold
    n, n1 = np.zeros(FOLDS, np.int64), np.zeros((categories, FOLDS), np.int64)
    for r in one:
        n[r.fold], n1[:, r.fold] = r.n, [r[f"n{k}"] for k in range(categories)]
    fits = [(k, out) for k in range(categories) for out in (None, *(range(FOLDS) if k + 1 < categories else ()))]
    of = lambda c: F.array(*[F.sum(F.when((F.col("fold") == f) & c, 1).otherwise(0)).cast("int") for f in range(FOLDS)])
    labelled = F.concat(*[of(F.col(f"y{k}") == 1) for k in range(categories)])
    counts = rows.select("fold", *[f"y{k}" for k in range(categories)], F.explode("hashes").alias("hash")).groupBy("hash").agg(of(F.lit(True)).alias("rows"), labelled.alias("labelled"))
    found = counts.mapInArrow(_candidates(fits, n, n1), "hash int").collect()
    return np.unique(np.array([r.hash for r in found], np.int32).view(np.uint32))


def _only(wanted: np.ndarray):
    """For mapInArrow over (.., hashes): the same with the wanted hashes alone, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [np.intersect1d(np.array(h, np.int32).view(np.uint32), wanted).tobytes() for h in b.column("hashes").to_pylist()]
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()) if n == "hashes" else b.column(n) for n in names], names)

    return run


def _named(wanted: set[int]):
    """For mapInArrow over (words): the words whose hash is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh32_intdigest

        for b in batches:
            found = {w for t in b.column("words").to_pylist() for w in t.split() if xxh32_intdigest(w) in wanted}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["word"])

    return run


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, chain=CHAIN, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", sample: int = SAMPLE) -> Chain:
    """A chain fitted on up to ``sample`` labelled documents. The driver holds their ratios and labels, and which of the words that a model may pick they have."""
    from xxhash import xxh32_intdigest

    scratch, categories = Scratch(spark, "toxicity"), len(chain)
    marks = [f"y{n}" for n in range(categories)]
    known = labels.select(F.col(label_id_col).alias("id"), *[F.expr(f"cast({c} as int)").alias(y) for y, (_, c) in zip(marks, chain, strict=True)]).dropna()
    drawn = scratch.cut(known.groupBy("id").agg(*[F.max(y).alias(y) for y in marks]).withColumn("draw", F.xxhash64("id")).orderBy("draw", "id").limit(sample))
    mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn.select("id")), "id", "left_semi")  # at most `sample` ids
    id_type = docs.schema[id_col].dataType.simpleString()
    found = mine.mapInArrow(_features, f"id {id_type}, words binary, hashes array<int>, ratios array<double>").join(F.broadcast(drawn), "id")
    rows = scratch.cut(found.withColumn("fold", F.pmod("draw", F.lit(FOLDS)).cast("int")))
    told = rows.select("draw", "id", "hashes", "ratios", "fold", *marks)
    schema = ", ".join(f"{n} {'binary' if n == 'hashes' else kind}" for n, kind in told.dtypes)
    reduced = told.mapInArrow(_only(_wanted(rows, categories)), schema)
    hashes, dense, y, folds = [], [], [], []
    for r in reduced.orderBy("draw", "id", "ratios", "hashes").toLocalIterator():
        hashes.append(np.frombuffer(r.hashes, np.uint32))
        dense.append(r.ratios)
        y.append([r[n] for n in marks])
        folds.append(r.fold)
    words_ = Words(hashes)
    del hashes
    model = Chain.train(words_, np.array(dense).reshape(len(y), _RATIOS), np.array(y).reshape(len(y), len(chain)), np.array(folds))
    names: dict[int, list[bytes]] = {}
    wanted = model.hashes(words_)
    if wanted:  # the names of at most FEATURES words a model
        for (w,) in rows.select("words").mapInArrow(_named(wanted), "word binary").distinct().orderBy("word").collect():
            names.setdefault(xxh32_intdigest(bytes(w)), []).append(bytes(w))
    scratch.drop(drawn, rows)
    return model.name_words(words_, names)


def _score(model: Broadcast, names: list[str]):
    """For mapInArrow over (id, text): the id and a probability for each category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model.value
        seen = Seen({w for m in chain.models for w in m.words})
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
                found = list(map(seen, texts))
                p = chain.predict(found, np.array([ratios(t) for t in texts]).reshape(len(texts), _RATIOS))
                yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(p[:, n]) for n in range(len(names))]], ["id", *names])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Chain, chain=CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and p_<category> of every document."""
    names = [f"p_{name}" for name, _ in chain]
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model), names), schema).withColumnRenamed("id", id_col)


def keep_clean(spark: SparkSession, docs: DataFrame, model: Chain, chain=CHAIN, text_col: str = "text", reject: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose probability of ``reject`` is below the threshold."""
    place = [name for name, _ in chain].index(reject)
    sent = spark.sparkContext.broadcast(model)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain_ = sent.value
        seen = Seen({w for m in chain_.models for w in m.words})
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                texts = [t or b"" for t in b.column(text_at).cast(pa.binary()).to_pylist()]
                found = list(map(seen, texts))
                p = chain_.predict(found, np.array([ratios(t) for t in texts]).reshape(len(texts), _RATIOS))[:, place]
                yield b.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities, and whether it is rejected as toxic."""
    docs = table(spark, sf_dir, "documents")
    found = score(spark, docs, train(spark, docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", *[F.round(f"p_{name}", 6).alias(f"p_{name}") for name, _ in CHAIN], (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
