"""Secret scans over whole texts, in DataFrame functions only.

Three kinds of spans come from patterns: ``assign`` (a keyword, a sign and a value of 12 or more characters), ``access``
(AKIA keys of 18 or more) and ``hex`` (lower-case runs of 16 or more). The fourth, ``entropy``, comes from candidate
strings (maximal runs of the base64 and URL-safe alphabets): each is read under its narrowest character class, a window
slides over it, and the counts of the character that enters and of the one that leaves update the window's Shannon
entropy. A candidate whose best window reaches its class's threshold is a span, unless the allow-list knows it or a span
of another kind holds it.

All of it is per row: no shuffle, no Python. Offsets are code points, end exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows are judged one by one; an empty table gives
no rows; other columns are not read by ``scan``, and ``redact`` keeps them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm.shared import table

# Fixed values of the base patterns.
_KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
#: The lookbehind saves trying again from inside a run that is too short.
HEX = "(?<![0-9a-f])[0-9a-f]{16,}"
VALUE_CHARS = 12
KINDS = ["assign", "access", "hex", "entropy"]

#: Characters in the sliding window, so also the least length of a candidate.
WINDOW = 24
_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Narrowest first: pattern of the whole candidate, and bits a character that a window must reach.
CLASSES = [("^([0-9a-f]+|[0-9A-F]+)$", 3.0), ("^([0-9a-z]+|[0-9A-Z]+)$", 3.7), ("^.*$", 4.0)]
#: A word, or a part of one in camel case: three letters or more of one case, at most the first of them a capital alone.
_WORD = "(?:[A-Z]?[a-z]{3,}+|[A-Z]{3,}+)"
#: Candidates that are no secrets: words and paths of words without digits (six consonants in a row are no word), numbers,
#: UUIDs, and those of which a whole part is an alphabet in order or a placeholder.
#: Words are repeated possessively: a candidate has one reading, and Java's other loops need stack for each word.
ALLOWED = (
    rf"^(?!.*(?i:[bcdfghjklmnpqrstvwxz]{{6}}))[/_=+-]*(?:{_WORD}[/_=+-]*+|[A-Za-z]{{1,2}}(?:[/_=+-]++|$))++$"
    r"|^[0-9/_=+-]+$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
    r"|(?:^|[/_=+-])(?:0123456789[A-Za-z]*|[A-Za-z]*0123456789|(?i:abcdefghijklm[n-z]*[0-9]*|examples?|placeholder|x{8,}))(?:[/_=+-]|$)"
)
#: Matches are summed in blocks of this many, so that offsets take time in proportion to the matches.
_BLOCK = 512
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str, kind: int, ok: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the leftmost matches that do not overlap, without those that fail ``ok``."""

    def steps(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        sized = F.transform(found, lambda m: F.struct(F.length(m).alias("n"), (ok(m) if ok else F.lit(True)).alias("ok")))
        return F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), sized.alias("m")), lambda x: F.struct(x["gap"].alias("gap"), x["m"]["n"].alias("n"), x["m"]["ok"].alias("ok")))

    def blocks(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda b: F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)))

    def with_offsets(bs: Column) -> Column:
        sums = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["n"]))
        offsets = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.transform(F.arrays_zip(bs.alias("block"), F.slice(offsets, 1, F.size(bs)).alias("at")), spans))

    def spans(b: Column) -> Column:
        empty = F.array().cast(_SPANS)
        return F.aggregate(
            b["block"],
            F.struct(b["at"].alias("at"), empty.alias("out")),
            lambda s, x: F.struct(
                (s["at"] + x["gap"] + x["n"]).alias("at"),
                F.when(x["ok"], F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (s["at"] + x["gap"] + x["n"]).alias("end"))))).otherwise(s["out"]).alias("out"),
            ),
            lambda s: s["out"],
        )

    return _let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, F.array().cast(_SPANS)).otherwise(_let(steps(found), lambda s: _let(blocks(s), with_offsets))),
    )


def _least_sum(candidate: Column) -> Column:
    """The least sum of c * log2(c) over windows, c being the counts of the window's characters: entropy is log2(n) - sum / n."""
    table_ = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])

    def at(counts: Column, symbol: Column) -> Column:
        return F.get(counts, symbol)

    def fold(codes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))

            def update(a: Column) -> Column:
                new, old = a["new"], a["old"]
                before = at(s["counts"], new)
                leaving = at(s["counts"], old) + F.when(new == old, 1).otherwise(0)
                total = s["sum"] + F.get(table_, before + 1) - F.get(table_, before) + F.when(old >= 0, F.get(table_, leaving - 1) - F.get(table_, leaving)).otherwise(F.lit(0.0))
                counts = F.transform(s["counts"], lambda c, j: c + F.when(j == new, 1).otherwise(0) - F.when(j == old, 1).otherwise(0))
                return _let(total, lambda t: F.struct(counts.alias("counts"), t.alias("sum"), F.when(i >= WINDOW - 1, F.least(s["best"], t)).otherwise(s["best"]).alias("best")))

            return _let(F.struct(new.alias("new"), old.alias("old")), update)

        start = F.struct(F.array_repeat(F.lit(0), len(_ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: s["best"])

    chars = F.regexp_extract_all(candidate, F.lit("."), F.lit(0))
    return _let(F.transform(chars, lambda c: F.instr(F.lit(_ALPHABET), c) - 1), fold)


def _is_random(candidate: Column) -> Column:
    most = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES):
        limit = F.lit(WINDOW * (math.log2(WINDOW) - bits) + 1e-9)
        most = limit if pattern == "^.*$" else F.when(candidate.rlike(pattern), limit).otherwise(most)
    return F.when(candidate.rlike(ALLOWED), F.lit(False)).otherwise(_least_sum(candidate) <= most)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(text: Column) -> tuple[Column, Column]:
    """(base spans, entropy spans outside them), each an array of (start, kind, end) in order."""
    body = F.coalesce(text, F.lit(""))
    base = F.array_sort(
        F.concat(
            _matches(body, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= VALUE_CHARS),
            _matches(body, ACCESS, 1),
            _matches(body, HEX, 2),
        )
    )
    return base, _matches(body, CANDIDATE, 3, _is_random)


def with_spans(docs: DataFrame, text_col: str, base_name: str, all_name: str) -> DataFrame:
    base, random = spans(F.col(text_col))
    held = docs.withColumns({base_name: base, all_name: random})
    outside = F.filter(all_name, lambda r: ~F.exists(base_name, lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))
    return held.withColumn(all_name, F.when(F.size(all_name) == 0, F.col(base_name)).otherwise(F.array_sort(F.concat(F.col(base_name), outside))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_spans, all_spans (arrays of (start, kind, end)), base, spans (joined)."""
    found = with_spans(docs.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", "base_spans", "all_spans")

    def count(kind: int) -> Column:  # a lambda's second parameter, default or not, would be the span's place
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{k}": count(n) for n, k in enumerate(KINDS[:3])}
    return found.select(id_col, *[c.alias(n) for n, c in counts.items()], "base_spans", "all_spans", _joined(F.col("base_spans")).alias("base"), _joined(F.col("all_spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same columns; in texts with spans, each stretch of overlapping spans becomes ``mark``. Null texts stay null."""
    base, every = "_redact_base", "_redact_all"
    found = with_spans(docs, text_col, base, every)
    text = F.col(text_col)
    parts = F.aggregate(
        every,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(
            F.struct(
                x["end"].alias("at"),
                F.when((x["start"] < s["at"]) & (s["at"] > 0), s["out"]).otherwise(F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)))).alias("out"),
            )
        ),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))),
    )
    return found.withColumn(text_col, F.when(text.isNull() | (F.size(every) == 0), text).otherwise(parts)).drop(base, every)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
