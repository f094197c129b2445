"""Quality rules with thresholds adapted to each language and source.

Signals are whole numbers per thousand. A mergeable sketch per language, source
and signal counts them in buckets whose width follows the value (16 buckets per
power of two, so bounds are within 1/16), which partial aggregation combines
before any shuffle. A quantile is the lower bound of the bucket that holds its
rank. The limits of a group are its quartiles widened by `spread` times their
distance, and by at least `slack`. Groups with fewer than `least` rows take the
merged sketch of their language, then that of all rows.

A null text has no words. Null languages and sources are groups of their own.
Texts of under `min_words` words or mostly made of repeated word triples fail
before any threshold and are left out of the sketches. Repeated rows are judged
one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import by_bytes, free_name, small, written

#: Bytes of text that a task counts at once.
SLICE_BYTES = 4_000_000

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    least: int = 100
    spread: int = 3
    #: signal -> (numerator, denominator, least distance of the limits from the quartiles)
    signals: dict[str, tuple[str, str, int]] = field(default_factory=lambda: {
        "symbols": ("n_symbols", "n_words", 80),
        "repeats": ("n_repeat_words", "n_words", 300),
        "dup_lines": ("n_dup_lines", "n_lines", 500),
        "word_length": ("word_chars", "n_words", 1500),
        "capitals": ("n_capitals", "word_chars", 150),
        "shouts": ("n_shouts", "n_words", 100),
    })
    #: signals that also have a lower limit
    two_sided: tuple[str, ...] = ("word_length",)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    pair = codes[:-1] * len(ids) + codes[1:]
    if len(ids) > 2_000_000:  # three codes must fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    windows = pair[:-1] * len(ids) + codes[2:]
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    often = np.zeros(n, dtype=bool)
    starts = np.concatenate((order[1:][same], order[:-1][same]))
    for k in range(3):
        often[starts + k] = True
    return int(often.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """Counts of one text, in the order of COUNTS."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at the six ASCII spaces only
    lines = Counter(line for line in text.split("\n") if line.strip(_SPACES))
    chars = len(text) - sum(map(text.count, _SPACES))
    capitals = int(np.count_nonzero(np.frombuffer(data, dtype=np.uint8) - np.uint8(65) < 26))
    return (len(words), chars, sum(map(text.count, _SYMBOLS)), sum(lines.values()) - len(lines), repeated_words(words),
            sum(lines.values()), capitals, text.count("!"))


def count_texts(docs: DataFrame, text: str = "text", counts: str = "counts") -> DataFrame:
    """`docs` with a struct of the counts of every whole text in column `counts`."""
    kept = [c for c in docs.columns]
    struct = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*docs.schema.fields, T.StructField(counts, struct)])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, at, SLICE_BYTES):
            rows = np.array([text_counts(t) for t in batch.column(at).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
            struct = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(COUNTS))], list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*kept, counts])

    return docs.mapInArrow(run, schema)


def bucket(x: Column) -> Column:
    """Bucket of a whole number >= 0: itself below 16, then 16 buckets per power of two."""
    shift = F.length(F.bin(x)) - 5
    return F.when(x < 16, x).otherwise((shift + 1) * 16 + F.floor(x / F.pow(F.lit(2.0), shift)) - 16).cast("bigint")


def lower_bound(b: Column) -> Column:
    """Least number of a bucket."""
    scale = F.pow(F.lit(2.0), F.floor(b / 16) - 1).cast("bigint")
    return F.when(b < 16, b).otherwise((b % 16 + 16) * scale).cast("bigint")


def signal_value(rules: QualityRules, counts: str, name: str) -> Column:
    top, bottom, _ = rules.signals[name]
    return F.expr(f"{counts}.{top} * 1000 div greatest({counts}.{bottom}, 1)")


def base_failed(rules: QualityRules, counts: str) -> Column:
    c = F.col(counts)
    return (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"])


def sketches(counted: DataFrame, rules: QualityRules, counts: str, lang: str, source: str) -> DataFrame:
    """Bucket counts `n` by lang, source, signal and bucket, of the rows that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), signal_value(rules, counts, s).alias("v")) for s in rules.signals])
    return (
        counted.where(~base_failed(rules, counts))
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(pairs))
        .groupBy("lang", "source", "signal", bucket(F.col("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    )


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, first and third quartile of every signal of the merged sketches of `keys`."""
    merged = sketch.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "signal")
    upto = merged.select(
        *keys, "signal", "bucket", F.sum("n").over(group).alias("rows"),
        F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))

    def at(q: int) -> Column:
        return lower_bound(F.min(F.when(F.col("upto") * 4 >= F.col("rows") * q, F.col("bucket"))))

    return upto.groupBy(*keys, "signal").agg(F.max("rows").alias("rows"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketch: DataFrame, rules: QualityRules) -> DataFrame:
    """One row per lang and source: `low_<signal>` and `high_<signal>`."""
    own = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("signal").alias("s"),
                                                 F.struct("rows", "q1", "q3").alias("of_lang"))
    overall = quartiles(sketch, []).select(F.col("signal").alias("t"), F.struct("rows", "q1", "q3").alias("of_all"))
    chosen = (
        own.join(by_lang, own["lang"].eqNullSafe(by_lang["l"]) & (own["signal"] == by_lang["s"]))
        .join(F.broadcast(overall), F.col("signal") == F.col("t"))  # one row per signal
        .select("lang", "source", "signal",
                F.when(F.col("rows") >= rules.least, F.struct("rows", "q1", "q3"))
                .when(F.col("of_lang")["rows"] >= rules.least, F.col("of_lang")).otherwise(F.col("of_all")).alias("q"))
    )

    def limit(signal: str, side: int) -> Column:
        q, slack = F.col("q"), F.lit(rules.signals[signal][2])
        width = F.greatest((q["q3"] - q["q1"]) * rules.spread, slack)
        value = q["q3"] + width if side > 0 else q["q1"] - width
        return F.max(F.when(F.col("signal") == signal, value))

    return chosen.groupBy("lang", "source").agg(
        *[limit(s, 1).alias(f"high_{s}") for s in rules.signals], *[limit(s, -1).alias(f"low_{s}") for s in rules.two_sided])


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang",
          source: str = "source", keep_text: bool = False) -> tuple[DataFrame, str, Column, Column]:
    """Rows of `docs` with their counts and limits; the name of the counts, whether the base failed, whether kept.

    The counted rows are written once, so the texts are read once. Without
    `keep_text` the text is not part of them.
    """
    counts = free_name(docs, "counts")
    counted = count_texts(docs, text, counts)
    counted = written(counted if keep_text else counted.drop(text), "quality-counts")
    limits = small(thresholds(sketches(counted, rules, counts, lang, source), rules))
    own = free_name(counted, "limits")
    names = [c for c in limits.columns if c not in ("lang", "source")]
    limits = limits.select(F.col("lang").alias("_of_lang"), F.col("source").alias("_of_source"), F.struct(*names).alias(own))
    joined = counted.join(
        limits, F.col(lang).eqNullSafe(F.col("_of_lang")) & F.col(source).eqNullSafe(F.col("_of_source")), "left")
    failed = base_failed(rules, counts)
    within = [signal_value(rules, counts, s) <= F.col(own)[f"high_{s}"] for s in rules.signals]
    within += [signal_value(rules, counts, s) >= F.col(own)[f"low_{s}"] for s in rules.two_sided]
    good = within[0]
    for w in within[1:]:
        good = good & w
    return joined, counts, failed, ~failed & F.coalesce(good, F.lit(False))


def quality_verdicts(docs: DataFrame, rules: QualityRules = QualityRules(), key: str = "doc_id") -> DataFrame:
    """Key, the counts, base_failed and kept of every row."""
    joined, counts, failed, kept = judge(docs.select(key, "text", "lang", "source"), rules)
    return joined.select(key, *[F.col(counts)[c].alias(c) for c in COUNTS], failed.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns."""
    joined, _, _, kept = judge(docs, rules, keep_text=True)
    return joined.where(kept).select(*docs.columns)
