"""Substring de-duplication by hashed lines and runs of words.

Units of two kinds are normalised (lower case, white space runs to one space)
and hashed to 64 bits. A line of at least `min_words` words is a unit. So are
runs of words, wherever lines break: a text is cut where the hash of two
neighbouring words is the least of some `window` cuts in a row (winnowing), and
from every cut, and from the start of the text, a run goes to the first cut (or
the end of the text) that leaves it `run_words` words. Cuts depend on the words
around them only, so a passage that repeats within other lines, or wrapped
otherwise, is cut alike: one of at least `run_words` + 3 * `window` - 1 words
(50 by default) has at least one whole run, wherever it stands.

Over all documents the earliest occurrence of a digest stays, by document id and
then by position; every later one is removed. Runs that overlap and have copies
in one document are reported as one; where a span is less than its runs, the
place of its copy is that of equal white space. Up to one window of words may stay in front
of a repeated passage, up to three behind it. A short line goes with the run it is part of;
of what runs cover between removed lines, less than `window` words stay. Offsets
are those of the original text, in code points, end exclusive. The remaining
text has no removed offset, and no line that removal left blank.

Units are computed and shuffled once. A block of documents sends one row per
digest, with its further occurrences packed, so a unit that occurs everywhere is
a few rows of one task. Among n different units, n * n / 2**65 are expected to
share a digest by chance: 0.1 of two thousand million.

A null or empty text has no units. Rows with a null id rank last. Equal rows of
one id are the same occurrence: none is a copy of the other. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"\S+")
#: Different words whose hashes a task remembers.
_CACHE = 500_000
#: Units of a block, within which equal digests are one row.
BLOCK_UNITS = 200_000


@dataclass(frozen=True)
class LineRule:
    min_words: int = 20
    run_words: int = 27
    window: int = 8


def word_hashes(words: list[str], seen: dict[str, int]) -> np.ndarray:
    """A hash of every word in lower case; `seen` keeps those of earlier calls."""
    import xxhash

    if len(seen) > _CACHE:
        seen.clear()
    for w in set(words).difference(seen):
        seen[w] = xxhash.xxh3_64_intdigest(w.lower().encode("utf-8", "surrogatepass"))
    return np.array([seen[w] for w in words], dtype=np.uint64)


def cuts(hashes: np.ndarray, window: int) -> np.ndarray:
    """Word numbers that the content cuts at, in order: the leftmost least pair of every window of pairs."""
    pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    pairs = (pairs ^ (pairs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    if len(pairs) < window:
        return np.zeros(0, dtype=np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(pairs, window)
    return np.unique(rows.argmin(axis=1) + np.arange(len(rows)))


def text_units(text: str, rule: LineRule, seen: dict[str, int]) -> list[tuple[int, bool, int, int]]:
    """(digest, whether it is a line, start, end) of every unit."""
    import xxhash

    words = text.split()
    n = len(words)
    if n < max(1, min(rule.min_words, rule.run_words)):
        return []
    starts = [m.start() for m in _WORD.finditer(text)]
    hashes = word_hashes(words, seen)
    out, at, first = [], 0, 0
    for line in text.split("\n"):
        last = first + len(line.split())
        if last > first and last - first >= rule.min_words:
            out.append((xxhash.xxh3_64_intdigest(hashes[first:last].tobytes(), seed=1), True, at, at + len(line)))
        first, at = last, at + len(line) + 1
    inner = cuts(hashes, rule.window)
    begins = np.unique(np.append(0, inner))
    begins = begins[begins + rule.run_words <= n]
    stops = np.unique(np.append(inner, n))
    ends = stops[np.searchsorted(stops, begins + rule.run_words)]
    raw = hashes.tobytes()
    for b, e in zip(begins.tolist(), ends.tolist()):
        out.append((xxhash.xxh3_64_intdigest(raw[8 * b:8 * e]), False, starts[b], starts[e - 1] + len(words[e - 1])))
    return out


def line_units(docs: DataFrame, rule: LineRule, key: str, text: str) -> DataFrame:
    """Digests by block of documents: id, digest, line, start and end of the first occurrence, and the others in `later`.

    A unit that a block holds many times is one row of it, so a digest has at
    most one row per `BLOCK_UNITS` units of the corpus.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType
    place = [T.StructField("id", kind), T.StructField("line", T.BooleanType()), T.StructField("start", T.LongType()),
             T.StructField("end", T.LongType())]
    schema = T.StructType([T.StructField("digest", T.LongType()), *place, T.StructField("later", T.ArrayType(T.StructType(place)))])
    names = [f.name for f in place]
    empty = pa.array([], to_arrow_type(kind))

    def block(ids: pa.Array, ranks: np.ndarray, row: list[int], units: list[tuple]) -> pa.RecordBatch:
        digests, lines, starts, ends = (np.array(c) for c in zip(*units)) if units else (np.zeros(0),) * 4
        digests, row_at = digests.astype(np.uint64).view(np.int64), np.array(row, np.int64)
        order = np.lexsort((starts, ranks[row_at], digests))
        first = np.diff(digests[order], prepend=-1) != 0
        first[:1] = True
        heads, rest = order[first], order[~first]
        ends_at = np.cumsum(~first)[np.append(np.flatnonzero(first)[1:], len(first)) - 1] if len(first) else np.zeros(0, np.int64)

        def columns(at: np.ndarray) -> list[pa.Array]:
            return [ids.take(pa.array(row_at[at])) if len(ids) else empty, pa.array(lines[at].astype(bool)),
                    pa.array(starts[at].astype(np.int64)), pa.array(ends[at].astype(np.int64))]

        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends_at), pa.int32()), pa.StructArray.from_arrays(columns(rest), names),
                                         mask=pa.array(np.diff(ends_at, prepend=0) == 0))
        return pa.RecordBatch.from_arrays([pa.array(digests[heads]), *columns(heads), lists], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            row, units, ids = [], [], batch.column(0)
            ranks = pc.rank(ids, null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
            for i, text in enumerate(batch.column(1)):
                found = text_units(text.as_py() or "", rule, seen)
                row += [i] * len(found)
                units += found
                if len(units) > BLOCK_UNITS:
                    yield block(ids, ranks, row, units)
                    row, units = [], []
            if units:
                yield block(ids, ranks, row, units)

    return rows.mapInArrow(run, schema)


def repeated_lines(docs: DataFrame, rule: LineRule = LineRule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every unit that occurs earlier: id, line, start, end, and the document and start of the occurrence that stays.

    One shuffle by digest: the first row of a digest names the occurrence that
    stays, and only what repeats goes on.
    """
    units = line_units(docs, rule, key, text)
    by_digest = Window.partitionBy("digest").orderBy(F.col("id").isNull(), "id", "start")
    units = units.withColumn("first", F.first(F.struct("id", "start")).over(by_digest))

    def stays(place) -> Column:
        return place["id"].eqNullSafe(F.col("first.id")) & (place["start"] == F.col("first.start"))

    own = F.struct("id", "line", "start", "end")
    again = units.where(F.col("later").isNotNull() | ~stays({c: F.col(c) for c in ("id", "start")}))
    places = again.select("first", F.explode(F.concat(F.array(own), F.coalesce("later", F.array().cast(again.schema["later"].dataType)))).alias("u"))
    return places.where(~stays(F.col("u"))).select("u.*", F.col("first.id").alias("kept_id"), F.col("first.start").alias("kept_start"))


def removed_spans(text: str, units: list[dict], rule: LineRule) -> list[dict]:
    """Whole lines, and what joined runs cover beyond them, in order and without overlap."""
    lines = [u for u in units if u["line"]]
    joined: list[dict] = []
    for u in (u for u in units if not u["line"]):
        if joined and u["start"] < joined[-1]["end"]:
            if u["end"] <= joined[-1]["end"]:
                continue
            if u["kept_id"] == joined[-1]["kept_id"]:
                joined[-1]["end"] = u["end"]
                continue
            u = u | {"start": joined[-1]["end"], "kept_start": u["kept_start"] + joined[-1]["end"] - u["start"]}
        joined.append(dict(u))
    out, k = list(lines), 0
    for u in joined:
        while k < len(lines) and lines[k]["end"] <= u["start"]:
            k += 1
        at, j, cut = u["start"], k, False
        while j < len(lines) and lines[j]["start"] < u["end"]:
            out.append(u | {"start": at, "end": lines[j]["start"], "cut": True, "kept_start": u["kept_start"] + at - u["start"]})
            at, j, cut = lines[j]["end"], j + 1, True
        out.append(u | {"start": at, "cut": cut, "kept_start": u["kept_start"] + at - u["start"]})
    kept = []
    for u in out:
        if "cut" in u:
            piece = text[u["start"]:max(u["start"], u["end"])]
            size = len(piece.split())
            if not size or (u["cut"] and size < rule.window):
                continue
            left = len(piece) - len(piece.lstrip())
            u = u | {"start": u["start"] + left, "end": u["start"] + len(piece.rstrip()), "kept_start": u["kept_start"] + left}
        kept.append(u)
    return sorted(kept, key=lambda u: u["start"])


def without_spans(text: str, spans: list[dict]) -> str:
    """The text without the spans, and without lines of which they leave nothing."""
    out, k, at = [], 0, 0
    for line in text.split("\n"):
        end, pos, parts, cut = at + len(line), at, [], False
        while k < len(spans) and (spans[k]["start"] < end or spans[k]["start"] == spans[k]["end"] == end):
            s, e = spans[k]["start"], spans[k]["end"]
            parts.append(text[pos:max(s, pos)])
            pos, cut = max(pos, min(e, end)), True
            if e > end:
                break
            k += 1
        rest = "".join(parts) + text[pos:end]
        if not cut or rest.strip():
            out.append(rest)
        at = end + 1
    return "\n".join(out)


def remove_repeats(docs: DataFrame, rule: LineRule = LineRule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_removed, the removed spans with their offsets and the occurrence that stays, and the remaining text."""
    from pyspark.sql.pandas.types import to_arrow_type

    removed = repeated_lines(docs, rule, key, text).groupBy(F.col("id").alias("_id")).agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "line", "kept_id", "kept_start"))).alias("_removed"))
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    joined = rows.join(removed, F.col(key).eqNullSafe(F.col("_id")), "left").select(key, "_text", "_removed")
    kind = rows.schema[key].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kept_id", kind),
                         T.StructField("kept_start", T.LongType())])
    schema = T.StructType([rows.schema[key], T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span)),
                           T.StructField("text", T.StringType())])
    spans_type = to_arrow_type(schema["removed"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, texts = [], [], []
            for t, units in zip(batch.column(1), batch.column(2)):
                t, found = t.as_py(), None
                if t is not None and units.is_valid:
                    found = removed_spans(t, units.as_py(), rule)
                    t = without_spans(t, found)
                counts.append(len(found or ()))
                spans.append(found and [{f: u[f] for f in span.names} for u in found])
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, spans_type),
                                              pa.array(texts, pa.string())], schema.names)

    return joined.mapInArrow(run, schema)
