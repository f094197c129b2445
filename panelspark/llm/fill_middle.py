"""Fill-in-the-middle: documents cut at two unit boundaries and put together in another order.

A unit is a run of spaces with the word behind it, or spaces that end the text.
Units are counted per chunk: a rolling hash of the last 16 bytes decides where
chunks end, so text that documents share falls into the same chunks. A cache
maps the content of a chunk to its summary (units that end in it, code points,
whether it starts and ends with a space), and a hit is a match of content, not
of hashes. Summaries add up to the units of the document, their running sum
names the chunk of a cut, and only that chunk is searched for the place.

A null text is empty; an empty text, a text with a marker in it and a text that
the draw leaves alone stay plain. Texts of any length are taken whole, chunks
never grow beyond `CHUNK_MOST` bytes. Draws depend on seed and id alone: repeated
rows get equal results, a null id counts as the empty text. An empty table gives
an empty result; `fill_middle` keeps other columns and replaces any of the names
that it adds. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import free_name

#: Bytes that the rolling hash sees, bits that must be zero at a chunk's end, least and greatest chunk length.
WINDOW, CUT_BITS, CHUNK_LEAST, CHUNK_MOST = 16, 10, 64, 16_384
#: Bytes of chunk content that a task remembers.
CACHE_BYTES = 16_000_000
#: Bytes of text that are hashed at once.
SLICE_BYTES = 2_000_000

SPACES = bytes([32, *range(9, 14)])
_CLASS = bytes(32 if b in SPACES else 120 for b in range(256))
_INNER = bytes(range(128, 192))
_GEAR = np.random.default_rng(16).integers(0, 2**63, 256, dtype=np.uint64)


@dataclass(frozen=True)
class FimRule:
    seed: int = 42
    percent: int = 50
    spm_percent: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def chunk_ends(data: bytes) -> np.ndarray:
    """End offsets of the chunks of one text; they depend on its content only."""
    n = len(data)
    out = []
    for start in range(0, n, SLICE_BYTES):
        lead = min(start, WINDOW - 1)
        h = _GEAR[np.frombuffer(data, np.uint8, min(n - start, SLICE_BYTES) + lead, start - lead)]
        width = 1
        while width < WINDOW:
            rolled = h.copy()
            rolled[width:] += h[:-width] << np.uint64(width)
            h, width = rolled, width * 2
        hits = np.flatnonzero(h[lead:] >> np.uint64(64 - 1 - CUT_BITS) == 0) + start + 1
        out.append(hits[hits >= WINDOW])
    hits = np.concatenate(out) if out else np.zeros(0, np.int64)
    if len(hits):  # of hits close together the first one counts
        hits = hits[np.diff(hits, prepend=-CHUNK_LEAST) >= CHUNK_LEAST]
    edges = np.unique(np.concatenate([[0], hits, [n]]))
    gaps = np.diff(edges)
    if len(gaps) and gaps.max() > CHUNK_MOST:
        pieces = -(-gaps // CHUNK_MOST)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        edges = np.append(np.repeat(edges[:-1], pieces) + within * CHUNK_MOST, n)
    return edges[1:]


class ChunkCache:
    """Boundary summaries by chunk content; forgets everything when its bytes are spent."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.known: dict[bytes, tuple[int, int, bool, bool]] = {}
        self.limit, self.bytes, self.hits, self.misses = limit, 0, 0, 0

    def summary(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        """Falls from a word to a space inside, code points, starts with a space, ends with one."""
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        self.misses += 1
        kinds = chunk.translate(_CLASS)
        found = kinds.count(b"x "), len(chunk.translate(None, _INNER)), kinds[:1] == b" ", kinds[-1:] == b" "
        if self.bytes + len(chunk) > self.limit:
            self.known.clear()
            self.bytes = 0
        self.known[chunk] = found
        self.bytes += len(chunk)
        return found

    def cut(self, data: bytes, draws: tuple[int, int]) -> tuple[int, int, int]:
        """Units of the text, code points before the first cut and between the cuts."""
        if not data:
            return 0, 0, 0
        ends = chunk_ends(data).tolist()
        falls, chars, starts = [], [], [0, *ends[:-1]]
        fallen, seen, after_word = 0, 0, False
        for a, b in zip(starts, ends):
            inside, points, leads, trails = self.summary(data[a:b])
            fallen += inside + (after_word and leads)
            seen += points
            falls.append(fallen)
            chars.append(seen)
            after_word = not trails
        units = fallen + 1
        falls_np = np.array(falls)

        def place(k: int) -> int:
            """Code points up to the end of unit k."""
            if k == 0:
                return 0
            if k == units:
                return seen
            i = int(np.searchsorted(falls_np, k))
            a, b = starts[i], ends[i]
            lead = data[a - 1:a]  # the fall may lie on the chunk's edge
            kinds = np.frombuffer((lead + data[a:b]).translate(_CLASS), np.uint8)
            at = np.flatnonzero((kinds[:-1] == 120) & (kinds[1:] == 32))[k - 1 - (falls[i - 1] if i else 0)]
            part = data[a:a + int(at) + 1 - len(lead)]
            return (chars[i - 1] if i else 0) + len(part.translate(None, _INNER))

        low, high = sorted(d % (units + 1) for d in draws)
        first = place(low)
        return units, first, place(high) - first


def _cuts(text: Column, h1: Column, h2: Column) -> Column:
    @F.pandas_udf("n long, before long, between long")
    def cuts(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        cache = ChunkCache()
        for texts, one, two in parts:
            rows = [cache.cut((t or "").encode(), (a, b)) for t, a, b in zip(texts, one, two)]
            yield pd.DataFrame(rows, columns=["n", "before", "between"])

    return cuts(text, h1, h2)


def fill_middle(docs: DataFrame, rule: FimRule = FimRule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns with n, form, prefix_chars, middle_chars and the text put together anew in `output`."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    base = docs.drop(*[c for c in names if c not in (key, text)])
    body_name, cut_name = free_name(base, "_body"), free_name(base, "_cut")
    digest = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    body, cut = F.col(body_name), F.col(cut_name)
    base = base.withColumn(body_name, F.coalesce(F.col(text), F.lit("")))
    marked = F.lit(False)
    for m in (rule.prefix, rule.suffix, rule.middle):
        marked = marked | body.contains(m)
    plain = (body == "") | marked | (draw[2] % 100 >= rule.percent)
    form = F.when(plain, "plain").when(draw[3] % 100 < rule.spm_percent, "spm").otherwise("psm")
    prefix = F.substring(body, F.lit(1), cut["before"].cast("int"))
    middle = F.substring(body, (cut["before"] + 1).cast("int"), cut["between"].cast("int"))
    suffix = F.substring(body, (cut["before"] + cut["between"] + 1).cast("int"), F.lit(2**31 - 1))
    p, s, m = F.lit(rule.prefix), F.lit(rule.suffix), F.lit(rule.middle)
    shape = F.col("form")
    return (
        base.withColumn(cut_name, _cuts(body, draw[0], draw[1])).withColumn("form", form)
        .withColumn("n", cut["n"])
        .withColumn("prefix_chars", F.when(shape != "plain", cut["before"]))
        .withColumn("middle_chars", F.when(shape != "plain", cut["between"]))
        .withColumn("output", F.when(shape == "plain", body)
                    .when(shape == "psm", F.concat(p, prefix, s, suffix, m, middle))
                    .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
        .drop(body_name, cut_name))


def restored(rule: FimRule = FimRule(), output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of; the markers of a form that is not plain stand in it once each."""
    def between(first: str, then: str | None) -> Column:
        rest = F.substring_index(output, first, -1)
        return rest if then is None else F.substring_index(rest, then, 1)

    psm = F.concat(between(rule.prefix, rule.suffix), between(rule.middle, None), between(rule.suffix, rule.middle))
    spm = F.concat(between(rule.prefix, rule.middle), between(rule.middle, None), between(rule.suffix, rule.prefix))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def fim_digests(docs: DataFrame, rule: FimRule = FimRule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    made = fill_middle(docs.select(key, text), rule, key, text)
    return made.select(key, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(rule), 256).alias("restored_sha256"))
