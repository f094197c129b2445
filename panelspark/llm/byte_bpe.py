"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens lie side by side in one linked list of byte positions. A bucket per
merge rank holds the positions whose pair has that rank; a three-level bitmap of
64-bit words says which buckets are filled, and find-first-set picks the next
rank. Entries whose pair has changed meanwhile are stale and skipped. All
positions of a bucket are merged at once, from left to right where they overlap,
so the cost follows the number of merges, however long a pre-token is.

A merge can make a pair of a lower rank only if the merged token is the end or
the beginning of a token of lower rank. Where that happens in front of another
position of the same pre-token, the order of single merges matters, and this
pre-token is merged alone, one position at a time. A bucket of few positions
is merged one by one in any case, without arrays made for it; those behind a
merge that makes a pair of a lower rank go back into their bucket.

A null text counts as empty and has no tokens. Repeated rows are encoded one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelspark.llm.common import by_bytes

#: Bytes of text that a task encodes at once; a longer text is encoded alone.
SLICE_BYTES = 1_000_000
#: Words, and characters in them, beyond which a task forgets what it has encoded.
KNOWN_UNITS, KNOWN_CHARS = 200_000, 4_000_000

NONE = -1
#: Positions of a bucket up to which they are merged one by one.
FEW = 64
#: Unicode white space. A text falls into runs of it and the words between; only those are split by the pattern.
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]").findall

_SHIFT = np.uint64(64 - 21)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _distinct(positions: np.ndarray) -> np.ndarray:
    positions = np.sort(positions)
    return positions[np.concatenate(([True], positions[1:] != positions[:-1]))]


def _gather(ids: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs of `ids` with these starts and lengths, end to end."""
    ends = np.cumsum(lens)
    return ids[np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]


class RankQueue:
    """Buckets of positions by rank; a bitmap of three levels finds the lowest filled one."""

    def __init__(self, ranks: int):
        self.buckets: list[list[np.ndarray | int] | None] = [None] * ranks
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0

    def push(self, rank: int, positions: np.ndarray | int) -> None:
        bucket = self.buckets[rank]
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[np.ndarray | int]] | None:
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = (a << 6) + (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = (b << 6) + (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        bucket, self.buckets[rank] = self.buckets[rank], None
        return rank, bucket

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Each position into the bucket of its rank."""
        if len(ranks) == 1:
            self.push(int(ranks[0]), positions)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist(), len(ranks)]
        for rank, i, j in zip(ranks[starts[:-1]].tolist(), starts, starts[1:]):
            self.push(rank, positions[i:j])


class ByteBpe:
    """Ranks of a byte-level vocabulary: `token bytes (base64) rank` per line."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self._forget()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.token = [b""] * self.size
        for t, r in self.ranks.items():
            self.token[r] = t
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = {}
        self.early = np.zeros(self.size, dtype=bool)
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                left, right = self.ranks.get(t[:i], NONE), self.ranks.get(t[i:], NONE)
                if left > r:
                    self.early[left] = True
                if right > r:
                    self.early[right] = True
                if left != NONE and right != NONE:
                    pairs[left << 32 | right] = r
        self._keys = np.full(1 << 21, NONE, dtype=np.int64)
        self._values = np.full(1 << 21, NONE, dtype=np.int32)
        keys, values = np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int32)
        slots = self._slots(keys)
        while len(keys):  # open addressing: the first of those that want a free slot gets it
            first = np.unique(slots, return_index=True)[1]
            first = first[self._keys[slots[first]] == NONE]
            self._keys[slots[first]], self._values[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & (len(self._keys) - 1)

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> _SHIFT).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NONE where there is none or no right neighbour."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slots(keys)
        found = self._keys[slots]
        ranks = np.where(found == keys, self._values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != NONE) & (right != NONE))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self._keys) - 1)
            found = self._keys[slots[open_]]
            hit = found == keys[open_]
            ranks[open_[hit]] = self._values[slots[open_[hit]]]
            open_ = open_[~hit & (found != NONE)]
        return np.where(right == NONE, NONE, ranks)

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of ids of each."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(data)
        tok = np.empty(n + 1, dtype=np.int32)
        tok[:n], tok[n] = self.byte_id[data], NONE
        nxt = np.arange(1, n + 2, dtype=np.int32)
        prv = np.arange(-1, n, dtype=np.int32)
        ends = np.cumsum(lengths)
        nxt[ends - 1] = n
        prv[ends - lengths] = n
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        rank = np.full(n + 1, NONE, dtype=np.int32)
        rank[:n] = self.pair_ranks(tok[:n], tok[nxt[:n]])
        queue, alone = RankQueue(self.size), []
        filled = np.flatnonzero(rank[:n] != NONE).astype(np.int32)
        if len(filled):
            queue.push_all(rank[filled], filled)
        views = [memoryview(a) for a in (tok, nxt, prv, rank)]
        while (popped := queue.pop()) is not None:
            r, bucket = popped
            if sum(1 if type(b) is int else len(b) for b in bucket) <= FEW:
                self._merge_few(r, sorted({p for b in bucket for p in ((b,) if type(b) is int else b.tolist())}), *views, n, queue)
                continue
            at = bucket[0] if len(bucket) == 1 else np.concatenate([np.atleast_1d(np.asarray(b, dtype=np.int32)) for b in bucket])
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = at if len(bucket) == 1 else _distinct(at)
                chained = nxt[at[:-1]] == at[1:]
                if chained.any():  # overlapping pairs: every second one of a run
                    index = np.arange(len(at))
                    run = np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), index, 0))
                    at = at[(index - run) % 2 == 0]
                if self.early[r] and len(at) > 1:
                    at = self._in_order(r, at, tok, nxt, prv, rank, piece, ends, lengths, alone)
                    if not len(at):
                        continue
            right = nxt[at]
            after = nxt[right]
            tok[at] = r
            tok[right] = NONE
            rank[right] = NONE
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            touched = np.concatenate((at, before[before != n]))
            touched = _distinct(touched)
            fresh = self.pair_ranks(tok[touched], tok[nxt[touched]])
            rank[touched] = fresh
            good = fresh != NONE
            if good.any():
                queue.push_all(fresh[good], touched[good])
        for p in alone:
            ids = self._merge_one(pieces[p])
            tok[ends[p] - lengths[p]:ends[p]] = NONE
            tok[ends[p] - lengths[p]:ends[p] - lengths[p] + len(ids)] = ids
        alive = tok[:n] != NONE
        return tok[:n][alive], np.bincount(piece[alive], minlength=len(pieces))

    def _merge_few(self, r, positions, tok, nxt, prv, rank, n, queue) -> None:
        """The positions of a bucket from left to right, as long as no pair of lower rank arises."""
        token, pair = self.token, self.ranks.get
        merged = token[r]
        for k, at in enumerate(positions):
            if rank[at] != r:
                continue
            right = nxt[at]
            after, before = nxt[right], prv[at]
            tok[at], tok[right], rank[right], nxt[at], prv[after] = r, NONE, NONE, after, at
            lower = False
            rank[at] = fresh = NONE if after == n else pair(merged + token[tok[after]], NONE)
            if fresh != NONE:
                queue.push(fresh, at)
                lower = fresh < r
            if before != n:
                rank[before] = fresh = pair(token[tok[before]] + merged, NONE)
                if fresh != NONE:
                    queue.push(fresh, before)
                    lower = lower or fresh < r
            if lower:
                for later in positions[k + 1:]:
                    queue.push(r, later)
                return

    def _in_order(self, r, at, tok, nxt, prv, rank, piece, ends, lengths, alone) -> np.ndarray:
        """The positions that can be merged together though `r` can make pairs of lower rank.

        A position makes such a pair with its neighbours as they are when its turn
        comes: the left one already merged, the right one not yet. A piece where
        such a position stands before another one is set apart, to be merged alone.
        """
        after = nxt[nxt[at]]
        merged_left = np.concatenate(([False], after[:-1] == at[1:]))
        left = self.pair_ranks(np.where(merged_left, r, tok[prv[at]]), np.full(len(at), r, dtype=np.int32))
        right = self.pair_ranks(np.full(len(at), r, dtype=np.int32), tok[after])
        lower = ((left != NONE) & (left < r)) | ((right != NONE) & (right < r))
        of = piece[at]
        lower[:-1] &= of[1:] == of[:-1]
        lower[-1] = False
        if not lower.any():
            return at
        apart = np.unique(of[lower])
        alone += apart.tolist()
        for p in apart:
            rank[ends[p] - lengths[p]:ends[p]] = NONE
        return at[~np.isin(of, apart)]

    def _merge_one(self, piece: bytes) -> list[int]:
        """One piece, one merge at a time: the leftmost position of the lowest rank."""
        n = len(piece)
        tok = [self.ranks[piece[i:i + 1]] for i in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.ranks.get
        rank = [pair(piece[i:i + 2], NONE) if i + 1 < n else NONE for i in range(n)]
        queue: RankQueue = RankQueue(self.size)
        for i, r in enumerate(rank):
            if r != NONE:
                queue.push(r, i)
        while (popped := queue.pop()) is not None:
            r, heap = popped
            heapq.heapify(heap)
            while heap:
                at = heapq.heappop(heap)
                if rank[at] != r:
                    continue
                right = nxt[at]
                after = nxt[right]
                tok[at], tok[right], rank[right], nxt[at] = r, NONE, NONE, after
                if after < n:
                    prv[after] = at
                lowest = r
                for i in (prv[at], at):
                    if i >= 0:
                        j = nxt[i]
                        rank[i] = fresh = pair(self.token[tok[i]] + self.token[tok[j]], NONE) if j < n else NONE
                        if fresh == r:
                            heapq.heappush(heap, i)
                        elif fresh != NONE:
                            queue.push(fresh, i)
                            lowest = min(lowest, fresh)
                if lowest < r and heap:
                    for i in heap:
                        queue.push(r, i)
                    break
        return [t for t in tok if t != NONE]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A piece that is a token is that token; the others are merged together."""
        whole = np.array([self.ranks.get(p, NONE) for p in pieces], dtype=np.int32)
        open_ = np.flatnonzero(whole == NONE)
        counts = np.ones(len(pieces), dtype=np.int64)
        if not len(open_):
            return whole, counts
        ids, own = self._merge([pieces[i] for i in open_])
        counts[open_] = own
        out = np.empty(int(counts.sum()), dtype=np.int32)
        merged = np.repeat(whole == NONE, counts)
        out[merged], out[~merged] = ids, whole[whole != NONE]
        return out, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Words are split and merged once, and remembered from slice to slice up to a bound.

        The pattern joins one space to the word after it and else keeps words and
        white space apart, so a word with that space can be split by itself.
        """
        if len(self._unit_sizes) > KNOWN_UNITS or self._unit_chars > KNOWN_CHARS:
            self._forget()
        codes = [np.array(list(map(self._unit_code.__getitem__, _UNITS(text))), dtype=np.int32) for text in texts]
        fresh = list(itertools.islice(reversed(self._unit_code), len(self._unit_code) - len(self._unit_sizes)))[::-1]
        if fresh:
            code = defaultdict(itertools.count().__next__)
            split = [[code[p] for p in self.split(unit)] for unit in fresh]
            ids, sizes = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in code])
            chosen = np.fromiter(itertools.chain.from_iterable(split), dtype=np.int64)
            ids = _gather(ids, (np.cumsum(sizes) - sizes)[chosen], sizes[chosen])
            pieces = np.array([len(p) for p in split])
            sizes = np.add.reduceat(sizes[chosen], np.cumsum(pieces) - pieces)
            self._unit_ids = np.concatenate([self._unit_ids, ids])
            self._unit_sizes = np.concatenate([self._unit_sizes, sizes])
            self._unit_starts = np.cumsum(self._unit_sizes) - self._unit_sizes
            self._unit_chars += sum(map(len, fresh))
        return [_gather(self._unit_ids, self._unit_starts[own], self._unit_sizes[own]) for own in codes]

    def _forget(self) -> None:
        """Start anew with no words known."""
        self._unit_code = defaultdict(itertools.count().__next__)
        self._unit_ids, self._unit_chars = np.empty(0, dtype=np.int32), 0
        self._unit_sizes = self._unit_starts = np.empty(0, dtype=np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def encoder(docs: DataFrame, path: str, pattern: str):
    """The vocabulary file at `path`, sent once to each executor and parsed once per task."""
    with open(path, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    return lambda: ByteBpe(lines.value, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, columns: dict[str, T.DataType], row,
                     key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and `columns` per row; `row(bpe, ids)` makes their values from the token ids of the whole text."""
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(n, t) for n, t in columns.items()]])
    make = encoder(docs, path, pattern)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = make()
        for batch in by_bytes(batches, 1, SLICE_BYTES):
            made = [row(bpe, ids) for ids in bpe.encode([t or "" for t in batch.column(1).to_pylist()])]
            values = zip(*made) if made else [[] for _ in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow.field(0).type), *[pa.array(v, f.type) for v, f in zip(values, list(arrow)[1:])]],
                schema=arrow)

    return rows.mapInArrow(run, schema)


def token_ids(docs: DataFrame, path: str, pattern: str, **names: str) -> DataFrame:
    """Key and `token_ids` of every row."""
    return encode_documents(docs, path, pattern, {"token_ids": T.ArrayType(T.IntegerType())},
                            lambda bpe, ids: (ids,), **names)


def token_counts(docs: DataFrame, path: str, pattern: str, **names: str) -> DataFrame:
    """Key and `n_tokens` of every row."""
    return encode_documents(docs, path, pattern, {"n_tokens": T.LongType()}, lambda bpe, ids: (len(ids),), **names)


def round_trip(docs: DataFrame, path: str, pattern: str, **names: str) -> DataFrame:
    """Encode, decode, and give key, n_tokens, ids_sha256 and decoded_sha256 of every row."""

    def digests(bpe: ByteBpe, ids: np.ndarray):
        return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(bpe.decode(ids)).hexdigest())

    columns = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return encode_documents(docs, path, pattern, columns, digests, **names)


def decode_ids(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """Key and the text that `token_ids` stand for; null ids give a null text."""
    rows = tokens.select(key, ids)
    make = encoder(tokens, path, "")
    schema = T.StructType([rows.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = make()
        for batch in batches:
            texts = [None if v is None else bpe.decode(np.asarray(v, dtype=np.int64)).decode("utf-8", "replace")
                     for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return rows.mapInArrow(run, schema)
