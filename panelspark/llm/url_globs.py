"""URL filter: all glob rules as one bit-parallel Shift-And automaton.

Every rule is a chain of states, one bit each, packed side by side into 64-bit
words. One step per character advances all rules over all URLs of a block:

    state = ((state & takes[c]) << 1) | (state & stays[c])

`takes[c]` has the states that a character moves on, `stays[c]` the states in
front of a star. `*` stands for characters other than `/`, `**` for any
characters and `?` for one character.

The block globs see a canonical copy of the URL: escapes of unreserved characters
are decoded, the path is lower-cased and its dot segments are resolved. The
returned path and the host rules keep the path as it is.

A URL without `://` or a null URL has an empty host and path, fits no rule and
is allowed. Repeated rows are judged one by one; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (verdict, host, path): fits the host and its subdomains if the path starts with the rule's; the longest rule wins.
HOST_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Globs over host and path that block a URL which no host rule decides.
BLOCK_GLOBS = (
    "*casino**", "*pills**", "*adult**", "*free-bets**", "*spam**", "ads-**", "*.ads-**",
    "**/wp-login*", "**/wp-admin/**", "**/cgi-bin/**", "**.exe", "**.apk",
)

#: Cells of a block of URLs (rows x characters) that are held at once.
BLOCK_CELLS = 2_000_000


_ESCAPE = re.compile(r"%(2[DdEe]|3[0-9]|[46][1-9A-Fa-f]|[57][0-9Aa]|5[Ff]|7[Ee])")
_DOTS = re.compile(r"/\.\.?(/|$)")


def canonical(host: str, path: str) -> str:
    """Host and path with escapes of unreserved characters decoded, the path lower-cased and its dot segments resolved."""
    if "%" in host or "%" in path:
        host, path = (_ESCAPE.sub(lambda m: chr(int(m[1], 16)), x) for x in (host, path))
    path = path.lower()
    if _DOTS.search(path):
        out: list[str] = []
        parts = path.split("/")[1:]
        for part in parts:
            if part == "..":
                del out[-1:]
            elif part != ".":
                out.append(part)
        path = "/" + "/".join(out + [""] * (parts[-1] in (".", "..") and bool(out)))
    return host.lower() + path


def glob_states(glob: str) -> tuple[list[str | None], dict[int, bool]]:
    """Characters that move state j on (None: any), and the states that stay (True: also at `/`)."""
    moves: list[str | None] = []
    stays: dict[int, bool] = {}
    i = 0
    while i < len(glob):
        if glob[i] == "*":
            wide = glob[i:i + 2] == "**"
            stays[len(moves)] = stays.get(len(moves), False) or wide
            i += 2 if wide else 1
        else:
            moves.append(None if glob[i] == "?" else glob[i])
            i += 1
    return moves, stays


class GlobAutomaton:
    """All globs over one packed bit vector per URL."""

    def __init__(self, globs: list[str]):
        parsed = [glob_states(g) for g in globs]
        self.alphabet = np.array(sorted({ord(c) for moves, _ in parsed for c in moves if c} | {ord("/")}), dtype=np.uint32)
        classes = len(self.alphabet) + 1  # the last class has all other characters
        bits = sum(len(moves) + 1 for moves, _ in parsed)
        self.words = max(1, -(-bits // 64))
        takes = [0] * classes
        stays = [0] * classes
        first, self.accept, at = 0, [], 0
        for moves, loops in parsed:
            first |= 1 << at
            for j, c in enumerate(moves):
                for k in range(classes) if c is None else [int(np.searchsorted(self.alphabet, ord(c)))]:
                    takes[k] |= 1 << (at + j)
            for j, wide in loops.items():
                for k in range(classes):
                    if wide or k == classes - 1 or self.alphabet[k] != ord("/"):
                        stays[k] |= 1 << (at + j)
            self.accept.append(at + len(moves))
            at += len(moves) + 1
        self.first = self._pack([first])[0]
        self.takes, self.stays = self._pack(takes), self._pack(stays)

    def _pack(self, masks: list[int]) -> np.ndarray:
        return np.array([[(m >> (64 * w)) & (2**64 - 1) for w in range(self.words)] for m in masks], dtype=np.uint64)

    def _run(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """End states of a block whose rows are in order of length."""
        state = np.repeat(self.first[None, :], len(lengths), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for i in range(codes.shape[1]):
            live = int(np.searchsorted(lengths, i, side="right"))  # shorter rows have ended
            now, c = state[live:], codes[live:, i]
            taken = now & self.takes[c]
            moved = taken << one
            moved[:, 1:] |= taken[:, :-1] >> top
            state[live:] = moved | (now & self.stays[c])
        return state

    def matches(self, urls: list[str]) -> np.ndarray:
        """Boolean matrix: URL x glob."""
        lengths = np.array([len(u) for u in urls], dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        out = np.zeros((len(urls), len(self.accept)), dtype=bool)
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end - start + 1) * max(1, lengths[order[end]]) <= BLOCK_CELLS:
                end += 1
            rows = order[start:end]
            widest = int(lengths[rows[-1]])
            codes = np.full((len(rows), widest), len(self.alphabet), dtype=np.int32)
            for k, r in enumerate(rows):
                points = np.frombuffer(urls[r].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
                codes[k, :len(points)] = np.where(self.alphabet[at] == points, at, len(self.alphabet))
            state = self._run(codes, lengths[rows])
            for g, bit in enumerate(self.accept):
                out[rows, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
            start = end
        return out


@dataclass(frozen=True)
class UrlPolicy:
    """Host rules decide first; without one, a URL that any block glob matches is blocked."""

    rules: tuple[tuple[str, str, str], ...] = HOST_RULES
    block: tuple[str, ...] = BLOCK_GLOBS

    def globs(self) -> list[str]:
        own = [g for _, host, path in self.rules for g in (f"{host}{path}**", f"*.{host}{path}**")]
        return own + list(self.block)

    def judge(self, automaton: GlobAutomaton, urls: list[str], plain: list[str] | None = None) -> tuple[list[str | None], list[str]]:
        """Rule and verdict of every URL; the block globs see `plain`, the canonical copies, if they are given."""
        hit = automaton.matches(urls)
        n = len(self.rules)
        other = [i for i, (u, p) in enumerate(zip(urls, plain or urls)) if u != p]
        if other:
            hit[other, 2 * n:] = automaton.matches([plain[i] for i in other])[:, 2 * n:]
        fits = hit[:, 0:2 * n:2] | hit[:, 1:2 * n:2]
        size = np.array([len(host) + len(path) for _, host, path in self.rules])
        best = np.where(fits, size[None, :], -1).argmax(axis=1)
        ruled, bad = fits.any(axis=1), hit[:, 2 * n:].any(axis=1)
        rule = [f"{self.rules[b][1]}{self.rules[b][2]}" if r else None for b, r in zip(best, ruled)]
        verdict = [self.rules[b][0] if r else ("block" if x else "allow") for b, r, x in zip(best, ruled, bad)]
        return rule, verdict


def judge_urls(pages: DataFrame, policy: UrlPolicy = UrlPolicy(), key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of `pages`: key, host, path, rule and verdict."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(F.col("_rest"), r"^[^/?#]*", 0)
    parts = (
        pages.select(F.col(key).alias(key), rest.alias("_rest"))
        .select(key, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
                F.regexp_extract(F.col("_rest"), r"^[^/?#]*([^?#]*)", 1).alias("path"))
    )
    schema = T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(policy.globs())
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule, verdict = policy.judge(automaton, [h + p for h, p in zip(hosts, paths)], [canonical(h, p) for h, p in zip(hosts, paths)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                [*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(run, schema)
