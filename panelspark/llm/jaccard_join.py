"""Word n-gram Jaccard join by universe partition and pigeonhole.

Two sets of sizes a <= b with Jaccard similarity t differ in at most
`(a + b)(1 - t)/(1 + t)` elements. All hash values are cut into m segments, m
fixed per size band, and a document is indexed by the content of its segments.
If a document has more heavy segments (two elements or more) than it can differ
from any partner, one of them is equal in both documents. A document with fewer
also indexes the one-deletion neighbourhoods of its segments, in which each
segment may differ by one element; if that is not enough either, it indexes the
least of its single elements, the finest partition. A pair is found if either
side is covered by its heavy segments, and otherwise because both have indexed
the neighbourhoods or elements, so no link is lost. m is the number of segments
of least cost: signatures of a document, plus its deletions times the chance
that it needs them.

Equal sets are collapsed first, and within a batch of rows a signature leaves
once, so neither copies nor near copies pile up. Documents that share a
signature are compared with one of them only, not with each other. Where that
leaves documents of a signature in different components, they are compared in
pairs of blocks until they are one component or every pair has been seen. This
finds every component without a row per pair. Candidates are verified on their
whole sets.

A document without words or text has an empty set, and is linked with nothing.
A row with a null key has a null component and takes no part. Repeated rows are
equal sets. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import by_bytes, small, written
from panelspark.llm.components import connected_components

_U = np.uint64
#: Bytes of text that are indexed in one batch, and whose sets leave a task at once.
INDEX_BYTES, SET_BYTES = 8_000_000, 2_000_000
#: Documents of a signature in a block; two blocks on average this large are compared at once.
BLOCK_SETS = 512
#: Ids that may be broadcast to pick the documents of candidates (8 bytes each).
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class JaccardRule:
    """Shingles of `words` words; linked if 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def largest(self, a: int) -> int:
        return a * 100 // self.percent


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; A-Z lower-cased, words cut at the six ASCII spaces."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=_U)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in parts], dtype=_U)
    n = min(words, len(h))
    acc = np.full(len(h) - n + 1, n, dtype=_U)
    for k in range(n):
        acc = acc * _U(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k]
    return np.unique(mix(acc))


@lru_cache(maxsize=None)
def bands(rule: JaccardRule, size: int) -> tuple[tuple[int, int, int], ...]:
    """(number, largest size, segments) of each band in which a set of this size takes part."""
    ratio = (100 / rule.percent) ** 2
    lo, k, out = 1, 0, []
    while lo <= size:
        hi = max(lo, int(lo * ratio))
        if rule.largest(hi) >= size:
            out.append((k, hi, segments(rule, hi)))
        lo, k = hi + 1, k + 1
    return tuple(out)


@lru_cache(maxsize=None)
def segments(rule: JaccardRule, hi: int) -> int:
    """Number of segments of least expected cost for the largest sets of a band."""
    need = rule.differ(hi, rule.largest(hi)) + 1
    spare = min(8, hi // 16)  # signatures that a document can do without

    def cost(m: int) -> float:
        s = hi / m
        light = math.exp(-s) * (1 + s)
        mean, deviation = m * (1 - light), math.sqrt(m * light * (1 - light)) + 1e-9
        short = 0.5 * math.erfc((mean - need - spare + 0.5) / deviation / math.sqrt(2))
        return m + short * (hi + m)

    return min(range(need, 2 * need + 16), key=cost)


def signatures(rule: JaccardRule, h: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Per band of one set of sorted hashes: how many signatures every partner shares at least, and the signatures."""
    n, out = len(h), []
    content = mix(h ^ _U(0xD6E8FEB86659FD93))
    for k, hi, m in bands(rule, n):
        most = rule.differ(n, rule.largest(n) if n <= hi else hi)
        if most == 0:
            continue  # equal sets only
        seg = ((h >> _U(32)) * _U(m)) >> _U(32)
        starts = np.concatenate(([0], np.flatnonzero(seg[1:] != seg[:-1]) + 1))
        counts = np.diff(np.append(starts, n))
        sums = np.add.reduceat(content, starts)
        salt = mix(seg[starts] + _U((k + 1) << 40))
        heavy = counts >= 2
        exact = mix(sums[heavy] + salt[heavy])
        covered = int(heavy.sum())
        if covered > most:
            out.append((covered - most, exact))
            continue
        of = np.repeat(np.arange(len(starts)), counts)
        many = heavy[of]
        near = mix(salt + _U(1))
        more = [exact, mix(sums + near), mix((sums[of] - content + near[of])[many])]
        if 2 * covered <= most:
            first = n - -(-n * rule.percent // 100) + 1
            more.append(mix(h[:first] + _U((k + 1) << 40) + _U(2)))
        out.append((1, np.unique(np.concatenate(more))))
    return out


def _longs(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


_BAND = T.StructType([T.StructField("least", T.IntegerType()), T.StructField("sigs", T.ArrayType(T.LongType())),
                      T.StructField("firsts", T.ArrayType(T.LongType())), T.StructField("followed", T.ArrayType(T.BooleanType()))])


def index_sets(docs: DataFrame, rule: JaccardRule, key: str, text: str) -> DataFrame:
    """id, n_shingles, set_digest (null for an empty set), and its bands: signatures, the id of the batch that had
    each first (null: this one), and whether others of the batch have it too."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_shingles", T.LongType()),
                           T.StructField("set_digest", T.BinaryType()), T.StructField("bands", T.ArrayType(_BAND))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in by_bytes(batches, 1, INDEX_BYTES):
            seen: set[bytes] = set()
            sizes, digests, of_row, least, parts, owners = [], [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = shingles(t, rule.words)
                d = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
                made = []
                if i is not None and d is not None and d not in seen:
                    seen.add(d)
                    made = signatures(rule, h)
                sizes.append(len(h))
                digests.append(d)
                of_row.append(len(made))
                for shared, sigs in made:
                    least.append(shared)
                    parts.append(sigs)
                    owners.append(i)
            lens = [len(p) for p in parts]
            flat = np.concatenate(parts) if parts else np.empty(0, dtype=_U)
            owner = np.repeat(np.array(owners, dtype=np.int64), lens)
            order = np.argsort(flat, kind="stable")
            new = np.ones(len(flat), dtype=bool)
            new[1:] = flat[order[1:]] != flat[order[:-1]]
            first, own, followed = np.empty(len(flat), dtype=np.int64), np.empty(len(flat), dtype=bool), np.zeros(len(flat), dtype=bool)
            first[order] = owner[order][np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))]
            own[order] = new
            followed[order[:-1]] = new[:-1] & ~new[1:]
            ends = pa.array(np.cumsum([0, *lens]).astype(np.int32))
            bands_ = pa.StructArray.from_arrays(
                [pa.array(least, pa.int32()), _longs(parts), pa.ListArray.from_arrays(ends, pa.array(first, mask=own)),
                 pa.ListArray.from_arrays(ends, pa.array(followed))], [f.name for f in _BAND])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.cumsum([0, *of_row]).astype(np.int32)), bands_)], schema.names)

    return rows.mapInArrow(run, schema)


def set_arrays(docs: DataFrame, ids: DataFrame, rule: JaccardRule, key: str, text: str) -> DataFrame:
    """id and the whole sorted set of hashes of the documents in `ids`."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).join(small(ids, BROADCAST_IDS), "id", "left_semi")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, SET_BYTES):
            sets = [shingles(t, rule.words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _longs(sets)], schema.names)

    return rows.mapInArrow(run, schema)


def verified(docs: DataFrame, pairs: DataFrame, rule: JaccardRule, key: str, text: str) -> DataFrame:
    """`pairs` (x, y) with `linked`, decided on the whole sets."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    sets = written(set_arrays(docs, ids, rule, key, text), "jaccard-sets")
    one = sets.select(F.col("id").alias("x"), F.col("set").alias("sx"))
    two = sets.select(F.col("id").alias("y"), F.col("set").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    linked = 100 * both >= rule.percent * (F.size("sx") + F.size("sy") - both)
    return pairs.join(one, "x").join(two, "y").select("x", "y", linked.alias("linked"))


def links_in_blocks(docs: DataFrame, members: DataFrame, rule: JaccardRule, key: str, text: str) -> DataFrame:
    """a, b: links between documents of a signature that lie in different components, enough to join those components.

    The documents of a signature, or of a family of signatures that share
    documents, are dealt into blocks of bounded size, and every pair of blocks is
    compared as a whole, so no pair of documents is a row.
    """
    groups = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("one"), F.max("c").alias("other"),
                                        F.min("id").alias("centre"))
    groups = groups.where("one < other").select("sig", "centre", F.ceil(F.col("size") / BLOCK_SETS).cast("int").alias("blocks"))
    members = written(members.join(groups, "sig").select("sig", "id", "c", "centre", "blocks"), "jaccard-members")
    families = connected_components(members.select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct())
    members = _with_component(members, families, "id", "family")

    # a family is compared as a whole, or signature by signature, whichever sends fewer sets
    whole = members.select("family", "id", "c").distinct()
    cost = whole.groupBy("family").agg(F.count(F.lit(1)).alias("size")).join(
        members.groupBy("family").agg(F.sum("blocks").alias("apart")), "family")
    all_blocks = F.ceil(F.col("size") / BLOCK_SETS).cast("int")
    cost = cost.select("family", all_blocks.alias("all_blocks"), (F.col("size") * all_blocks <= F.col("apart")).alias("at_once"))
    cost = written(cost, "jaccard-families")
    one = whole.join(cost.where("at_once"), "family").select(F.lit(0).alias("kind"), F.col("family").alias("grp"), "id", "c", F.col("all_blocks").alias("blocks"))
    two = members.join(cost.where("not at_once"), "family").select(F.lit(1).alias("kind"), F.col("sig").alias("grp"), "id", "c", "blocks")
    dealt = one.union(two).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sets = set_arrays(docs, members.select("id").distinct(), rule, key, text)
    dealt = dealt.select("kind", "grp", "id", "c", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("kind", "grp", "id", "c", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(group: pa.Table) -> pa.Table:
        ids, parts = group.column("id").to_numpy(), group.column("c").to_numpy()
        flat = group.column("set").combine_chunks()
        sets_ = [v.values.to_numpy(zero_copy_only=False).view(_U) for v in flat]
        found = _links(parts, sets_, rule)
        return pa.table({"a": ids[[x for x, _ in found]] if found else pa.array([], pa.int64()),
                         "b": ids[[y for _, y in found]] if found else pa.array([], pa.int64())})

    return dealt.join(sets, "id").groupBy("kind", "grp", "low", "high").applyInArrow(compare, schema).distinct()


def _links(parts: np.ndarray, sets: list[np.ndarray], rule: JaccardRule) -> list[tuple[int, int]]:
    """Linked rows of different components, until they are one component or all have been compared."""
    parent = {int(c): int(c) for c in parts}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for x, s in enumerate(sets):
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        lens = hi - lo
        ends = np.cumsum(lens)
        with_x = owner[np.repeat(lo - ends + lens, lens) + np.arange(ends[-1])]
        both = np.bincount(with_x, minlength=len(sets))[:x]
        linked = np.flatnonzero((100 * both >= rule.percent * (sizes[:x] + sizes[x] - both)) & (both > 0))
        for y in linked:
            a, b = root(int(parts[x])), root(int(parts[y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x, int(y)))
    return out


def shared_postings(index: DataFrame) -> DataFrame:
    """sig, id and n (set size) of the signatures by which documents are compared.

    A document shares at least `least` signatures of a band with every partner,
    so it can do without its `least - 1` most frequent ones: of those that two
    partners share, the rarest is kept by both. Signatures that one document
    alone has are left out.
    """
    bands_ = index.where("size(bands) > 0").select("id", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "b"))
    postings = bands_.select("id", "n", "band", F.col("b.least").alias("least"), F.explode(
        F.arrays_zip(F.col("b.sigs").alias("sig"), F.col("b.firsts").alias("first"), F.col("b.followed").alias("followed"))).alias("p"))
    postings = postings.select("id", "n", "band", "least", "p.sig", "p.first", "p.followed")
    group = Window.partitionBy("sig")
    heads = postings.where("first is null").select(
        "id", "n", "band", "least", "sig", "followed", F.count(F.lit(1)).over(group).alias("often"), F.min("id").over(group).alias("rep"))
    heads = written(heads.where("often > 1 or followed"), "jaccard-heads")
    within = postings.where("first is not null").join(heads.where("id = rep").select("sig", "often"), "sig")
    columns = ["id", "n", "band", "least", "sig", "often"]
    rank = F.row_number().over(Window.partitionBy("id", "band").orderBy(F.col("often").desc(), "sig"))
    shared = heads.select(*columns).union(within.select(*columns)).withColumn("rank", rank)
    return shared.where("rank >= least").select("sig", "id", "n")


def link_components(docs: DataFrame, rule: JaccardRule = JaccardRule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles and component_id, the least key that links reach."""
    index = written(index_sets(docs, rule, key, text), "jaccard-index")
    heads = index.where("id is not null and set_digest is not null").groupBy("set_digest").agg(F.min("id").alias("head"))
    kept = written(shared_postings(index), "jaccard-postings")

    # every document of a signature against one of them
    centres = kept.groupBy("sig").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("sig", "rep")
    stars = written(kept.join(centres, "sig").where("id != rep").select("sig", F.col("id").alias("x"), F.col("rep").alias("y")), "jaccard-stars")
    judged = written(verified(docs, stars.select("x", "y").distinct(), rule, key, text), "jaccard-judged")
    equal = index.where("size(bands) > 0").select("id", "set_digest").join(heads, "set_digest").where("id != head").select(
        F.col("id").alias("a"), F.col("head").alias("b"))
    links = judged.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b")).union(equal)
    found = connected_components(links)

    # signatures in which a candidate failed and is still apart: their documents in pairs of blocks
    apart = judged.where("not linked").select("x", "y")
    apart = _with_component(_with_component(apart, found, "x", "cx"), found, "y", "cy").where("cx != cy").select("x", "y")
    doubtful = written(stars.join(apart, ["x", "y"]).select("sig").distinct(), "jaccard-doubtful")
    if not doubtful.isEmpty():
        members = _with_component(kept.join(small(doubtful, BROADCAST_IDS), "sig", "left_semi"), found, "id", "c")
        again = links_in_blocks(docs, members, rule, key, text)
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(again))

    placed = index.select("id", "n_shingles", "set_digest").join(heads, "set_digest", "left")
    placed = _with_component(placed, found, "head", "c")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return placed.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"))


def _with_component(df: DataFrame, found: DataFrame, node: str, name: str) -> DataFrame:
    """`df` with the component of `node`: itself where the table has none."""
    other = found.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return df.join(other, F.col(node) == F.col("_n"), "left").withColumn(name, F.coalesce("_c", node)).drop("_n", "_c")
