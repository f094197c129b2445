"""Fill-in-the-middle and source mixing against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from panelspark.llm import fill_middle, mixture
from tests.llm.conftest import prose

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(key, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = UNITS.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50
    form = "plain" if plain else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return (len(units), form, None if plain else len(p), None if plain else len(m), out)


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["word", " ", "  ", "\n", "\t", "é", "😀", "x" * 40, "a b", "\x1c", "\xa0", "<P", ">", "<M>", "."]
    shared = prose(1, 3000)
    out = ["".join(rng.choices(bits, k=rng.randrange(0, 60))) for _ in range(n)]
    return out + [shared, shared, shared[200:], prose(2, 40) + " " + shared + " " + prose(3, 9), "x" * 300_000, " " * 70_000,
                  "é " * 50_000, ("ab" * 40 + "\n") * 4000, "", None]


def test_fill_middle_equals_brute_force(make_docs):
    rows = list(enumerate(texts(1, 400))) + [(None, "null id here"), (7, "again and again"), (7, "again and again")]
    made = fill_middle.fill_middle(make_docs(rows).withColumnRenamed("at", "form"))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    assert got == sorted(((k, *brute_fim(k, t)) for k, t in rows), key=str)
    digests = fill_middle.fim_digests(make_docs(rows)).collect()
    want = {(k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows}
    assert {(r.doc_id, r.restored_sha256) for r in digests} == want
    assert fill_middle.fim_digests(make_docs([])).count() == 0


def test_chunks_follow_content_and_are_remembered():
    shared = prose(5, 20_000).encode()
    other = b"another opening, " + shared
    cuts = {shared[a:b] for a, b in zip([0, *fill_middle.chunk_ends(shared)], fill_middle.chunk_ends(shared))}
    moved = [other[a:b] for a, b in zip([0, *fill_middle.chunk_ends(other)], fill_middle.chunk_ends(other))]
    assert sum(c in cuts for c in moved) >= len(moved) - 3 > 20
    cache = fill_middle.ChunkCache()
    first = cache.cut(shared, (10, 20))
    missed = cache.misses
    assert cache.cut(other, (10, 20))[0] == first[0] + 2 and cache.misses - missed <= 3 and cache.hits > 20
    tiny = fill_middle.ChunkCache(limit=5000)
    assert tiny.cut(shared, (10, 20)) == first and tiny.bytes <= 20_000
    for data in (b"x" * 100_000, shared, b"a", b" " * 20_000):
        assert np.diff(fill_middle.chunk_ends(data), prepend=0).max() <= fill_middle.CHUNK_MOST


def test_slices_do_not_move_chunks(monkeypatch):
    data = prose(6, 30_000).encode()
    whole = fill_middle.chunk_ends(data)
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", 1000)
    assert (fill_middle.chunk_ends(data) == whole).all()


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_w = sum(w[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else w[s] * rest / open_w for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed, hot", [(1, False), (2, True)])
def test_mixture(make_docs, seed, hot):
    rng = random.Random(seed)
    sources = ["a", "b", "Z", "é", None, "b c", "empty"]
    rows = [(i, None if s == "empty" else prose(i, int(rng.lognormvariate(3, 1))), "en", s)
            for i in range(3000) for s in ["a" if hot and i % 3 else rng.choice(sources)]]
    rows += [(9, "one two three", "en", "a")] * 700 + [(None, "lone words", "en", None)]
    docs = make_docs(rows)
    got = mixture.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for _, text, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((text or "").split())
    want = brute_targets(sizes)
    by_target = {(sizes[s], round(t, 6)) for s, t in want.items()}
    assert {(r.source_size, round(r.target, 6)) for r in got} == by_target
    for r in got:
        assert r.taken == r.copies * r.size <= 2 * r.size
        k = r.source_size, round(r.target, 6)
        taken[k] = taken.get(k, 0) + r.taken
    for (size, target), words in taken.items():
        assert abs(words - target) <= 0.02 * size + 300
    again = mixture.mix_sources(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_blocks_do_not_change_places(make_docs, monkeypatch):
    docs = make_docs([(i, prose(i % 50, i % 40), "en", f"s{i % 3}") for i in range(2000)])
    whole = sorted(map(tuple, mixture.mix_sources(docs).collect()))
    monkeypatch.setattr(mixture, "BLOCK_ROWS", 5)
    assert sorted(map(tuple, mixture.mix_sources(docs).collect())) == whole
    assert mixture.mix_sources(make_docs([])).count() == 0
    assert [r.taken for r in mixture.mix_sources(make_docs([(1, None), (2, "")])).collect()] == [0, 0]
