"""Operators that compare documents, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from panelspark.llm import components, decontaminate, jaccard_join, line_dedup
from tests.llm.conftest import prose


def changed(text, seed, n):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def brute_components(rows, words, percent):
    sets = {}
    for key, text, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[key] = frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    postings = defaultdict(list)
    for k, s in sets.items():
        for o, n in Counter(o for g in s for o in postings[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = root(k), root(o)
                parent[max(a, b)] = min(a, b)
        for g in s:
            postings[g].append(k)
    return {k: (len(s), root(k)) for k, s in sets.items()}


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join_equals_brute_force(make_docs, words, percent):
    rng, rows = random.Random(words), []
    for i in range(700):
        base = prose(rng.randrange(60), rng.choice([3, 6, 9, 12, 20, 40, 90, 200]))
        rows.append((i + 10, changed(base, i, rng.choice([0, 0, 1, 1, 2, 3, 6]))))
    rows += [(1, None), (2, ""), (3, "Tiny one"), (4, "tiny ONE"), (5, "tiny"), (6, prose(9, 20_000)), (7, prose(9, 20_000) + " end")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(
        make_docs(rows).repartition(6), jaccard_join.JaccardRule(words, percent)).collect()}
    assert got == brute_components(rows, words, percent)


def test_signatures_meet_for_every_linked_pair():
    rng = random.Random(4)
    for percent in (60, 80, 85, 95):
        rule = jaccard_join.JaccardRule(1, percent)
        for n in [*range(1, 60), 75, 120, 333, 800]:
            for _ in range(6):
                base = [f"{n}w{rng.random()}" for _ in range(n)]
                room = rule.differ(n, rule.largest(n))
                drop, add = rng.randint(0, room), rng.randint(0, room)
                other = base[drop:] + [f"x{rng.random()}" for _ in range(add)]
                if other and 100 * (n - drop) >= percent * (n + add) and set(other) != set(base):
                    a, b = (jaccard_join.shingles(" ".join(x), 1) for x in (base, other))
                    one, two = jaccard_join.signatures(rule, a), jaccard_join.signatures(rule, b)
                    met = [(max(x, y), len(np.intersect1d(s, t))) for x, s in one for y, t in two]
                    assert any(shared >= least for least, shared in met), (percent, n, drop, add)


def test_jaccard_join_odd_rows(make_docs, odd_rows):
    got = jaccard_join.link_components(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(k, k) for k in (1, 2, 3, 4, 5, 6, 7, 8, None)}
    assert jaccard_join.link_components(make_docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1000, i) for i in range(1001, 1060)] + [(7, 7), (None, 3), (5, 4), (4, 5)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 100 for i in range(101, 141)} | {i: 1000 for i in range(1001, 1060)} | {5: 4}
    assert got == want


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, prose(501, 30)), (2, prose(502, 14)), (3, prose(501, 30)), (4, "too short"), (5, None), (6, ""), (7, prose(503, 120)), (None, None)]
    return spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, words string")


def test_leaks(make_docs, bench, odd_rows):
    one, two, seven = prose(501, 30), prose(502, 14), prose(503, 120)
    words = one.split()
    swapped = " ".join("zzz" if i in (4, 11, 20) else w for i, w in enumerate(words))
    rows = odd_rows + [
        (100, f"{prose(1, 50)} {one} {prose(2, 50)}"), (101, one), (102, f"{prose(3, 9)}, {swapped.upper()}! {prose(4, 9)}"),
        (103, two), (104, f"{seven} {two} {two}"), (105, prose(5, 400)), (106, " ".join(words[:8])), (107, " ".join(seven.split()[40:60])),
        (108, " ".join(two.split()[:7] + ["q"] + two.split()[8:])), (101, one)]
    rows = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
    got = decontaminate.mark_leaks(make_docs(rows), bench).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r["items"] for r in got if r.contaminated}
    assert found == {100: [1], 101: [1], 102: [1], 103: [2], 104: [2, 7], 107: [7], 108: [2]}
    assert all(r.n_items == len(r["items"] or []) for r in got)
    kept = decontaminate.drop_leaks(make_docs(rows), bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in found)
    assert decontaminate.mark_leaks(make_docs([]), bench).count() == 0
    assert decontaminate.mark_leaks(make_docs(rows), bench.limit(0)).where("contaminated").count() == 0


def test_leaks_in_blocks(make_docs, bench, monkeypatch):
    rows = [(i, f"{prose(i, 20)} {prose(501 + i % 3, [30, 14, 120][i % 3])}") for i in range(12)]
    whole = sorted(map(tuple, decontaminate.find_leaks(make_docs(rows), bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 150)
    assert sorted(map(tuple, decontaminate.find_leaks(make_docs(rows), bench).collect())) == whole and len(whole) == 12


def test_leak_plan_has_no_python(make_docs, bench):
    plan = decontaminate.mark_leaks(make_docs([(1, "a b")]), bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def brute_lines(rows, least):
    first, out = {}, {}
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        at, gone, kept = 0, [], []
        for line in (text or "").split("\n"):
            unit = " ".join(line.lower().split())
            seen = len(unit.split()) >= least and first.setdefault(unit, (key, at))
            if seen and seen != (key, at):
                gone.append((at, at + len(line)))
            else:
                kept.append(line)
            at += len(line) + 1
        out[key] = (gone, None if text is None else "\n".join(kept))
    return out


def test_repeated_lines(make_docs, odd_rows):
    shared = [prose(900 + i, 55) for i in range(4)]
    rows = odd_rows + [(100 + i, "\n".join([prose(i, 25), shared[i % 4], "short line", prose(i + 7, 25).upper(), shared[0]])) for i in range(40)]
    rows = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
    got = line_dedup.remove_repeats(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = brute_lines([r for r in rows if r[0] is not None], 20)
    for r in got:
        if r.doc_id is not None:
            assert ([(x.start, x.end) for x in r.removed or []], r.text) == want[r.doc_id], r.doc_id
            assert r.n_removed == len(r.removed or [])
    assert line_dedup.remove_repeats(make_docs([])).count() == 0


def test_pipeline(spark, tmp_path, make_docs, odd_rows):
    clean = [(100 + i, prose(2000 + i, 120)) for i in range(120)]
    rows = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in odd_rows + clean + [
        (500, prose(2000, 120)), (501, changed(prose(2001, 120), 1, 1)), (502, f"{prose(5000, 80)} {prose(501, 30)}"),
        (503, f"{prose(5001, 80)} write to jo@x.org"), (504, "spam " * 200), (505, "###$$$ " * 100)]]
    docs = make_docs(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(501, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
    kept = {r.doc_id: r.text for r in at.collect()}
    assert {i for i, _ in clean} <= set(kept) and 503 in kept and kept[503].endswith("write to [EMAIL]")
    assert not {500, 501, 502, 504, 505} & set(kept)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in final.collect()) == Counter(r.doc_id for r in at.collect())


def test_passages_in_the_middle_of_lines(make_docs):
    passage = prose(700, 57)
    rows = [(i, f"{prose(i, 43)} {passage.upper() if i % 2 else passage} {prose(i + 500, 40)}\n{prose(i + 900, 12)}") for i in range(1, 30)]
    got = {r.doc_id: r for r in line_dedup.remove_repeats(make_docs(rows).repartition(5)).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1]
    for i, text in rows[1:]:
        at = text.lower().index(passage)
        spans = got[i].removed
        assert at - 20 <= spans[0].start and spans[-1].end <= at + len(passage) + 20  # a word beside it may be equal by chance
        for span in spans:
            assert 1 <= span.kept_id < i
            assert rows[span.kept_id - 1][1][span.kept_start:].lower().startswith(text[span.start:span.end].lower())
        gone = text[spans[0].start:spans[-1].end]
        assert len(gone.split()) >= 27 and got[i].n_removed == len(spans)
        assert got[i].text.replace(" ", "") == (text[:spans[0].start] + text[spans[-1].end:]).replace(" ", "")


def test_every_passage_of_fifty_words_has_a_run():
    rule, rng = line_dedup.LineRule(), random.Random(3)
    for i in range(300):
        passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))
        one, two = ({u[0] for u in line_dedup.text_units(f"{prose(i + k, rng.randrange(40))} {passage} {prose(i + k + 5000, rng.randrange(40))}", rule, {})}
                    for k in (0, 10_000))
        assert one & two, i


def test_wrapped_passages_and_short_lines(make_docs):
    words = prose(701, 80).split()
    wrapped = lambda n: "\n".join(" ".join(words[i:i + n]) for i in range(0, 80, n))
    rows = [(i, f"{prose(i, 30)}\n{wrapped(5 + i)}\n{prose(i + 500, 30)}\nlone short line") for i in range(1, 12)]
    rows += [(100, wrapped(9)), (101, wrapped(9))]
    got = {r.doc_id: r for r in line_dedup.remove_repeats(make_docs(rows).repartition(5)).collect()}
    assert got[1].n_removed == 0
    for i, text in rows[1:11]:
        spans = got[i].removed
        assert sum(len(text[s.start:s.end].split()) for s in spans) >= 80 - 32
        assert got[i].text.startswith(prose(i, 30)) and got[i].text.endswith(prose(i + 500, 30) + "\nlone short line")
        assert "\n\n" not in got[i].text
    assert got[101].text == ""
