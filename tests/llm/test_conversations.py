"""Conversation repair against a brute-force search over edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from panelspark.llm import conversations
from panelspark.llm.common import written

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def brute_edits(rows):
    """(cost, audit, turns) by best-first search: the least cost, then the least initials."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        to = NEXT[state]
        heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*out, (FULL[to], ""))))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        extra = 3 * (fault == "truncated")
        if role[:1] == to or (state == "" and role[:1] == "s"):
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*out, (role, text))))
        heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, to, (*out, (FULL[to], text))))
    raise AssertionError


def brute_report(rows):
    """The report of one conversation from (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faulty = set(), []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = ("blank" if not words else "duplicate" if (role, text) in seen else
                 "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
        faulty.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, out = brute_edits(faulty)
    count = lambda f: sum(x[2] == f for x in faulty)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def brute(rows):
    kept = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: (c, *brute_report(r)) for c, r in kept.items()}


def odd_conversations(seed, n):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "Yes.", "No!", "cut off", " ", "", None, "Why?\n", "A b. ", "é😀?", "x" * 5000, "end .\x0b"]
    for conv in [None, *range(n)]:
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(
                ["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_equal_brute_force(spark, seed):
    rows = odd_conversations(seed, 150)
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, part int").repartition(5)
    got = {r.conv_id: tuple(r) for r in conversations.repair_digests(data).collect()}
    assert got == brute(rows)


def test_a_long_conversation_is_cut_into_stretches(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{rng.randrange(400)}{rng.choice(['.', '', '!'])}") for t in range(6000)]
    rows += [(7, 3, "user", "Again.")] * 300 + [(c, 0, "user", "Hi.") for c in range(8, 20)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        got = {r.conv_id: tuple(r) for r in conversations.repair_digests(spark.createDataFrame(rows, SCHEMA)).collect()}
        faults = written(conversations.ordered_faults(conversations.damage(spark.createDataFrame(rows, SCHEMA))), "faults")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)
    assert faults.where("conv_id = 7").select("part").distinct().count() > 1
    longest = conversations.cheapest_edits(faults).where("conv_id = 7").selectExpr("max(length(edits)) m", "count(*) n").first()
    assert longest.m < 4 * 90 and longest.n >= 60


def test_stretches_chain_to_the_whole():
    rng = random.Random(9)
    for _ in range(200):
        codes = "".join(rng.choices("xsuaoSUAO", k=rng.randrange(1, 30)))
        whole, _ = conversations.walk(codes, conversations.FINISHED, conversations.START, True)
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes) + 1) for _ in range(3))})
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        after = [conversations.FINISHED]
        for p in reversed(parts[1:]):
            m = conversations.stretch_matrix(p)
            after.append(tuple(min(m[4 * s + e] + after[-1][e] for e in range(4)) for s in range(4)))
        state, out = conversations.START, []
        for i, (p, v) in enumerate(zip(parts, reversed(after))):
            edits, state = conversations.walk(p, v, state, i == len(parts) - 1)
            out.append(edits)
        assert "".join(out) == whole


def test_repaired_turns_alternate(spark):
    rows = odd_conversations(3, 40)
    data = conversations.damage(spark.createDataFrame(rows, SCHEMA))
    turns = defaultdict(list)
    for r in conversations.repaired_turns(data).collect():
        turns[r.conv_id].append((r.position, r.role))
    for found in turns.values():
        assert [p for p, _ in sorted(found)] == list(range(len(found)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r in sorted(found)))
    digests = {r.conv_id: r.repaired_sha256 for r in conversations.conversation_report(data).collect()}
    assert set(turns) <= set(digests)


def test_empty_table(spark):
    assert conversations.repair_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversations.repaired_turns(spark.createDataFrame([], SCHEMA)).count() == 0
