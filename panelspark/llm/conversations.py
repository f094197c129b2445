"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation may open with a system turn and then alternates user and
assistant, ending with assistant; or it is empty. Keep costs 0, Rerole 3, Insert
3 (an empty turn, anywhere), Delete 4; blank and repeated turns must be deleted,
and a truncated turn that stays adds 3. Of the cheapest edits those are taken
whose initials, in order, are least in ASCII.

The dynamic program has four states (start, after system, after user, after
assistant). Backward cost vectors are kept at checkpoints only, about the square
root of the longest conversation apart; walking forward, the vectors of one
stretch at a time are computed anew. Stretches are rows of a Spark table: each
yields the matrix of its costs from state to state, the matrices of a
conversation chain into the vectors at its checkpoints, and with these every
stretch is walked by itself. No task ever holds a whole long conversation: turns
are dealt by range of (conversation, turn), a conversation of any share of the
rows is spread over many tasks, and what those exchange is one row per stretch,
or per task and distinct turn. Only the digest of a conversation, one hash over
its text, reads its turns in a single task, as a stream.

Nulls in the id, turn, role or text count as one space in damage and repair; the
null id is a conversation of its own. Turns are taken by number, nulls first;
ties by role, then by the hash of the text, so equal rows stand together. Texts
and conversations may have any length. A conversation without rows, an empty
table: no edits, no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import small, written

RULES = {"delete": 4, "rerole": 3, "insert": 3, "truncated": 3}
#: Least rows of a stretch.
STRETCH_LEAST = 64

START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 60
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Costs to finish from each state once all rows are read.
FINISHED = (0, 2 * RULES["insert"], RULES["insert"], 0)


def _step(code: str, state: int) -> tuple[int | None, int | None, int]:
    """Next state by keeping a row, by changing its role, and what staying costs in itself."""
    if code == "x":
        return None, None, 0
    return _KEEP.get((state, code.lower())), _NEXT[state], RULES["truncated"] * code.isupper()


_MOVES = {c: [_step(c, s) for s in range(4)] for c in "xsuaoSUAO"}


def before(code: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to finish in front of a row, from the costs behind it."""
    out = []
    for state, (kept, changed, extra) in enumerate(_MOVES[code]):
        best = RULES["delete"] + after[state]
        if kept is not None:
            best = min(best, extra + after[kept])
        if changed is not None:
            best = min(best, RULES["rerole"] + extra + after[changed])
        out.append(best)
    a, b, c, d = out
    put = RULES["insert"]
    c, d = min(c, put + d), min(d, put + c)
    return min(a, put + c), min(b, put + c), c, d


def stretch_matrix(codes: str) -> list[int]:
    """Least costs of a stretch from each state (rows) to each state (columns), row by row."""
    columns = []
    for end in range(4):
        v = tuple(0 if s == end else _FAR for s in range(4))
        for code in reversed(codes):
            v = before(code, v)
        columns.append(v)
    return [columns[e][s] for s in range(4) for e in range(4)]


def walk(codes: str, after: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """Initials of the least cheapest edits of a stretch that is entered in `state`, and the state it is left in."""
    vectors = [tuple(after)]
    for code in reversed(codes):
        vectors.append(before(code, vectors[-1]))
    vectors.reverse()
    edits, i = [], 0
    while i < len(codes) or (last and vectors[i][state] > 0):
        cost = vectors[i][state]
        if i < len(codes):
            if cost == RULES["delete"] + vectors[i + 1][state]:
                edits.append("D")
                i += 1
                continue
            kept, changed, extra = _MOVES[codes[i]][state]
        if i == len(codes) or cost == RULES["insert"] + vectors[i][_NEXT[state]]:
            edits.append("I")
            state = _NEXT[state]
        elif kept is not None and cost == extra + vectors[i + 1][kept]:
            edits.append("K")
            state, i = kept, i + 1
        else:
            edits.append("R")
            state, i = changed, i + 1
    return "".join(edits), state


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with the faults that the CRC of `conv_id:turn` plants; nulls are one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])) % 20
    text = F.coalesce("text", space)
    changed = (F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text))
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"), changed.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Rows with the hash of the text and whether it is blank or truncated."""
    shown = F.expr(r"rtrim('\t\n\u000B\f\r ', text)")
    return rows.withColumns({"_hash": F.unhex(F.sha2("text", 256)), "blank": shown == "",
                             "cut": ~F.substring(shown, -1, 1).isin(".", "!", "?")})


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("_hash")]


def _mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one task: its number, each row's place in it, and whether the turn stood in it before."""
    from pyspark import TaskContext

    part, at, conv, seen = TaskContext.get().partitionId(), 0, None, None
    for batch in parts:
        n = batch.num_rows
        again = np.zeros(n, bool)
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "_hash")))):
            if seen is None or row[0] != conv:
                conv, seen = row[0], set()
            again[i] = row[1:] in seen
            seen.add(row[1:])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n), pa.int64()), pa.array(again)],
            names=[*batch.schema.names, "part", "at", "again"])
        at += n


def ordered_faults(rows: DataFrame) -> DataFrame:
    """All rows in order without their texts: conv_id, turn, role, part, at and one of blank, again, cut.

    A task knows the turns of its own range. Conversations that more than one
    task holds are compared once more by each task's first rows of a turn, of
    which there is at most one per task and turn.
    """
    coded = _faults(rows).drop("text").withColumn("_any", F.monotonically_increasing_id())
    ranged = coded.repartitionByRange(*_order(), F.col("_any")).sortWithinPartitions(*_order()).drop("_any")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", part int, at long, again boolean"
    marked = written(ranged.mapInArrow(_mark, schema), "turns")
    shared = marked.groupBy("conv_id").agg(F.min("part").alias("_p"), F.max("part").alias("_q")).where("_p < _q")
    shared = small(written(shared.select(F.col("conv_id").alias("_c")), "shared-conversations"))
    firsts = marked.where("not again").join(shared, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    later = firsts.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id", "role", "_hash").orderBy("part")))
    later = later.where("_k > 1").select("part", "at", F.lit(True).alias("_later"))
    all_rows = marked.join(later, ["part", "at"], "left")
    again = ~F.col("blank") & (F.col("again") | F.coalesce("_later", F.lit(False)))
    return all_rows.select("conv_id", "turn", "role", "part", "at", "blank", again.alias("again"),
                           (F.col("cut") & ~F.col("blank") & ~again).alias("cut"))


def _code() -> Column:
    first = F.substring("role", 1, 1)
    letter = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return F.when(F.col("blank") | F.col("again"), "x").when(F.col("cut"), F.upper(letter)).otherwise(letter)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _matrix(codes: pd.Series) -> pd.Series:
    return codes.map(stretch_matrix)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _exits(codes: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[walk(c, tuple(v), s, False)[1] for s in range(4)] for c, v in zip(codes, after)])


@F.pandas_udf(T.StringType())
def _edits(codes: pd.Series, after: pd.Series, state: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([walk(c, tuple(v), s, bool(e))[0] for c, v, s, e in zip(codes, after, state, last)], dtype=object)


def _chain_back(rows: pd.DataFrame) -> pd.DataFrame:
    """The cost vector behind each stretch of one conversation."""
    rows, v, out = rows.sort_values("seq"), np.array(FINISHED), []
    for m in rows["matrix"].iloc[::-1]:
        out.append(v.tolist())
        v = (np.array(m).reshape(4, 4) + v).min(axis=1)
    return pd.DataFrame({"_conv": rows["conv_id"], "_seq": rows["seq"], "after": out[::-1]})


def _chain_on(rows: pd.DataFrame) -> pd.DataFrame:
    """The state in which each stretch of one conversation is entered."""
    rows, state, out = rows.sort_values("seq"), START, []
    for exits in rows["exits"]:
        out.append(state)
        state = exits[state]
    return pd.DataFrame({"_conv": rows["conv_id"], "_seq": rows["seq"], "state": out})


def cheapest_edits(turns: DataFrame) -> DataFrame:
    """conv_id, seq and the initials of the edits of each stretch, from the rows of `ordered_faults`."""
    longest = turns.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    length = max(STRETCH_LEAST, int(np.ceil(np.sqrt(longest))))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", _code().alias("c")))), lambda x: x["c"]), "")
    cut = turns.groupBy("conv_id", "part", F.floor(F.col("at") / length).alias("stretch")).agg(codes.alias("codes"))
    of = Window.partitionBy("conv_id")
    cut = written(cut.withColumns({"seq": F.row_number().over(of.orderBy("part", "stretch")),
                                   "of": F.count(F.lit(1)).over(of)}), "stretches")
    alone, many = cut.where("of = 1"), cut.where("of > 1")
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def chained(rows: DataFrame, value: Column, name: str, step, added: str) -> DataFrame:
        """`rows` with what `step` finds along each conversation; one group has a row per stretch."""
        found = rows.select("conv_id", "seq", value.alias(name)).groupBy("conv_id").applyInPandas(
            step, f"_conv {id_type}, _seq int, {added}")
        same = rows["conv_id"].eqNullSafe(found["_conv"]) & (rows["seq"] == found["_seq"])
        return rows.join(found, same).drop("_conv", "_seq")

    ended = written(chained(many, _matrix("codes"), "matrix", _chain_back, "after array<long>"), "checkpoints")
    entered = chained(ended, _exits("codes", "after"), "exits", _chain_on, "state int")
    single = alone.withColumns({"after": F.array(*[F.lit(c).cast("long") for c in FINISHED]), "state": F.lit(START)})
    both = single.unionByName(entered)
    return both.select("conv_id", "seq", _edits("codes", "after", "state", F.col("seq") == F.col("of")).alias("edits"))


class _Reader:
    """Follows the rows of one conversation, its edits first and then its turns in order."""

    def __init__(self, conv):
        self.conv, self.edits, self.i, self.state = conv, [], 0, START
        self.initial, self.illegal, self.cost, self.rows, self.kept = None, 0, 0, 0, 0

    def audit(self) -> str:
        if isinstance(self.edits, list):
            self.edits = "".join(self.edits)
        return self.edits

    def _put(self) -> str:
        self.state, self.i, self.cost = _NEXT[self.state], self.i + 1, self.cost + RULES["insert"]
        return "assistant" if self.state == ASSISTANT else "user"

    def turn(self, role: str, cut: bool) -> tuple[list[str], str | None]:
        """Roles inserted in front of a turn, and its own role, None if the turn goes."""
        edits, put = self.audit(), []
        while edits[self.i] == "I":
            put.append(self._put())
        initial = role[:1]
        self.illegal += self.rows > 0 and self.initial + initial not in ("su", "ua", "au")
        self.initial, self.rows = initial, self.rows + 1
        edit, self.i = edits[self.i], self.i + 1
        if edit == "D":
            self.cost += RULES["delete"]
            return put, None
        self.cost += RULES["truncated"] * cut
        if edit == "K":
            self.state = _KEEP[self.state, initial]
        else:
            self.state, self.cost = _NEXT[self.state], self.cost + RULES["rerole"]
            role = "assistant" if self.state == ASSISTANT else "user"
        return put, role

    def tail(self) -> list[str]:
        edits, put = self.audit(), []
        while self.i < len(edits):
            put.append(self._put())
        return put


def _followed(batches: Iterator[pa.RecordBatch], rows_at_once: int = 256):
    """(reader, lines) for every turn and for the end of every conversation; lines are (role, text)."""
    now = None
    for batch in batches:
        for start in range(0, batch.num_rows, rows_at_once):
            part = batch.slice(start, rows_at_once)
            for conv, kind, role, cut, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "kind", "role", "cut", "text"))):
                if now is None or now.conv != conv:
                    if now is not None:
                        yield now, [(r, "") for r in now.tail()], True
                    now = _Reader(conv)
                if kind == 0:
                    now.edits.append(text)
                    continue
                put, kept = now.turn(role, cut)
                yield now, [(r, "") for r in put] + ([] if kept is None else [(kept, text)]), False
    if now is not None:
        yield now, [(r, "") for r in now.tail()], True


def _streamed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits and turns of each conversation one behind the other, conversations dealt by id."""
    # blank turns always go: their texts stay behind
    turns = _faults(rows).select(
        "conv_id", F.lit(1).alias("kind"), F.lit(0).alias("seq"), "turn", "role", "_hash", (F.col("cut") & ~F.col("blank")).alias("cut"),
        F.when(~F.col("blank"), F.col("text")).alias("text"))
    first = edits.select("conv_id", F.lit(0).alias("kind"), "seq", F.lit(None).alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("binary").alias("_hash"), F.lit(False).alias("cut"), F.col("edits").alias("text"))
    both = first.withColumn("turn", F.col("turn").cast(rows.schema["turn"].dataType)).unionByName(turns)
    dealt = both.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "kind", "seq", F.col("turn").asc_nulls_first(), "role", "_hash")
    return dealt.select("conv_id", "kind", "role", "cut", "text")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role and text of every turn after the repair."""
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for reader, lines, _ in _followed(batches):
            for role, text in lines:
                out.append((reader.conv, reader.kept, role, text))
                reader.kept, held = reader.kept + 1, held + len(text)
            if len(out) >= 2000 or held > 4_000_000:
                yield _batch(out, names)
                out, held = [], 0
        if out:
            yield _batch(out, names)

    names = ["conv_id", "position", "role", "text"]
    edits = cheapest_edits(ordered_faults(rows))
    return _streamed(rows, edits).mapInArrow(emit, f"conv_id {id_type}, position long, role string, text string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def conversation_report(rows: DataFrame) -> DataFrame:
    """Per conversation with rows: gaps, faults, illegal neighbours, cost, audit and the digest of the repaired turns."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    faults = written(ordered_faults(rows), "turn-faults")
    edits = written(cheapest_edits(faults), "turn-edits")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sha = [], hashlib.sha256()
        for reader, lines, end in _followed(batches):
            for role, text in lines:
                sha.update(("\n" * (reader.kept > 0) + f"{role}:{text}").encode())
                reader.kept += 1
            if end:
                out.append((reader.conv, reader.illegal, reader.cost, reader.audit(), sha.hexdigest()))
                sha = hashlib.sha256()
                if len(out) == 2000:
                    yield _batch(out, names)
                    out = []
        if out:
            yield _batch(out, names)

    names = ["_conv", "illegal", "cost", "audit", "repaired_sha256"]
    read = _streamed(rows, edits).mapInArrow(digest, f"_conv {id_type}, illegal long, cost long, audit string, repaired_sha256 string")
    by_turn = faults.groupBy("conv_id", "turn").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "again", "cut")])
    facts = by_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("again").alias("duplicate"), F.sum("cut").alias("truncated"))
    return facts.join(read, facts["conv_id"].eqNullSafe(read["_conv"])).drop("_conv")


def repair_digests(original: DataFrame) -> DataFrame:
    """Every conversation of `original`, damaged and repaired; one without rows after the damage has zeros and no edits."""
    found = conversation_report(damage(original))
    every = original.select(F.col("conv_id").alias("_every")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, every["_every"].eqNullSafe(found["conv_id"]), "left").select(
        F.col("_every").alias("conv_id"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
