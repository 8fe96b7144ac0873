"""Conversation repair: cheapest edits towards alternating turns, found by Hirschberg's divide and conquer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import counted, staged

#: Rows of a conversation that are solved together, as a power of two.
CHUNK_BITS = 12
#: Costs of the edits; a row that is kept or given another role although truncated costs CUT more.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: States: nothing yet, after a system, a user, an assistant turn; by a state, the state after each role.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_STATES = range(4)
_ENDS = (0, 3)
_SPOKEN = {2: "user", 3: "assistant"}
_INITIALS = "?sua"
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3
_WHITE = " \t\n\v\f\r"


@cache
def _inserted(start: int) -> tuple[tuple[int, str], ...]:
    """(state, letters) after inserting no turn or a few; a state is never met twice."""
    out, state = [(start, "")], start
    while True:
        state = _NEXT[state].get("a", _NEXT[state].get("u"))
        if state in [s for s, _ in out]:
            return tuple(out)
        out.append((state, "I" * len(out)))


@cache
def edits(code: int) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """By state before and after: (cost, letters) of the cheapest, ASCII-least edits for a row of this code."""
    initial, fault = _INITIALS[code % 4], code // 4
    found: list[list] = [[None] * 4 for _ in _STATES]
    for start in _STATES:
        for state, ahead in _inserted(start):
            options = [(DELETE, "D", state)]
            if fault not in (_BLANK, _DUPLICATE):
                more = CUT if fault == _TRUNCATED else 0
                options += [(more, "K", _NEXT[state][initial])] if initial in _NEXT[state] else []
                options += [(more + REROLE, "R", s) for s in _NEXT[state].values() if s in _SPOKEN]
            for cost, letter, end in options:
                new = (cost + INSERT * len(ahead), ahead + letter)
                if found[start][end] is None or new < found[start][end]:
                    found[start][end] = new
    return tuple(tuple(row) for row in found)


@cache
def closing(state: int) -> tuple[int, str]:
    """(cost, letters) of the turns to insert at the end."""
    return next((INSERT * len(x), x) for s, x in _inserted(state) if s in _ENDS)


class Step:
    """What a row, or a stretch of rows, does to the states: costs, and the order of its letters by start."""

    def __init__(self, cost: list[list[int | None]], order: list[list[int]]):
        self.cost, self.order = cost, order


@cache
def row_step(code: int) -> Step:
    table = edits(code)
    letters = [[e[1] if e else "" for e in row] for row in table]
    order = [[sorted(set(row)).index(x) for x in row] for row in letters]
    return Step([[e[0] if e else None for e in row] for row in table], order)


def _advance(vector: tuple, step: Step) -> tuple:
    """By state (cost, rank among the states of the ASCII-least letters so far) after one more step.

    Letters so far all end with a row's own, so none is the beginning of another: ranks decide for good.
    """
    new: list = [None] * 4
    for start, at in enumerate(vector):
        if at is not None:
            for end, cost in enumerate(step.cost[start]):
                if cost is not None:
                    key = (at[0] + cost, at[1], step.order[start][end])
                    if new[end] is None or key < new[end]:
                        new[end] = key
    ranks = sorted({x[1:] for x in new if x})
    return tuple(x and (x[0], ranks.index(x[1:])) for x in new)


def _retreat(vector: tuple, step: Step) -> tuple:
    """By state the cost of the rest, before one more step."""
    out = []
    for row in step.cost:
        ways = [c + v for c, v in zip(row, vector, strict=True) if c is not None and v is not None]
        out.append(min(ways) if ways else None)
    return tuple(out)


@cache
def _known(forward: bool, vector: tuple, code: int) -> tuple[int, tuple]:
    """A row's step on a vector whose least cost is 0: (cost to add, vector like that); few ever occur."""
    if forward:
        out = _advance(vector, row_step(code))
        least = min(x[0] for x in out if x)
        return least, tuple(x and (x[0] - least, x[1]) for x in out)
    out = _retreat(vector, row_step(code))
    least = min(x for x in out if x is not None)
    return least, tuple(None if x is None else x - least for x in out)


def _swept(items, vector: tuple, forward: bool) -> tuple:
    """The vector after all items, up to one number added to all its costs."""
    for item in items if forward else reversed(items):
        if isinstance(item, Step):
            vector = _advance(vector, item) if forward else _retreat(vector, item)
        else:
            vector = _known(forward, vector, item)[1]
    return vector


def _start(state: int, forward: bool) -> tuple:
    return tuple(((0, 0) if forward else 0) if s == state else None for s in _STATES)


def crossings(items, entry: int, leave: int) -> list[tuple[int, int]]:
    """The states before and after each item on the ASCII-least of the cheapest ways from ``entry`` to ``leave``.

    Forward and backward vectors of four states meet in the middle; of the crossings of least cost the one
    with the least letters so far is taken, and both halves are solved alike. Items are row codes or :class:`Step`.
    """
    if len(items) < 2:
        return [(entry, leave)] * len(items)
    middle = len(items) // 2
    ahead = _swept(items[:middle], _start(entry, True), True)
    behind = _swept(items[middle:], _start(leave, False), False)
    ways = [(f[0] + b, f[1], s) for s, (f, b) in enumerate(zip(ahead, behind, strict=True)) if f and b is not None]
    state = min(ways)[2]
    return crossings(items[:middle], entry, state) + crossings(items[middle:], state, leave)


def summary(codes) -> Step:
    """A stretch of rows as one step."""
    cost, order = [], []
    for start in _STATES:
        vector, total = _start(start, True), 0
        for code in codes:
            least, vector = _known(True, vector, code)
            total += least
        cost.append([None if x is None else x[0] + total for x in vector])
        order.append([0 if x is None else x[1] for x in vector])
    return Step(cost, order)


def best_end(steps: list[Step]) -> tuple[int, int]:
    """(cost, state) where the ASCII-least of the cheapest repairs has dealt with all rows; closing turns are in the cost."""
    vector = _start(0, True)
    for step in steps:
        vector = _advance(vector, step)
    cost, _, state = min((x[0] + closing(s)[0], x[1], s) for s, x in enumerate(vector) if x)
    return cost, state


# -- on Spark ------------------------------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int = 2048) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that stand together with equal keys, as (keys, rows)."""
    key, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            for row in batch.slice(at, size).to_pylist():
                own = tuple(row[k] for k in keys)
                if rows and own != key:
                    yield key, rows
                    rows = []
                key = own
                rows.append(row)
    if rows:
        yield key, rows


def _packed(rows: Iterator[tuple], kinds: list, names: list[str], size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list = []

    def batch():
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


_ID = pa.string()  # conversations travel as text, so that any id type fits
_SUMMARY = ["conv", "chunk", "first", "last", "illegal", "cost", "order"]
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _bad(pair: tuple[int, int]) -> int:
    return (_INITIALS[pair[0] % 4], _INITIALS[pair[1] % 4]) not in _LEGAL


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (conv, chunk), group in _groups(batches, ["conv", "chunk"]):
            codes = [r["code"] for r in group]
            step = summary(codes)
            bad = sum(_bad(p) for p in zip(codes, codes[1:], strict=False))
            flat = [[x for row in part for x in row] for part in (step.cost, step.order)]
            yield conv, chunk, codes[0], codes[-1], bad, *flat

    whole = pa.list_(pa.int64())
    yield from _packed(rows(), [_ID, pa.int64(), pa.int32(), pa.int32(), pa.int64(), whole, whole], _SUMMARY)


_BORDER = ["conv", "chunk", "entry", "leave", "closes", "cost", "illegal"]


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at the borders of a conversation's chunks; its cost and illegal pairs with the last one."""

    def rows():
        for (conv,), group in _groups(batches, ["conv"]):
            square = lambda flat: [flat[i : i + 4] for i in range(0, 16, 4)]
            steps = [Step(square(r["cost"]), square(r["order"])) for r in group]
            cost, end = best_end(steps)
            bad = sum(r["illegal"] for r in group) + sum(
                _bad((a["last"], b["first"])) for a, b in zip(group, group[1:], strict=False)
            )
            for k, (r, (entry, leave)) in enumerate(zip(group, crossings(steps, 0, end), strict=True)):
                ends = k + 1 == len(group)
                yield conv, r["chunk"], entry, leave, ends, cost if ends else None, bad if ends else None

    kinds = [_ID, pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    yield from _packed(rows(), kinds, _BORDER)


_EDITS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string())]))


def row_edits(code: int, start: int, end: int, closes: bool) -> list[dict]:
    """A row's edits as (letter, role); the role of a kept or deleted row is its own (null)."""
    out, state = [], start
    for letter in edits(code)[start][end][1] + (closing(end)[1] if closes else ""):
        if letter == "I":
            state = _NEXT[state].get("a", _NEXT[state].get("u"))
        elif letter != "D":
            state = end
        out.append({"edit": letter, "role": _SPOKEN[state] if letter in "IR" else None})
    return out


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for _, group in _groups(batches, ["conv", "chunk"]):
            codes, first = [r["code"] for r in group], group[0]
            path = crossings(codes, first["entry"], first["leave"])
            for k, (r, (start, end)) in enumerate(zip(group, path, strict=True)):
                yield r["at"], row_edits(r["code"], start, end, first["closes"] and k + 1 == len(group))

    yield from _packed(rows(), [pa.int64(), _EDITS], ["at", "edits"])


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(_WHITE))


def _coded(turns: DataFrame) -> DataFrame:
    """``conv, turn, at, fault, code`` per row of ``turns``; of equal rows of a conversation all but the first are duplicates."""
    said = F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)
    keyed = staged(
        turns.select(
            "conv", "turn", "at", said.alias("said"), (F.length(_trimmed(F.col("text"))) == 0).alias("blank"),
            F.substring("role", 1, 1).alias("initial"), F.right(_trimmed(F.col("text")), F.lit(1)).isin(*".!?").alias("ended"),
        ),
        "said",
    )
    again = keyed.where(~F.col("blank")).groupBy("conv", "said").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    again = staged(again.where("n > 1").select("conv", "said", "first"), "said-again")
    firsts = counted(again.toDF("b_conv", "b_said", "first"), again.count())
    found = keyed.join(firsts, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("said") == F.col("b_said")), "left")
    fault = (
        F.when(F.col("blank"), _BLANK).when(F.col("at") > F.col("first"), _DUPLICATE)
        .when(~F.col("ended"), _TRUNCATED).otherwise(0)
    )
    place = F.array_position(F.array(*map(F.lit, "sua")), F.col("initial")).cast("int")
    coded = found.withColumn("fault", fault).withColumn("code", F.coalesce(place, F.lit(0)) + 4 * F.col("fault"))
    return coded.select("conv", "turn", "at", "fault", "code", F.shiftright("at", CHUNK_BITS).alias("chunk"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, conversations) of ``rows`` (``conv_id, turn, role, text``), conversations being in order of turn.

    Edits: ``conv_id, at, nth, edit, role, text``, one row per edit, in the order of ``at, nth``. K keeps a row, R gives
    it another role, D deletes it, I inserts an empty turn. What is not deleted has role initials ``(s?(ua)+)?``.
    Conversations: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost``.

    A row's fault is the first of: blank, duplicate (role and text of an earlier row of the conversation), truncated
    (its last character is not one of ``.!?``). Blank and duplicate rows must be deleted. Of the cheapest repairs the one with
    the ASCII-least letters is taken. Null role and text are one blank; a null ``conv_id`` is one conversation;
    null turns come first; rows of one turn go by role, then by the first 64 characters of the text, then by its hash. A
    role with another initial than s, u, a (also the empty role) cannot be kept. Other columns are ignored.

    Rows are range-sorted, so a conversation of any length lies in many tasks, and are solved in chunks of at most
    2**CHUNK_BITS rows: a chunk is first summed up as a step between the four states, the steps of a conversation give
    the states at the chunks' borders, then each chunk is solved alone. Only a step per chunk meets in one task.
    """
    kind = rows.schema["conv_id"].dataType
    space = F.lit(" ")
    named = rows.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    order = [F.col("conv"), F.col("turn"), F.col("role"), F.substring("text", 1, 64), F.md5(F.col("text"))]
    turns = staged(
        named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns"
    )
    coded = staged(_coded(turns), "codes")
    chunk = ["conv", "chunk"]
    by_chunk = coded.select(*chunk, "at", "code").repartition(*chunk).sortWithinPartitions(*chunk, "at")
    steps = by_chunk.select(*chunk, "code").mapInArrow(
        _summaries, "conv string, chunk long, first int, last int, illegal long, cost array<long>, order array<long>"
    )
    steps = staged(steps, "steps")
    borders = staged(
        steps.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(
            _borders, "conv string, chunk long, entry int, leave int, closes boolean, cost long, illegal long"
        ),
        "borders",
    )
    entered = coded.select(*chunk, "at", "code").join(
        borders.select(F.col("conv").alias("b_conv"), F.col("chunk").alias("b_chunk"), "entry", "leave", "closes"),
        F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("chunk") == F.col("b_chunk")),
    )
    solved = (
        entered.select(*chunk, "at", "code", "entry", "leave", "closes")
        .repartition(*chunk)
        .sortWithinPartitions(*chunk, "at")
        .mapInArrow(_solved, "at long, edits array<struct<edit:string,role:string>>")
    )
    inserts = F.col("e.edit") == "I"
    edited = turns.join(solved, "at").select("conv", "at", F.posexplode("edits").alias("nth", "e"), "role", "text")
    edited = edited.select(
        F.col("conv").cast(kind).alias("conv_id"), "at", "nth", F.col("e.edit").alias("edit"),
        F.coalesce("e.role", "role").alias("role"), F.when(inserts, "").otherwise(F.col("text")).alias("text"),
    )
    faults = [F.count_if(F.col("fault") == k).alias(n) for k, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))]
    turned = coded.groupBy("conv", "turn").agg(*faults).groupBy("conv").agg(
        (F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.count("turn")).alias("gaps"),
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")],
    )
    totals = borders.where("closes").select(F.col("conv").alias("b_conv"), "illegal", "cost")
    conversations = turned.join(totals, F.col("conv").eqNullSafe(F.col("b_conv"))).select(
        F.col("conv").cast(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost"
    )
    return edited, conversations


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows stream through in order; a conversation's letters and hash state are all that is held."""

    def rows():
        conv, live = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if live is None or r["conv_id"] != conv:
                    if live:
                        yield conv, "".join(live[0]), live[1].hexdigest()
                    conv, live = r["conv_id"], [[], hashlib.sha256(), ""]
                live[0].append(r["edit"])
                if r["edit"] != "D":
                    live[1].update(f"{live[2]}{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
                    live[2] = "\n"
        if live:
            yield conv, "".join(live[0]), live[1].hexdigest()

    yield from _packed(rows(), [_ID, pa.string(), pa.string()], ["conv_id", "audit", "repaired_sha256"])


def digests(edited: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256`` from the edits of :func:`repair`.

    A hash over a whole conversation is one stream, so here, other than in the repair, a conversation is one task's.
    """
    kind = edited.schema["conv_id"].dataType
    found = (
        edited.select(F.col("conv_id").cast("string").alias("conv_id"), "at", "nth", "edit", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "at", "nth")
        .select("conv_id", "edit", "role", "text")
        .mapInArrow(_digest, "conv_id string, audit string, repaired_sha256 string")
    )
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage by the crc32 of ``conv_id:turn`` mod 20; nulls count as one blank.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    hit = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("hit"),
    ).where("hit != 0")
    return hit.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
