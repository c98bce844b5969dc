"""Conversation structure repair: the cheapest edits that give every conversation the roles `(s?(ua)+)?`.

A row is kept (0), gets the role user or assistant (1) or is deleted (2, forced for blank and duplicate rows); empty user and
assistant turns may be put in anywhere (5), and a truncated row that stays adds 5. Which role can come next depends only on the
last one, so a dynamic program over four states (start, after system, after user, after assistant) finds the least cost. Of all
cheapest lists of edits the ASCII-least is taken (D < I < K < R): walking forward, the first tight edit in that order.

Both directions are passes over sorted streams. The backward pass reads one code a row and stores a state-cost vector only at
checkpoints, every `max(least, ceil(sqrt(rows)))` rows of a conversation, with the codes up to the next one. The forward pass gets
the checkpoints in front of the rows, recomputes one block of vectors at a time and emits the edited rows. So a task holds one
block, not a conversation. A conversation is one stream in both passes, since its edits and its digest are chained: tasks grow
in time with the longest conversation, but not in memory.

Defined cases: null roles and texts are one blank; a null conversation id is a conversation; null turns come first, and rows of
the same turn go by role and text; repeated rows are duplicates, all but the first; a conversation without rows gives one row
without an edit; an empty table gives none. Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marketloom.llm.common import store

DELETE, RETITLE, INSERT, TRUNCATED = 2, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the turn that may be written next (user after anything but user).
_WRITTEN = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Cost to end from each state: the turns still to be put in.
_END = (0, 2 * INSERT, INSERT, 0)
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NO_FAULT, BLANK, DUPLICATE, CUT = range(4)
FAULTS = ("none", "blank", "duplicate", "truncated")


def _next(state: int, code: int) -> int | None:
    """The state after keeping a row, none if its role may not come now. A code is 4 x role (0 for others) + fault."""
    said = code >> 2
    if said == SYSTEM:
        return SYSTEM if state == START else None
    return said if said and said == _WRITTEN[state] else None


def _before(after: tuple[int, ...], code: int) -> tuple[int, ...]:
    """State costs in front of a row from those behind it."""
    fault = code & 3
    stays = TRUNCATED if fault == CUT else 0
    out = []
    for s in range(4):
        best = DELETE + after[s]
        if fault in (NO_FAULT, CUT):
            kept = _next(s, code)
            if kept is not None:
                best = min(best, stays + after[kept])
            best = min(best, RETITLE + stays + after[_WRITTEN[s]])
        out.append(best)
    return _with_inserts(out)


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Lowered by turns put in at this place: no state needs more than three, since two more lead back to it."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_WRITTEN[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


class Costs:
    """Vectors row by row, remembered up to a constant: few differences between states ever occur."""

    def __init__(self) -> None:
        self._known: dict[tuple[tuple[int, ...], int], tuple[int, ...]] = {}

    def before(self, after: tuple[int, ...], code: int) -> tuple[int, ...]:
        low = min(after)
        key = (tuple(x - low for x in after), code)
        got = self._known.get(key)
        if got is None:
            got = self._known[key] = _before(key[0], code)
        return tuple(x + low for x in got)


def walk(codes: bytes, after: tuple[int, ...], state: int, costs: Costs, last: bool) -> Iterator[tuple[str, int, int, int | None]]:
    """(edit, state after it, cost left before it, code of the row or none) for a block of rows that starts in `state` and has the
    costs `after` behind it; the last block also puts in the turns that end the conversation."""
    vectors = [after]
    for c in reversed(codes):
        vectors.append(costs.before(vectors[-1], c))
    vectors.reverse()
    for i, c in enumerate(codes):
        while True:
            left, behind, fault = vectors[i][state], vectors[i + 1], c & 3
            stays = TRUNCATED if fault == CUT else 0
            free = fault in (NO_FAULT, CUT)
            kept = _next(state, c) if free else None
            written = _WRITTEN[state]
            if left == DELETE + behind[state]:
                yield "D", state, left, c
            elif left == INSERT + vectors[i][written]:
                yield "I", written, left, None
                state = written
                continue
            elif kept is not None and left == stays + behind[kept]:
                yield "K", kept, left, c
                state = kept
            else:
                yield "R", written, left, c
                state = written
            break
    while last and _END[state]:
        yield "I", _WRITTEN[state], _END[state], None
        state = _WRITTEN[state]


_PLACE = ["group", "placed", "at", "role", "hash"]
_BLOCKS = pa.schema(
    [
        ("group", pa.string()),
        ("placed", pa.int32()),
        ("at", pa.int64()),
        ("role", pa.string()),
        ("hash", pa.binary()),
        ("block", pa.int64()),
        ("codes", pa.binary()),
        ("after", pa.list_(pa.int64())),
        ("last", pa.bool_()),
    ]
)
_BLOCKS_DDL = "group string, placed int, at long, role string, hash binary, block long, codes binary, after array<long>, last boolean"
_FLUSH_ROWS, _FLUSH_BYTES = 4096, 1 << 22


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


class _Out:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int) -> bool:
        self.rows.append(row)
        self.bytes += size
        return len(self.rows) >= _FLUSH_ROWS or self.bytes >= _FLUSH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.bytes = [], 0
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def _backward(least: int):
    """Checkpoints from rows in descending order: the codes of a block, the costs behind it and the place of its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, out, key = Costs(), _Out(_BLOCKS), None
        for group, placed, at, role, hash_, copies, first, again, n in _rows(batches, [*_PLACE, "copies", "first", "again", "n"]):
            if group != key:
                key, left, vector, after, codes = group, n, _END, _END, bytearray()
                block = max(least, math.isqrt(n - 1) + 1)
            for copy in range(copies):
                c = first if copy == copies - 1 else again
                left -= 1
                codes.append(c)
                vector = costs.before(vector, c)
                if left % block == 0:
                    row = (group, placed, at, role, hash_, left // block, bytes(reversed(codes)), after, left + len(codes) == n)
                    if out.add(row, len(codes)):
                        yield out.batch()
                    after, codes = vector, bytearray()
        yield out.batch()

    return run


#: Kinds of the stream, in their order at one place.
_CONVERSATION, _BLOCK, _ROW = range(3)
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _forward(schema: pa.Schema):
    """Edited rows from a stream of checkpoints and rows in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, out = Costs(), _Out(schema)
        key, conv, blocks, steps, state, before, rows = None, None, deque(), iter(()), START, None, 0

        def step() -> tuple[str, int, int, int | None] | None:
            """The next edit with the code of its row, going on to the next block where one is used up."""
            nonlocal steps
            while True:
                for found in steps:
                    return found
                if not blocks:
                    return None
                codes, after, last = blocks.popleft()
                steps = walk(codes, tuple(after), state, costs, last)

        def inserted(found: tuple) -> tuple:
            return conv, "I", _NAMES[found[1]], "", None, None, False, found[2]

        def ended() -> Iterator[tuple]:
            if key is not None and not rows:
                yield conv, None, None, None, None, None, False, 0
            found = step()
            while found:
                yield inserted(found)
                found = step()

        names = ["group", "kind", "conv_id", "turn", "role", "text", "codes", "after", "last"]
        for group, kind, conv_id, turn, role, text, codes, after, last in _rows(batches, names):
            if group != key:
                for r in ended():
                    if out.add(r, 0):
                        yield out.batch()
                key, conv, steps, state, before, rows = group, conv_id, iter(()), START, None, 0
                blocks.clear()
            if kind == _BLOCK:
                blocks.append((codes, after, last))
            elif kind == _ROW:
                rows += 1
                found = step()
                while found[0] == "I":
                    state = found[1]
                    if out.add(inserted(found), 0):
                        yield out.batch()
                    found = step()
                edit, state, left, c = found
                illegal = before is not None and (before, c >> 2) not in _LEGAL
                before = c >> 2
                if out.add((conv, edit, _NAMES[state] if edit == "R" else role, text, turn, FAULTS[c & 3], illegal, left), len(text)):
                    yield out.batch()
        for r in ended():
            out.add(r, 0)
        yield out.batch()

    return run


def _faults(role: Column, text: Column) -> tuple[Column, Column]:
    """Code with the row's own fault, and with that of a repetition."""
    initial = F.substring(role, 1, 1)
    said = F.lit(START)
    for name, state in _INITIALS.items():
        said = F.when(initial == name, state).otherwise(said)
    last = F.regexp_extract(text, "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    blank = last == ""
    own = F.when(blank, BLANK).when(F.instr(F.lit(".!?"), last) > 0, NO_FAULT).otherwise(CUT)
    return (said * 4 + own).cast("int"), (said * 4 + F.when(blank, BLANK).otherwise(DUPLICATE)).cast("int")


def _place(conversations: DataFrame) -> DataFrame:
    """The rows with the columns that order them: group (the id as a key that tells null apart), placed, at, role, hash."""
    conv, turn, role, text = (F.col(f"`{n}`") for n in ("conv_id", "turn", "role", "text"))
    text, turn = F.coalesce(text, F.lit(" ")), turn.cast("long")
    return conversations.select(
        F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("group"),
        turn.isNotNull().cast("int").alias("placed"),
        F.coalesce(turn, F.lit(0)).alias("at"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.unhex(F.md5(text)).alias("hash"),
        conv.alias("conv_id"),
        turn.alias("turn"),
        text.alias("text"),
    )


def repair(conversations: DataFrame, ids: DataFrame | None = None, least: int = 64) -> DataFrame:
    """The edited rows of all conversations: conv_id, edit (K kept, R given another role, D deleted, I put in), role and text (as
    they are after the edit; those of a deleted row as they were), turn (null where put in), fault (none, blank, duplicate,
    truncated), illegal (its role may not follow that of the row before), cost (of this and all later edits).

    `ids` (conv_id) names conversations that may have no rows; such a one gives one row without an edit. The rows of a conversation
    are neighbours in one partition, in order, as `summaries` needs them. Blocks have the square root of a conversation's rows,
    `least` at least.
    """
    rows = _place(conversations)
    own, repeated = _faults(F.col("role"), F.col("text"))
    light = store(rows.groupBy(*_PLACE, own.alias("own"), repeated.alias("again")).agg(F.count("*").alias("copies")), "repair-rows")
    same = light.groupBy("group", "role", "hash").agg(F.min(F.struct("placed", "at")).alias("earliest"))
    sizes = light.groupBy("group").agg(F.sum("copies").alias("n"))
    first = F.when(F.struct("placed", "at") == F.col("earliest"), F.col("own")).otherwise(F.col("again"))
    coded = light.join(same, ["group", "role", "hash"]).join(sizes, "group").select(*_PLACE, "copies", first.alias("first"), "again", "n")
    down = coded.repartition("group").sortWithinPartitions(*[F.col(x).desc() for x in _PLACE])
    blocks = store(down.mapInArrow(_backward(least), _BLOCKS_DDL), "repair-blocks")

    id_type = conversations.schema["conv_id"].dataType
    heads = rows.select("group", "conv_id")
    if ids is not None:
        key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
        heads = heads.unionByName(ids.select(key.alias("group"), F.col("conv_id").cast(id_type).alias("conv_id")))
    heads = heads.distinct().withColumn("placed", F.lit(-1))
    stream = rows.withColumn("kind", F.lit(_ROW))
    for part, kind in ((heads, _CONVERSATION), (blocks, _BLOCK)):
        stream = stream.unionByName(part.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    # A head stands before all rows of its conversation, a checkpoint before the first row of its block.
    stream = stream.repartition("group").sortWithinPartitions("group", "placed", "at", "role", "hash", "kind", "block")
    ddl = f"conv_id {id_type.simpleString()}, edit string, role string, text string, turn long, fault string, illegal boolean, cost long"
    return stream.mapInArrow(_forward(to_arrow_schema(StructType.fromDDL(ddl))), ddl)


def _summarise(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, open_ = _Out(schema), None, False

        def closed() -> tuple:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            return conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, "".join(audit), digest.hexdigest()

        for conv_id, edit, role, text, turn, fault, bad, left in _rows(batches, ["conv_id", "edit", "role", "text", "turn", "fault", "illegal", "cost"]):
            if not open_ or conv_id != conv:
                if open_ and out.add(closed(), len(audit)):
                    yield out.batch()
                conv, open_, counts, illegal, cost, audit, digest, kept = conv_id, True, Counter(), 0, left, [], hashlib.sha256(), False
                turns = [0, 0, 0]  # least, greatest, distinct
            counts[fault] += 1
            illegal += bad
            if edit is not None:
                audit.append(edit)
                if edit != "D":
                    digest.update(("\n" * kept + f"{role}:{text}").encode())
                    kept = True
            if turn is not None and (not turns[2] or turn != turns[1]):
                turns = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
        if open_:
            out.add(closed(), 0)
        yield out.batch()

    return run


def summaries(edited: DataFrame) -> DataFrame:
    """One row per conversation from the rows of `repair`, taken as they lie (no shuffle or sort may come between): conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit (the edits' letters), repaired_sha256 (of `role:text` lines). The digest and
    the audit are built row by row; the audit has a letter per edit."""
    id_type = edited.schema["conv_id"].dataType.simpleString()
    numbers = ", ".join(f"{n} long" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    ddl = f"conv_id {id_type}, {numbers}, audit string, repaired_sha256 string"
    return edited.mapInArrow(_summarise(to_arrow_schema(StructType.fromDDL(ddl))), ddl)
