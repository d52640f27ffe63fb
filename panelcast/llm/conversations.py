"""Damaged conversations brought back to alternating turns at the least cost."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.text import SPACES, without
from panelcast.sources.scratch import Scratch

# Rows of a conversation whose repairs are searched together.
BLOCK_BITS = 6
# Blocks whose repairs a worker remembers; this bounds memory, not results.
REMEMBERED = 10_000
# What an edit costs, and what a truncated row costs that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
CLASSES = "sua"
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
# What precedes a row: nothing, only a system row, a user row, an assistant row.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
FOLLOWING = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLES = {AFTER_U: "user", AFTER_A: "assistant"}
CLOSING = ("", "II", "I", "")
LEGAL_PAIRS = {"su", "ua", "au"}
PREFIX = 64
ROWS_AT_ONCE = 256


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults by the checksum of ``conv_id:turn``.

    Null roles and texts become one space, as do null parts of the checksum's key; ``conv_id`` and
    ``turn`` themselves stay null.
    """

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    text = F.when(kind == 1, F.lit("")).when(kind == 2, without(spaced("text"), ".!?"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(spaced("role")).alias("role"),
        text.otherwise(spaced("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def in_order(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with ``pos``, which rises within each conversation.

    The order is ``turn`` (nulls first), then role and text by their beginnings, so that equal
    rows are neighbours. Ranges of all rows are sorted, not conversations: a long conversation lies
    in many partitions, and so does a row that is repeated without end.
    """
    begin = [F.substring(c, 1, PREFIX).alias(f"{c}_begin") for c in ("role", "text")]
    keyed = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        *begin,
        F.xxhash64("role", "text").alias("mark"),
        F.monotonically_increasing_id().alias("salt"),
    )
    keys = ["conv_id", "turn", "role_begin", "text_begin", "mark", "salt"]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return scratch.save(
        placed.select(
            "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")
        ),
        "ordered",
    )


def coded_blocks(ordered: DataFrame) -> DataFrame:
    """``(conv_id, pos, codes)``: blocks of neighbouring rows of one conversation, a letter a row.

    The letter tells a row's role by its initial (an empty role has none) and its first fault:
    blank, duplicate (role and text stood before), truncated. The first of equal rows is found by
    the digest of its text, summed before it is shuffled.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    kind = F.lit(len(CLASSES))
    for i, letter in enumerate(CLASSES):
        kind = F.when(initial == letter, F.lit(i)).otherwise(kind)
    marked = ordered.select(
        "conv_id",
        "pos",
        kind.alias("kind"),
        (bare == "").alias("blank"),
        cut.alias("cut"),
    )
    first = (
        ordered.filter(bare != "")
        .groupBy("conv_id", "role", F.unhex(F.sha2("text", 256)).alias("digest"))
        .agg(F.min("pos").alias("first_pos"))
        .select("first_pos")
    )
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("first_pos").isNull(), DUPLICATE)
        .when(F.col("cut"), CUT_OFF)
        .otherwise(FINE)
    )
    code = F.char(F.lit(ord("a")) + 4 * F.col("kind") + fault)
    found = marked.join(first, F.col("pos") == F.col("first_pos"), "left")
    block = F.shiftright("pos", BLOCK_BITS).alias("block")
    # At most a block of rows comes together in a group.
    letters = F.sort_array(F.collect_list(F.struct("pos", code.alias("code"))))
    return (
        found.groupBy("conv_id", block)
        .agg(F.min("pos").alias("pos"), letters.alias("letters"))
        .select("conv_id", "pos", F.array_join("letters.code", "").alias("codes"))
    )


def row_of(code: str) -> tuple[str, int]:
    kind, fault = divmod(ord(code) - ord("a"), 4)
    return (CLASSES + " ")[kind], fault


def _edits_of(code: str, state: int) -> list[tuple[str, int, bool, int]]:
    initial, fault = row_of(code)
    after = FOLLOWING[state]
    edits = [("D", DELETE, True, state), ("I", INSERT, False, after)]
    if fault not in (BLANK, DUPLICATE):
        stays = TRUNCATED if fault == CUT_OFF else 0
        if initial == "s" and state == NOTHING:
            edits.append(("K", KEEP + stays, True, AFTER_S))
        elif initial == ROLES[after][0]:
            edits.append(("K", KEEP + stays, True, after))
        edits.append(("R", REROLE + stays, True, after))
    return edits


# What can be done before the next row, by its code and the state: ``(letter, cost, whether the row
# is done, state after)``.
EDITS = {
    code: tuple(_edits_of(code, state) for state in range(4))
    for code in map(chr, range(ord("a"), ord("a") + 4 * (len(CLASSES) + 1)))
}


def suffix_bounds(codes: str, goal: int) -> list[list[int | None]]:
    """For each row and state, the least cost from there to the end in state ``goal``: a lower bound
    of all repairs that pass there, whatever their audits. None where no repair gets there."""
    bounds: list[list[int | None]] = [[None] * 4 for _ in codes]
    bounds.append([0 if s == goal else None for s in range(4)])
    for i in range(len(codes) - 1, -1, -1):
        # One insertion changes the state once; a third never helps.
        for _ in range(3):
            for state in range(4):
                for _, cost, done, after in EDITS[codes[i]][state]:
                    rest = bounds[i + done][after]
                    if rest is not None:
                        so_far = bounds[i][state]
                        bounds[i][state] = cost + rest if so_far is None else min(so_far, cost + rest)
    return bounds


def cheapest(codes: str, start: int, goal: int, bounds: list) -> tuple[int, str] | None:
    """The least ``(cost, audit)`` that leads from state ``start`` over all rows to ``goal``.

    Depth first with a stack of its own. A branch ends where its cost and the bound of what is
    left exceed the incumbent, where they equal it and the audit so far is already greater, or
    where an equal or better prefix has reached the same row and state. An empty stack proves the
    incumbent.
    """
    best: tuple[int, str] | None = None
    reached: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(len(codes) + 1)]
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        rest = bounds[i][state]
        if rest is None:
            continue
        if best is not None and (cost + rest, audit) > (best[0], best[1][: len(audit)]):
            continue
        before = reached[i][state]
        if before is not None and before <= (cost, audit):
            continue
        reached[i][state] = (cost, audit)
        if i == len(codes):
            if best is None or (cost, audit) < best:
                best = (cost, audit)
            continue
        branches = []
        for letter, own, done, after in EDITS[codes[i]][state]:
            left = bounds[i + done][after]
            if left is not None:
                branches.append((cost + own + left, letter, (i + done, after, cost + own)))
        branches.sort(reverse=True)
        stack += [(*node, audit + letter) for _, letter, node in branches]
    return best


def block_repairs(codes: str) -> tuple:
    """``cheapest`` from each state (row) to each state (column)."""
    bounds = [suffix_bounds(codes, goal) for goal in range(4)]
    return tuple(
        tuple(cheapest(codes, start, goal, bounds[goal]) for goal in range(4))
        for start in range(4)
    )


def choose_backwards(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator:
    """Blocks from a conversation's last to its first, each with what it does in each state.

    What the blocks behind a block cost from each of its ends is all that is carried on.
    """
    current, behind, known = (), None, {}
    for batch in batches:
        out = []
        for conv_id, pos, codes in _records(iter([batch])):
            if (conv_id,) != current:
                current, behind = (conv_id,), [len(c) * INSERT for c in CLOSING]
            if codes not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[codes] = block_repairs(codes)
            choices = []
            for row in known[codes]:
                ways = [
                    (found[0] + behind[goal], found[1], goal)
                    for goal, found in enumerate(row)
                    if found is not None
                ]
                choices.append(min(ways))
            behind = [c[0] for c in choices]
            audits, goals = [c[1] for c in choices], [c[2] for c in choices]
            out.append((conv_id, pos, codes, audits, goals))
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
    )


class Replay:
    """One conversation as its records go by: its head, then each block's plan and rows."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.state, self.cost = NOTHING, 0
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.counts = [0, 0, 0, 0]
        self.illegal, self.previous = 0, None
        self.audits: list[str] = []
        self.steps: Iterator[tuple[str, list]] = iter(())

    def plan(self, codes: str, audits: list[str], goals: list[int]) -> None:
        audit = audits[self.state]
        self.audits.append(audit)
        self.steps = self._steps(codes, audit, self.state)
        self.state = goals[self.state]

    @staticmethod
    def _steps(codes: str, audit: str, state: int) -> Iterator[tuple[str, list]]:
        """For each row its code and its ``(letter, new role)``; no new role where it stays."""
        letters = iter(audit)
        for code in codes:
            edits, done = [], False
            while not done:
                letter = next(letters)
                own = {e[0]: e for e in EDITS[code][state]}
                _, _, done, state = own[letter]
                edits.append((letter, ROLES[state] if letter in "IR" else None))
            yield code, edits

    def row(self, turn, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The ``(edit, role, text)`` that one row turns into, deleted rows included."""
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        code, edits = next(self.steps)
        initial, fault = row_of(code)
        self.counts[fault] += 1
        if self.previous is not None and self.previous + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.previous = initial
        for letter, new_role in edits:
            if letter == "I":
                self.cost += INSERT
                yield "I", new_role, ""
                continue
            stays = TRUNCATED if fault == CUT_OFF and letter != "D" else 0
            self.cost += stays + {"K": KEEP, "R": REROLE, "D": DELETE}[letter]
            yield letter, new_role or role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        """The rows to be inserted behind the last one."""
        self.audits.append(CLOSING[self.state])
        for letter in CLOSING[self.state]:
            self.state = FOLLOWING[self.state]
            self.cost += INSERT
            yield letter, ROLES[self.state], ""

    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, taken apart a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            yield from zip(*(c.to_pylist() for c in part.columns))


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Replay, tuple | None]]:
    """Each conversation's edits ``(edit, role, text)`` in order, then None at its end."""
    current = None
    for conv_id, pos, turn, role, text, codes, audits, goals in _records(batches):
        if current is None or current.conv_id != conv_id:
            if current is not None:
                yield from ((current, edit) for edit in current.end())
                yield current, None
            current = Replay(conv_id)
        if codes is not None:
            current.plan(codes, audits, goals)
        elif pos >= 0:
            yield from ((current, edit) for edit in current.row(turn, role, text))
    if current is not None:
        yield from ((current, edit) for edit in current.end())
        yield current, None


MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _rows_out(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, slot, last = [], 0, None
    for replay, edit in replayed(batches):
        slot = 0 if replay is not last else slot
        last = replay
        if edit is not None:
            out.append((replay.conv_id, slot, *edit))
            slot += 1
        if len(out) >= ROWS_AT_ONCE:
            yield _batch(out, schema)
            out = []
    yield _batch(out, schema)


def _digests_out(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, running, some = [], hashlib.sha256(), False
    for replay, edit in replayed(batches):
        if edit is not None:
            letter, role, text = edit
            if letter != "D":
                if some:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
                some = True
            continue
        _, blank, duplicate, truncated = replay.counts
        measures = (replay.gaps(), blank, duplicate, truncated, replay.illegal, replay.cost)
        out.append((replay.conv_id, *measures, "".join(replay.audits), running.hexdigest()))
        running, some = hashlib.sha256(), False
        if len(out) >= ROWS_AT_ONCE:
            yield _batch(out, schema)
            out = []
    yield _batch(out, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Repair:
    """The cheapest repair of each conversation of ``rows`` (``conv_id, turn, role, text``).

    Edits are Keep (0), Rerole to user or assistant (1), Delete (2) and Insert of an empty user or
    assistant row (5); a truncated row that stays costs 5 more, blank and duplicate rows must go.
    The initials of the roles then read ``(s?(ua)+)?``. Of equally cheap repairs that with the least
    audit (the edits' initials) is taken.

    A conversation is searched block by block, from each state that may precede a block to each
    that may follow; costs are then added from its last block to its first, which leaves one number
    per state. So neither a search nor a group grows with a conversation. What must be in one row
    (the audit) or follow one order (the digest) streams through one task, row by row.

    ``ids`` lists conversations that are returned even without rows. Null ids are one
    conversation; null roles and texts count as one space; an empty role fits nowhere as it is.
    Repeated rows are duplicates, rows of equal turn are ordered by role and text. Further columns
    are ignored whatever their names; an empty table gives no rows.
    """

    def __init__(self, rows: DataFrame, ids: DataFrame, scratch: Scratch):
        one_space = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
        ordered = in_order(rows.select("conv_id", "turn", *one_space), scratch)
        id_field = ordered.schema["conv_id"]
        planned = T.StructType(
            [id_field, T.StructField("pos", T.LongType()), T.StructField("codes", T.StringType())]
            + [
                T.StructField("audits", T.ArrayType(T.StringType())),
                T.StructField("goals", T.ArrayType(T.IntegerType())),
            ]
        )
        to_arrow = _arrow(planned)
        plans = (
            coded_blocks(ordered)
            .repartition("conv_id")
            .sortWithinPartitions("conv_id", F.desc("pos"))
            .mapInArrow(lambda batches: choose_backwards(batches, to_arrow), planned)
        )
        heads = ids.select("conv_id").distinct()
        # In this order: a conversation's head, then each block's plan before its rows.
        stream = (
            ordered.withColumn("kind", F.lit(2))
            .unionByName(plans.withColumn("kind", F.lit(1)), allowMissingColumns=True)
            .unionByName(
                heads.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("kind")),
                allowMissingColumns=True,
            )
        )
        self._id = id_field
        self._stream = (
            stream.repartition("conv_id")
            .sortWithinPartitions("conv_id", "pos", "kind")
            .select("conv_id", "pos", "turn", "role", "text", "codes", "audits", "goals")
        )

    def rows(self) -> DataFrame:
        """``(conv_id, slot, edit, role, text)``: all edits in order. The repaired conversation is
        the rows whose edit is not ``D``."""
        fields = [self._id, T.StructField("slot", T.LongType())]
        fields += [T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]
        schema = T.StructType(fields)
        to_arrow = _arrow(schema)
        return self._stream.mapInArrow(lambda batches: _rows_out(batches, to_arrow), schema)

    def digests(self) -> DataFrame:
        """A row per conversation: counts of faults, the cost, the audit and the SHA-256 of the
        repaired ``role:text`` lines."""
        fields = [self._id, *[T.StructField(c, T.LongType()) for c in MEASURES]]
        fields += [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]
        schema = T.StructType(fields)
        to_arrow = _arrow(schema)
        return self._stream.mapInArrow(lambda batches: _digests_out(batches, to_arrow), schema)
