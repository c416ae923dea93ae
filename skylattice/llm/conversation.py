"""Repair of conversations: the cheapest edits that make the roles alternate, by a Viterbi search with coalescing survivors.

A well-formed conversation is empty, or an optional system turn and then pairs of a user's and an assistant's
turn. Edits: keep a row (K, free), give it the role user or assistant (R, 1), delete it (D, 2), insert an empty
turn of a user or an assistant (I, 5). Blank and repeated rows have to go; a truncated row that stays costs 5.
Of equally dear repairs the one whose string of edits is least in ASCII order is taken.

The search has four states: nothing yet, after the system turn, after a user, after an assistant. Every state
keeps one survivor, the leaf of a tree of backpointers whose nodes count their references. A node without any is
freed, with its ancestors that only it held; once all survivors descend from one child of the root, that
child's edits are final, are emitted and leave the tree. A state that costs more than another by so much that no rest of
the conversation can make up for it has no survivor. So a task holds the texts of unresolved rows only: few, unless
one role is repeated over a long stretch, all of which stays open until a row decides it. Tied survivors
are told apart by their complete unresolved edits: as each step's string ends in its one K, R or D, no survivor's
string is the start of another's, and the order of the strings carries over from row to row as a rank.

Rows are streamed through the task of their conversation in order; nothing of a conversation is gathered.
Whether a role and text were seen before is not remembered there: a grouped minimum marks the first place of
each, and the marks are sorted in before their rows. A repair is one sequence and so is a digest of its text:
the rows of one conversation, however many, pass one task, in bounded memory.

Defined results: the rows of a conversation go by turn (nulls first), then role, then digest of the text, so
ties and repeated rows have one order. A null role or text is read as one space. A role's initial is its first
character; an empty role has none and cannot be kept. Rows of a null conversation are a conversation. Turns may
be any integers. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skylattice.llm.common import small_batches

_BLANK = " \t\n\x0b\x0c\r"
_HEAD, _MARK, _ROW = range(3)
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Initials that a role may have in each state, and the state they lead to.
_NEXT = {_START: {"s": _SYSTEM, "u": _USER}, _SYSTEM: {"u": _USER}, _USER: {"a": _ASSISTANT}, _ASSISTANT: {"u": _USER}}
_GIVEN = {_START: "user", _SYSTEM: "user", _USER: "assistant", _ASSISTANT: "user"}
_DELETE, _REROLE, _INSERT, _TRUNCATED = 2, 1, 5, 5
#: How much more the rest of the way may cost from the first state than from the second: by inserted turns, by deleting a
#: system turn that the second would keep, or nothing where the first may do all that the second may.
_AHEAD = {
    (_START, _SYSTEM): 0, (_START, _USER): _INSERT, (_START, _ASSISTANT): 0,
    (_SYSTEM, _START): 2 * _INSERT, (_SYSTEM, _USER): _INSERT, (_SYSTEM, _ASSISTANT): 2 * _INSERT,
    (_USER, _START): _INSERT + _DELETE, (_USER, _SYSTEM): _INSERT, (_USER, _ASSISTANT): _INSERT,
    (_ASSISTANT, _START): _DELETE, (_ASSISTANT, _SYSTEM): 0, (_ASSISTANT, _USER): _INSERT,
}
#: Inserted turns before one row; with a third the state of the first comes back.
_MOST_INSERTS = 2
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Node:
    """A step of a survivor: the edits up to and with one row, and the references of its followers."""

    __slots__ = ("parent", "kids", "step", "row")

    def __init__(self, parent: "_Node | None", step: str, row: tuple[str, str] | None):
        self.parent, self.step, self.row, self.kids = parent, step, row, set()


class Search:
    """The survivors of one conversation; ``emit(edit, role, text)`` is called for each edit once it is final."""

    def __init__(self, emit: Callable[[str, str, str], None]):
        self.emit, self.state = emit, _START
        self.root = _Node(None, "", None)
        #: Cost, state and leaf of each survivor, in the order of their edits.
        self.survivors = [(0, _START, self.root)]
        self.unresolved = 0

    @staticmethod
    def _inserted(cost: int, state: int) -> Iterator[tuple[int, int, str]]:
        for k in range(_MOST_INSERTS + 1):
            yield cost + k * _INSERT, state, "I" * k
            state = _NEXT[state][_GIVEN[state][0]]

    def push(self, role: str, text: str, fault: str | None) -> None:
        best: dict[int, tuple[int, int, str]] = {}
        kept = _TRUNCATED if fault == "truncated" else 0
        for rank, (cost, state, _) in enumerate(self.survivors):
            for c, s, inserts in self._inserted(cost, state):
                moves = [(c + _DELETE, s, inserts + "D")]
                if fault in (None, "truncated"):
                    moves.append((c + kept + _REROLE, _NEXT[s][_GIVEN[s][0]], inserts + "R"))
                    if role[:1] in _NEXT[s]:
                        moves.append((c + kept, _NEXT[s][role[:1]], inserts + "K"))
                for total, to, step in moves:
                    if to not in best or (total, rank, step) < best[to]:
                        best[to] = (total, rank, step)
        old, row, leaves = self.survivors, (role, text), []
        for to, (total, rank, step) in sorted(best.items(), key=lambda b: b[1][1:]):
            if any(best[other][0] + _AHEAD[other, to] < total for other in best if other != to):
                continue  # whatever follows, the other state's repair is cheaper
            node = _Node(old[rank][2], step, row)
            node.parent.kids.add(node)
            leaves.append((total, to, node))
        self.survivors = leaves
        for _, _, node in old:
            self._release(node)
        self._settle()

    def _release(self, node: _Node) -> None:
        while not node.kids and node.parent is not None:
            node.parent.kids.discard(node)
            node = node.parent

    def _settle(self) -> None:
        """Emit what all survivors share."""
        self.unresolved += 1
        while len(self.root.kids) == 1:
            (child,) = self.root.kids
            self._apply(child.step, child.row)
            child.parent, self.root = None, child
            child.row = None
            self.unresolved -= 1

    def _apply(self, step: str, row: tuple[str, str] | None) -> None:
        for edit in step:
            role, text = row if row and edit in "KRD" else ("", "")
            if edit in "RI":
                role = _GIVEN[self.state]
            if edit != "D":
                self.state = _NEXT[self.state][role[0]]
            self.emit(edit, role, text)

    def finish(self) -> int:
        """Emit the rest of the cheapest repair; its cost."""
        cost, rank, inserts = min(
            (c, rank, inserts) for rank, (cost, state, _) in enumerate(self.survivors)
            for c, s, inserts in self._inserted(cost, state) if s in (_START, _ASSISTANT))
        steps, node = [], self.survivors[rank][2]
        while node is not self.root:
            steps.append((node.step, node.row))
            node = node.parent
        for step, row in reversed(steps):
            self._apply(step, row)
        self._apply(inserts, None)
        return cost


class _Conversation:
    """Counts of one conversation's rows as they come, and its search."""

    def __init__(self, key, emit: Callable[[str, str, str], None]):
        self.key, self.search = key, Search(emit)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.before = None
        self.fresh = False

    def mark(self) -> None:
        self.fresh = True

    def push(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        seen, body, fault = not self.fresh, text.strip(_BLANK), None
        self.fresh = False
        if not body:
            fault = "blank"
        elif seen:
            fault = "duplicate"
        elif body[-1] not in ".!?":
            fault = "truncated"
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.search.push(role, text, fault)

    def finish(self) -> tuple[int, ...]:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.search.finish()


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows, a mark before the first row of each role and text, and one head per conversation, sorted in their tasks."""
    filled = rows.where("here").select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    filled = filled.withColumn("digest", _digest())
    first = filled.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("told"), "turn")).alias("first"))
    none = F.lit(None)
    whole = filled.select("conv", F.lit(_ROW).alias("kind"), "turn", "role", "digest", "text")
    marks = first.select("conv", F.lit(_MARK), "first.turn", "role", "digest", none.cast("string"))
    heads = rows.select("conv").distinct().select("conv", F.lit(_HEAD), none.cast("long"), none.cast("string"), none.cast("binary"), none.cast("string"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest", "kind")]
    return whole.union(marks).union(heads).repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "turn", "role", "text")


def _walk(batches: Iterator[pa.RecordBatch], start: Callable[[object], Callable[[str, str, str], None]],
          end: Callable[[_Conversation], None]) -> Iterator[None]:
    """Lead each conversation of sorted rows from start to end; a yield after every batch."""
    now: _Conversation | None = None
    for batch in batches:
        for key, kind, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if now is None or key != now.key:
                if now is not None:
                    end(now)
                now = _Conversation(key, start(key))
            if kind == _MARK:
                now.mark()
            elif kind == _ROW:
                now.push(turn, role, text)
        yield
    if now is not None:
        end(now)
    yield


def _prepared(rows: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    here = F.col("here") if "here" in rows.columns else F.lit(True)
    return _in_order(rows.select("conv", F.col("turn").cast("long").alias("turn"), "role", "text", here.alias("here")))


def report(rows: DataFrame) -> DataFrame:
    """``conv``, counts of faults, ``cost``, ``audit`` and ``repaired_sha256`` for each conversation of ``rows``.

    ``rows`` has ``conv, turn, role, text``; a row whose ``here`` is false only names its conversation.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        audit, digest, first = bytearray(), hashlib.sha256(), True

        def start(_key):
            nonlocal audit, digest, first
            audit, digest, first = bytearray(), hashlib.sha256(), True
            return emit

        def emit(edit: str, role: str, text: str) -> None:
            nonlocal first
            audit.extend(edit.encode())
            if edit != "D":
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        def end(found: _Conversation) -> None:
            counts = found.finish()
            done.append((found.key, *counts, audit.decode(), digest.hexdigest()))

        for _ in _walk(batches, start, end):
            yield _batch(done, schema)
            done.clear()

    return _prepared(rows).mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """``conv, place, edit, role, text``: the rows of each repaired conversation, numbered from 0."""
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, place long, edit string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def start(key):
            place = 0

            def emit(edit: str, role: str, text: str) -> None:
                nonlocal place
                if edit != "D":
                    done.append((key, place, edit, role, text))
                    place += 1
            return emit

        for _ in _walk(batches, start, lambda found: found.finish()):
            yield _batch(done, schema)
            done.clear()

    return _prepared(rows).mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(part.split() for part in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds)], list(names))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows (conv, turn, role, text)`` with made faults, drawn from the checksum of conversation and turn.

    Of twenty remainders 0 drops the row (``here`` is false), 1 empties its text, 2 takes out stops, 3 repeats it,
    4 gives it the role user. Nulls are read as one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    draw = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    told = rows.select("conv", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1))
    return told.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("draw") != 0).alias("here"), F.explode(times).alias("copy")).drop("copy")
