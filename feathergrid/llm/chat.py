"""Chat formatting: a state machine over roles writes turns as text segments with loss flags.

A ``Template`` says, as data, how a turn of each role begins and ends, which
roles are trained on, and which role may follow which.  Control strings inside
texts are broken by an escape character, so a formatted conversation can be
read back exactly, whatever its texts say.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import own_names


@dataclass(frozen=True)
class Template:
    """How conversations are written, and which order of roles is right.

    A turn is ``opening``, the role's name, ``closing``, the text, ``end``.  A role
    without a name is written as ``?`` and itself.  ``moves`` maps a state and a
    role to the next state; a conversation begins in ``start`` and is complete in
    one of the states ``final``.  ``escape`` is one character.
    """

    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    trained: tuple[str, ...] = ("assistant",)
    opening: str = "### "
    closing: str = ": "
    end: str = "</turn>"
    escape: str = "\\"
    start: str = "new"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "new": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        controls = (self.opening, self.closing, self.end)
        if len(set(controls)) < 3:
            raise ValueError("opening, closing and end must differ")
        for a in controls:
            if len(a) < 2 or self.escape in a:
                raise ValueError(f"{a!r} is no control string: two characters at least, none the escape character")
            for b in controls:
                if (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")
        for name in self.names.values():
            if name.startswith("?") or self.escape in name or any(c in name + c[:-1] for c in controls):
                raise ValueError(f"role name {name!r} holds what the template needs itself")

    def escaped(self, text: Column, *more: str) -> Column:
        """``text`` with doubled escape characters and one before the last character of each control string."""
        out = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        for control in (self.opening, self.end, *more):
            out = F.replace(out, F.lit(control), F.lit(control[:-1] + self.escape + control[-1]))
        return out

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def after(self, state: str | None, role: str) -> str | None:
        """The state that a turn of ``role`` leads to; None out of turn, and from there on."""
        return self.moves.get(state, {}).get(role)


CHAT = Template()


def _orders(turns: DataFrame, template: Template) -> DataFrame:
    """``conv_id, in_order, complete``: what the state machine says of each conversation's roles.

    Only ids, turns and roles move, and range partitions cut long conversations:
    every piece is reduced to the state it leads to from each state it may begin
    in, and a conversation's pieces, at most one per partition, are chained.
    """
    states = sorted({template.start, *template.moves, *(s for m in template.moves.values() for s in m.values())})
    number = {s: i for i, s in enumerate(states)}
    stuck = len(states)
    step = {
        role: [number[template.moves.get(s, {})[role]] if role in template.moves.get(s, {}) else stuck for s in states] + [stuck]
        for role in {r for m in template.moves.values() for r in m}
    }
    nowhere = [stuck] * (stuck + 1)
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    target = f"conv_id {conv_type}, part int, leads array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, parts, leads, open_ = [], [], [], False
        for batch in batches:
            for conv, role, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not open_ or conv != convs[-1]:
                    if len(convs) >= 10_000:
                        yield batch_of(convs, parts, leads)
                        convs, parts, leads = [], [], []
                    convs.append(conv)
                    parts.append(part)
                    leads.append(list(range(stuck + 1)))
                    open_ = True
                move = step.get(role, nowhere)
                leads[-1] = [move[s] for s in leads[-1]]
        if convs:
            yield batch_of(convs, parts, leads)

    def batch_of(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    roles = turns.select("conv_id", "turn", "role")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role"]
    sorted_ = roles.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_ = sorted_.select("conv_id", "role", F.spark_partition_id().alias("part"))
    arrow = to_arrow_schema(turns.sparkSession.createDataFrame([], target).schema)
    pieces = sorted_.mapInArrow(run, target)
    chained = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "leads"))).alias("pieces"))
    last = F.aggregate("pieces", F.lit(number[template.start]), lambda s, piece: F.element_at(piece["leads"], s + 1))
    finals = [number[s] for s in template.final]
    return chained.select("conv_id", (last != stuck).alias("in_order"), last.isin(finals).alias("complete"))


def segments(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """``conv_id, turn, state, segments``, a row per turn: its text in order as ``array<struct<text, loss>>``.

    The state machine runs over the turns of a conversation and writes each as it
    takes it in: ``state`` is where the turn leads to, null from the first role out of
    turn on, and the loss flag is that of the role.  Rows of a conversation lie
    in order in one partition, by ``turn``, then by the segments themselves, and are
    its formatted text; they stream by, so a task holds no conversation.

    Null texts and roles count as empty, null turns come first, null ids are one
    conversation; repeated rows are turns of their own.  Unknown roles are written
    and never trained on.  All rows are written, whatever the state.  An empty
    table gives no rows; further columns are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.concat(F.lit("?"), template.escaped(role, template.closing))
    for known, written_as in template.names.items():
        name = F.when(role == known, F.lit(written_as)).otherwise(name)
    head = F.concat(F.lit(template.opening), name, F.lit(template.closing))
    rows = own_names(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", role.alias("role"), head.alias("head"), template.escaped(text).alias("body")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "head", "body")
    trained = [r for r in template.names if r in template.trained]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, state = False, None, None
        for batch in batches:
            states, losses = [], []
            for key, said_by in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or key != conv:
                    begun, conv, state = True, key, template.start
                state = template.after(state, said_by)
                states.append(state)
                losses.append(said_by in trained)
            columns = [batch.column(0), batch.column(1), pa.array(states, pa.string()), batch.column(3), batch.column(4), pa.array(losses, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "state", "head", "body", "loss"])

    conv_type, turn_type = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    taken = rows.mapInArrow(run, f"conv_id {conv_type}, turn {turn_type}, state string, head string, body string, loss boolean")
    parts = [(F.col("head"), F.lit(False)), (F.col("body"), F.col("loss")), (F.lit(template.end), F.lit(False))]
    listed = F.array(*[F.struct(t.alias("text"), loss.alias("loss")) for t, loss in parts])
    return taken.select("conv_id", "turn", "state", listed.alias("segments"))


def checked(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """``conv_id, in_order, complete`` per conversation: no role out of turn; ended in a final state.

    Roles of one turn that stands twice are taken in their alphabetical order;
    a null or unknown role is out of turn.
    """
    return _orders(own_names(turns, "conv_id", "turn", "role"), template)


class Reader:
    """Reads one formatted conversation piece by piece; holds one unfinished turn at most."""

    def __init__(self, template: Template):
        self.template = template
        self.roles = {name: role for role, name in template.names.items()}
        self.rest, self.n_turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.state: str | None = template.start
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, loss: bool) -> None:
        t = self.template
        self.chars += len(text)
        if loss:
            plain = t.unescaped(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.rest += text
        while (at := self.rest.find(t.end)) >= 0:
            turn, self.rest = self.rest[:at], self.rest[at + len(t.end) :]
            name, closed, said = turn.removeprefix(t.opening).partition(t.closing)
            if not turn.startswith(t.opening) or not closed:
                raise ValueError(f"not a turn: {turn[:80]!r}")
            role = t.unescaped(name[1:]) if name.startswith("?") else self.roles[name]
            self.turns.update(f"{role}\n{t.unescaped(said)}\n".encode("utf-8", "surrogatepass"))
            self.state = t.after(self.state, role)
            self.n_turns += 1

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"no end of turn: {self.rest[:80]!r}")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, template: Template = CHAT, ordered: bool = False) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from the rows of ``segments``.

    The digests run over whole conversations in order.  They are taken from
    sorted rows as these stream by, so that a conversation of any length needs
    the memory of one turn; a digest being sequential, its rows do meet in one task.
    ``ordered`` says that ``formatted`` is what ``segments`` returned, unmoved, so that
    it is not shuffled again.  The roles read back must lead the state machine to
    the states that were written.
    """
    conv_type = formatted.schema["conv_id"].dataType.simpleString()
    target = (
        f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    arrow = to_arrow_schema(formatted.sparkSession.createDataFrame([], target).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, reader = [], None, None
        for batch in batches:
            for key, pieces, state in zip(batch.column(0), batch.column(1), batch.column(2)):
                key = key.as_py()
                if reader is None or key != conv:
                    if reader is not None:
                        done.append((conv, *reader.row()))
                    conv, reader = key, Reader(template)
                for piece in pieces.as_py():
                    reader.feed(piece["text"], piece["loss"])
                if reader.state != state.as_py():
                    raise ValueError(f"read back as {reader.state}, written as {state.as_py()}: conversation {key}")
            if done:
                yield batch_of(done)
                done = []
        if reader is not None:
            yield batch_of([(conv, *reader.row())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    rows = formatted
    if not ordered:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segments")
    return rows.select("conv_id", "segments", "state").mapInArrow(run, target)
