"""Transcript parsing: who speaks in each line, by a hidden Markov model and Viterbi, then canonical turns.

Lines are the observations. Hidden states are (role, opens a turn or continues one). A line shows a speaker
marker (or none), and a few features of its text; given the state these are independent, with Laplace-smoothed
frequencies, as are the transitions. They are counted over all lines of conversations whose roles are known
(a small table whatever the size of the data) and then frozen. Viterbi finds the likeliest states of a whole
conversation; ties go to the state that comes first. A turn opens at every line whose state opens one, and at
the first line; it is rendered as ``<|role|>`` line, its lines, ``<|end|>``. A marker is cut off only from a line that
opens a turn of the role it names; any other is text.

A conversation may be of any length. Lines are range-partitioned in order, so a task holds a stretch of lines.
Conversations inside one task are solved there. For one that goes on in other tasks, every task gives the
matrix of best scores from each state before its stretch to each state at its end; these matrices (one per
task and conversation) are joined up, which fixes the states at the borders, and each stretch is then solved
between its fixed borders. The result is that of one Viterbi run over the whole conversation.

Null text is an empty line, a null role (where roles are learned) is not counted, a null conversation id is a
conversation like any other, null positions sort first and equal rows keep some order. Empty tables give
empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

ROLES = ("system", "user", "assistant")
#: Spellings of speaker markers by role, and how a marker stands before its text.
SPELLINGS = {"system": ("System", "SYSTEM", "Instructions"), "user": ("User", "Human", "Q", "USER"), "assistant": ("Assistant", "AI", "A", "ASSISTANT")}
_MARKER = re.compile(r"^\s*(?:\[|\*\*|#+\s*)?(" + "|".join(sorted({x for v in SPELLINGS.values() for x in v}, key=len, reverse=True)) + r")(?:\]|\*\*)?\s*:\s*")
_ROLE_OF = {x: role for role, v in SPELLINGS.items() for x in v}
STATES = [(role, opens) for role in ROLES for opens in (True, False)]
MARKS = ("none", *ROLES)
FEATURES = {"mark": len(MARKS), "length": 5, "ending": 3, "start": 3}


def split_marker(line: str) -> tuple[str | None, str]:
    """(role that the marker names, the line without it)."""
    found = _MARKER.match(line)
    return (_ROLE_OF[found[1]], line[found.end() :]) if found else (None, line)


def observe(line: str) -> tuple[int, ...]:
    """The features of a line, in the order of ``FEATURES``."""
    role, text = split_marker(line)
    text = text.strip()
    length = int(np.searchsorted((1, 40, 160, 400), len(text), "right"))
    ending = 0 if text.endswith("?") else 1 if text.endswith((".", "!", ":", ";")) else 2
    start = 0 if not text else 1 if text[0].isupper() else 2
    return (0 if role is None else MARKS.index(role), length, ending, start)


@dataclass
class Model:
    """Log probabilities: of first states, of transitions (from, to), and per feature of (state, value)."""

    first: np.ndarray
    moves: np.ndarray
    emits: list[np.ndarray]

    def scores(self, lines: list[str]) -> np.ndarray:
        """Log emission of each line in each state."""
        seen = np.array([observe(x) for x in lines], np.int64).reshape(-1, len(FEATURES))
        return sum(table[:, seen[:, k]].T for k, table in enumerate(self.emits))


def viterbi(first: np.ndarray, moves: np.ndarray, emit: np.ndarray, last: int | None = None) -> np.ndarray:
    """The best states of a stretch: ``first`` scores its first line's states (without emission), ``last`` fixes its end."""
    back = np.zeros(emit.shape, np.int64)
    score = first + emit[0]
    for t in range(1, len(emit)):
        step = score[:, None] + moves
        back[t] = step.argmax(axis=0)
        score = step[back[t], np.arange(len(score))] + emit[t]
    path = np.zeros(len(emit), np.int64)
    path[-1] = score.argmax() if last is None else last
    for t in range(len(emit) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def best_scores(first: np.ndarray, moves: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Best scores of a stretch's last states: row 0 if it opens the conversation, row 1 + s after a line in state s."""
    table = np.vstack([first, moves]) + emit[0][None, :]
    for row in emit[1:]:
        table = (table[:, :, None] + moves[None, :, :]).max(axis=1) + row[None, :]
    return table


def lines_of(turns: DataFrame, conversation: str, turn: str, text: str, *more: str) -> DataFrame:
    """One row per line of each turn: (conversation, turn, line_no, line) and the columns ``more``."""
    return turns.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), *more, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line")
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Lines in order over the whole table; no conversation is too large for this, as ties are broken by a row number."""
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    order = ("conversation", "turn", "line_no", "_row")
    return numbered.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted (kind, a, b): kind -2 first state, -1 transition, k feature k. Borders of tasks cost one transition each."""
    counts: dict[tuple[int, int, int], int] = {}
    before = previous = None
    for batch in batches:
        for conversation, role, line_no, line in zip(*(c.to_pylist() for c in batch.columns)):
            if role not in ROLES:
                before, previous = conversation, None
                continue
            state = STATES.index((role, line_no == 0))
            keys = [(k, state, value) for k, value in enumerate(observe(line))]
            if previous is not None and before == conversation:
                keys.append((-1, previous, state))
            elif line_no == 0:
                keys.append((-2, state, 0))
            for key in keys:
                counts[key] = counts.get(key, 0) + 1
            before, previous = conversation, state
    if counts:
        a, b, c = zip(*counts)
        columns = [pa.array(x, pa.int32()) for x in (a, b, c)] + [pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "n"])


def train(lines: DataFrame) -> Model:
    """Frequencies over all lines (conversation, turn, role, line_no, line) with known roles."""
    rows = _ordered(lines.select("conversation", "turn", "role", "line_no", "line")).select("conversation", "role", "line_no", "line")
    found = rows.mapInArrow(_count, "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    size = len(STATES)
    first, moves, emits = np.ones(size), np.ones((size, size)), [np.ones((size, n)) for n in FEATURES.values()]
    for kind, a, b, n in found:
        if kind == -2:
            first[a] += n
        elif kind == -1:
            moves[a, b] += n
        else:
            emits[kind][a, b] += n
    return Model(*(np.log(x / x.sum(axis=-1, keepdims=True)) for x in (first, moves)), [np.log(x / x.sum(axis=1, keepdims=True)) for x in emits])


def fragments(lines: list[str], states: np.ndarray, before: int | None = None) -> list[tuple[int, str, str, bool]]:
    """(turn, role, text, opens) of a stretch after a line in state ``before``; turns count the openings so far."""
    found, turn = [], 0
    role = None if before is None else STATES[before][0]
    for line, state in zip(lines, states):
        here, opens = STATES[state]
        opens = opens or here != role
        role = here
        named, rest = split_marker(line)
        text = rest if opens and named == here else line
        if opens or not found:
            turn += opens
            found.append((turn, role, [text], opens))
        else:
            found[-1][2].append(text)
    return [(t, r, "\n".join(x), o) for t, r, x, o in found]


_SOLVED = "conversation {key}, part int, place long, turn long, role string, text string, matrix array<double>"


def _stretches(model):
    """Turns of conversations that lie inside a task; lines, with a matrix of scores, of those at its borders."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part, place = model.value, TaskContext.get().partitionId(), 0
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())]
        names = ["conversation", "part", "place", "turn", "role", "text", "matrix"]
        held, name, opening = [], None, True

        def out(border: bool, key_type: pa.DataType) -> pa.RecordBatch:
            emit = m.scores(held)
            if border:
                tables = [best_scores(m.first, m.moves, emit).ravel().tolist()]
                rows = [(part, place - len(held) + i, None, None, x, tables.pop() if tables else None) for i, x in enumerate(held)]
            else:
                rows = [(part, place, t - 1, r, x, None) for t, r, x, _ in fragments(held, viterbi(m.first, m.moves, emit))]
            columns = [pa.array([name] * len(rows), key_type), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and key != name:
                    yield out(opening, batch.column(0).type)
                    held, opening = [], False
                held.append(line)
                name, place = key, place + 1
        if held:
            yield out(True, batch.column(0).type)  # the next task may go on with it

    return solve


def borders(parts: np.ndarray, tables: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(part, state before its stretch or -1, state at its end) of one conversation, from its stretches' tables."""
    order = np.argsort(parts)
    score, back = tables[order[0]][0], []
    for i in order[1:]:
        step = score[:, None] + tables[i][1:]
        back.append(step.argmax(axis=0))
        score = step.max(axis=0)
    ends = [int(score.argmax())]
    for choice in reversed(back):
        ends.append(int(choice[ends[-1]]))
    ends.reverse()
    return list(zip(parts[order].tolist(), [-1, *ends], ends))


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """(conversation, turn, role, rendered): canonical turns of ``lines`` (conversation, turn, line_no, line).

    A turn is one row, whichever tasks had its lines; the pieces of one that crosses tasks are put together.
    """
    shared = lines.sparkSession.sparkContext.broadcast(model)
    key = lines.schema["conversation"].dataType.simpleString()
    rows = _ordered(lines.select("conversation", "turn", "line_no", "line")).select("conversation", "line")
    solved = written(rows.mapInArrow(_stretches(shared), _SOLVED.format(key=key)), "stretches")
    inside = solved.where("role is not null").select("conversation", "turn", "role", "text")
    waiting = solved.where("role is null").select("conversation", "part", "place", "text", "matrix")

    def fix(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (len(STATES) + 1, len(STATES))
        found = borders(pdf.part.to_numpy(), [np.array(x).reshape(shape) for x in pdf.matrix])
        return pd.DataFrame([(name[0], *f) for f in found], columns=["conversation", "part", "before", "last"])

    # a row per task and conversation that may go on beyond it: two for a task at most
    heads = waiting.where("matrix is not null").select("conversation", "part", "matrix")
    fixed = heads.groupBy("conversation").applyInPandas(fix, f"conversation {key}, part int, before int, last int")

    def finish(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m, pdf = shared.value, pdf.sort_values("place")
        before, last, texts = int(pdf.before.iloc[0]), int(pdf["last"].iloc[0]), pdf.text.tolist()
        path = viterbi(m.first if before < 0 else m.moves[before], m.moves, m.scores(texts), last)
        found = fragments(texts, path, None if before < 0 else before)
        return pd.DataFrame([(name[0], name[1], *f) for f in found], columns=["conversation", "part", "turn", "role", "text", "opens"])

    same = F.col("l.conversation").eqNullSafe(F.col("r.conversation")) & (F.col("l.part") == F.col("r.part"))
    bounded = waiting.alias("l").join(fixed.alias("r"), same).select("l.conversation", "l.part", "place", "text", "before", "last")
    pieces = bounded.groupBy("conversation", "part").applyInPandas(finish, f"conversation {key}, part int, turn long, role string, text string, opens boolean")
    pieces = written(pieces, "turns")
    # turns before a part
    by_part = Window.partitionBy("conversation").orderBy("part")
    sizes = pieces.groupBy("conversation", "part").agg(F.max("turn").alias("turns"))
    earlier = F.coalesce(F.sum("turns").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("conversation", "part", earlier.alias("earlier"))
    across = pieces.alias("l").join(sizes.alias("r"), same).select("l.conversation", (F.col("l.turn") + F.col("earlier") - 1).alias("turn"), "l.part", "role", "text")
    texts = F.array_sort(F.collect_list(F.struct("part", "text")))["text"]
    across = across.groupBy("conversation", "turn").agg(F.min_by("role", "part").alias("role"), F.array_join(texts, "\n").alias("text"))
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    return inside.unionByName(across).select("conversation", "turn", "role", rendered.alias("rendered"))


def raw_lines(turns: DataFrame) -> DataFrame:
    """Transcript lines as they are found in the wild, made from (conv_id, turn, role, text).

    A conversation has one spelling of its markers; a fifth of the turns stands without a marker. Roles that
    are unknown have none either.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    spelled = F.lit(None).cast("string")
    for role, names in SPELLINGS.items():
        chosen = F.element_at(F.array(*map(F.lit, names)), (style % len(names) + 1).cast("int"))
        spelled = F.when(F.col("role") == role, chosen).otherwise(spelled)
    marker = F.when(style == 0, F.concat(F.lit("["), spelled, F.lit("]: "))).when(style == 1, F.concat(F.lit("**"), spelled, F.lit("**: "))).otherwise(F.concat(spelled, F.lit(": ")))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    text = F.concat(F.when(bare, "").otherwise(F.coalesce(marker, F.lit(""))), F.coalesce("text", F.lit("")))
    return lines_of(turns.select("conv_id", "turn", "role", text.alias("said")), "conv_id", "turn", "said", "role")


def held_out(conversation: str = "conversation"):
    """The fold that is not learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(conversation).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def recover(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """(conv_id, held_out, turn, role, rendered): turns recovered from the raw lines, without their roles."""
    lines = written(raw_lines(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")), "lines")
    model = train(lines.where(~held_out()))
    found = parse(lines.drop("role"), model)
    return found.select(F.col("conversation").alias("conv_id"), held_out().alias("held_out"), "turn", "role", "rendered")
