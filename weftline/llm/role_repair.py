"""Minimum-cost role repair of conversations, then rendering.

A legal conversation is an optional system turn, then user and assistant in
turn, ending with the assistant. Dynamic programming over that automaton finds
the cheapest way to make any sequence of messages legal: a message is kept
(0), merged into the turn before it (``MERGE``), relabelled (``RELABEL``, also
on top of a merge), or preceded by empty turns (``INSERT`` each). Between
equal costs, the order keep, merge, relabel, insert decides, at the earliest
state.

A message is a 4 x 4 matrix of costs from state to state in the min-plus
algebra, and a run of messages is the product of theirs. Messages are dealt by
ranges of (conversation, turn, role, text) and cut, in order, into parts of up
to ``PART`` messages; a part gets its matrix while its messages pass by. The
matrices of a conversation give every part its entry and exit state, and parts
are then repaired and rendered side by side. So a conversation of any length,
whatever its turn numbers, never meets in one task; only its matrices do, one
for ``PART`` messages. Only messages equal in turn, role and the first
``NEAR`` characters share a range, and those stream through their task.

The rendered parts of a conversation, joined in order, are the conversation:
``<|role|>`` newline text ``<|end|>`` newline for every turn.

Defined cases: a null text is empty; a null or unknown role has to be
relabelled; a null turn number sorts first; equal turn numbers are ordered by
role, then text, and repeated rows all stay; rows without a conversation
identifier form one conversation; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, table

ROLES = ("system", "user", "assistant")
#: Other names of the roles, fixed.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1, 2, 3
PART, NEAR = 1024, 64
FAR = 1 << 40
#: Empty turns that lead from a state to another at least cost, () for none.
ROUTES: dict[tuple[int, int], tuple[int, ...]] = {}


def _routes() -> None:
    for start in range(4):
        ROUTES[start, start] = ()
        wave = [start]
        while wave:
            step = []
            for state in wave:
                for to in NEXT[state]:
                    if (start, to) not in ROUTES:
                        ROUTES[start, to] = (*ROUTES[start, state], to)
                        step.append(to)
            wave = step


_routes()


def state_of(role: str | None) -> int:
    """1-3 for a known role, 0 for none."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def _moves(role: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """(from, to) -> (cost, action, empty turns first), the cheapest each."""
    best: dict = {}
    for s in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            change = RELABEL if role != to else 0
            options = []
            for before in range(4):
                if (s, before) in ROUTES:
                    path = ROUTES[s, before]
                    if to in NEXT[before]:
                        options.append((INSERT * len(path) + change, ("insert" if path else "relabel" if change else "keep"), path))
                    if before == to and not path:
                        options.append((MERGE + change, "merge", ()))
            rank = {"keep": 0, "merge": 1, "relabel": 2, "insert": 3}
            if options:
                best[s, to] = min(options, key=lambda o: (o[0], rank[o[1]], o[2]))
    return best


MOVES = [_moves(role) for role in range(4)]


def _matrix(role: int) -> np.ndarray:
    out = np.full((4, 4), FAR, dtype=np.int64)
    for (s, to), (cost, _, _) in MOVES[role].items():
        out[s, to] = cost
    return out


MATRICES = [_matrix(role) for role in range(4)]


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.minimum((left[:, :, None] + right[None, :, :]).min(axis=1), FAR)


IDENTITY = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)


def path_states(matrices: list[np.ndarray]) -> list[int]:
    """The states at the borders of a run of matrices, from the start to the
    state from which the end costs least."""
    cost = np.full(4, FAR, dtype=np.int64)
    cost[START] = 0
    back = []
    for m in matrices:
        total = cost[:, None] + m
        back.append(total.argmin(axis=0))
        cost = np.minimum(total.min(axis=0), FAR)
    closing = np.array([INSERT * len(ROUTES[s, ASSISTANT]) for s in range(4)])
    states = [int((cost + closing).argmin())]
    for choice in reversed(back):
        states.append(int(choice[states[-1]]))
    return states[::-1]


def repair(roles: list[int], entry: int = START, leave: int | None = None) -> list[tuple[str, int, tuple[int, ...]]]:
    """(action, state, empty turns first) of every message, least in total
    from ``entry`` to ``leave``; None: to the cheapest end."""
    cost = [FAR] * 4
    cost[entry] = 0
    back = []
    for role in roles:
        moves, step, choice = MOVES[role], [FAR] * 4, [0] * 4
        for (s, to), (c, _, _) in moves.items():
            if cost[s] + c < step[to]:
                step[to], choice[to] = cost[s] + c, s
        back.append(choice)
        cost = step
    if leave is None:
        leave = min(range(4), key=lambda s: (cost[s] + INSERT * len(ROUTES[s, ASSISTANT]), s))
    out, state = [], leave
    for role, choice in zip(reversed(roles), reversed(back), strict=True):
        before = choice[state]
        _, action, path = MOVES[role][before, state]
        out.append((action, state, path))
        state = before
    return out[::-1]


def render(messages: list[tuple[int, str]], entry: int, leave: int, last: bool) -> tuple[str, dict[str, int]]:
    """The text of a part and its counts. A part that follows another begins
    inside that one's last turn; the last part closes its own."""
    plan = repair([r for r, _ in messages], entry, leave)
    out: list[str] = []
    counts = {"turns": 0, "merges": 0, "relabels": 0, "inserts": 0}
    is_open = entry != START

    def turn(state: int, text: str) -> None:
        nonlocal is_open
        if is_open:
            out.append("<|end|>\n")
        out.append(f"<|{ROLES[state - 1]}|>\n{text}")
        counts["turns"] += 1
        is_open = True

    for (role, text), (action, state, path) in zip(messages, plan, strict=True):
        for extra in path:
            turn(extra, "")
        counts["inserts"] += len(path)
        counts["relabels"] += role != state
        if action == "merge":
            counts["merges"] += 1
            out.append("\n\n" + text)
        else:
            turn(state, text)
    if last:
        for extra in ROUTES[leave, ASSISTANT]:
            turn(extra, "")
            counts["inserts"] += 1
        if is_open:
            out.append("<|end|>\n")
    return "".join(out), counts


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first ``keys`` columns, across batches."""
    run: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run and row[:keys] != run[0][:keys]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _out(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 1024:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)


def format_chats(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART) -> DataFrame:
    """One row per part of a conversation: conv_id, part (from 0), n_messages,
    n_turns, n_merges, n_relabels, n_inserts, cost, rendered."""
    from weftline.session import materialize

    source = messages.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The messages with their part and place in it, and a row with the
        matrix of every part behind its last message."""
        number, key, size, m = (TaskContext.get().partitionId() << 32) - 1, None, 0, IDENTITY
        for batch in batches:
            rows: list[tuple] = []
            for conv, _, name, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not size or conv != key or size == part_turns:
                    if size:
                        rows.append((key, number, size, None, None, m.ravel().tolist()))
                    number, key, size, m = number + 1, conv, 0, IDENTITY
                rows.append((conv, number, size, name, words, None))
                m, size = product(m, MATRICES[state_of(name)]), size + 1
            yield from _out(iter(rows), parts_schema)
        if size:
            yield from _out(iter([(key, number, size, None, None, m.ravel().tolist())]), parts_schema)

    parts_schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("costs", pa.list_(pa.int64()))])
    dealt = source.repartitionByRange(*order, F.substring("text", 1, NEAR)).sortWithinPartitions(*order, "text")
    held = materialize(map_arrow(dealt, cut, "conv_id long, part long, seq long, role string, text string, costs array<long>"), "chat-parts")
    parts = held.where("costs IS NOT NULL").select("conv_id", "part", "costs")

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for run in _runs(batches, 1):
                states = path_states([np.array(r[2], dtype=np.int64).reshape(4, 4) for r in run])
                for k, r in enumerate(run):
                    yield r[0], r[1], k, states[k], states[k + 1], k == len(run) - 1

        kinds = [("b_conv", pa.int64()), ("b_part", pa.int64()), ("number", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())]
        return _out(rows(), pa.schema(kinds))

    ends = parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")
    ends = materialize(map_arrow(ends, borders, "b_conv long, b_part long, number long, enter int, leave int, last boolean"), "role-repair")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for run in _runs(batches, 1):
                number, enter, leave, last = run[0][5:]
                rendered, n = render([(state_of(r[3]), r[4]) for r in run], enter, leave, last)
                cost = MERGE * n["merges"] + RELABEL * n["relabels"] + INSERT * n["inserts"]
                yield run[0][2], number, len(run), n["turns"], n["merges"], n["relabels"], n["inserts"], cost, rendered

        names = ["conv_id", "part", "n_messages", "n_turns", "n_merges", "n_relabels", "n_inserts", "cost"]
        return _out(rows(), pa.schema([(n, pa.int64()) for n in names] + [("rendered", pa.string())]))

    joined = held.where("costs IS NULL").join(ends, F.col("part") == F.col("b_part")).select("part", "seq", "conv_id", "role", "text", "number", "enter", "leave", "last")
    joined = joined.repartition("part").sortWithinPartitions("part", "seq")
    return map_arrow(joined, finish, "conv_id long, part long, n_messages long, n_turns long, n_merges long, n_relabels long, n_inserts long, cost long, rendered string")


def op4_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
