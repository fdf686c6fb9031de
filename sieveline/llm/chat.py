"""Chat formatting with minimum-cost role repair.

Legal conversations: an optional system message first, then user and assistant in turn, user first. Each turn
is kept, relabelled (cost 2), or merged into the message before it (cost 1, besides relabelling); an empty
message may be inserted before it (cost 3 each). Dynamic programming over the automaton of legal messages
finds the choices of least total cost, and the repaired conversation is rendered turn by turn.

A conversation of any length is spread over tasks: rows are range-partitioned by conversation and turn, each
partition reduces its part of a conversation to a small matrix of costs between states, and the driver joins
these (two a partition, and no more) to tell each part the costs with which it starts and the state in which
it ends. So a conversation with a third of all rows is no single task's.

Roles other than system, user and assistant, and null, are relabelled. Null texts are empty. Null turns come
first; equal turns stand in order of role and text. Rows with a null conversation id form one conversation.
Equal costs are settled by the last state first, the one that comes earlier in STATES. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import cut

ROLES = ("system", "user", "assistant")
#: State 0 is the start; the others are named by the last message's role.
STATES = ("start", *ROLES)
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
RELABEL, MERGE, INSERT = 2, 1, 3
FAR = 10**15
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"


def _insertions() -> dict[tuple[str, str], list[str]]:
    """For each state and role, the empty messages to insert before a message of that role (the fewest)."""
    out: dict[tuple[str, str], list[str]] = {}
    for state in STATES:
        paths = [[]]
        while paths:
            path = paths.pop(0)
            for role in NEXT[path[-1] if path else state]:
                if (state, role) not in out:
                    out[state, role] = path
                    paths.append([*path, role])
    return out


_PATHS = _insertions()


def options(role: str | None) -> list[list[tuple[int, str, list[str]] | None]]:
    """Cost, action and insertions of a turn's step from state to state."""
    table: list[list[tuple[int, str, list[str]] | None]] = [[None] * len(STATES) for _ in STATES]
    for a, state in enumerate(STATES):
        for b, new in enumerate(ROLES, 1):
            label = 0 if role == new else RELABEL
            name = "keep" if role == new else "relabel"
            choices = []
            if (state, new) in _PATHS:
                path = _PATHS[state, new]
                choices.append((label + INSERT * len(path), name, path))
            if state == new:
                choices.append((label + MERGE, "merge" if role == new else "merge_relabel", []))
            table[a][b] = min(choices, key=lambda x: x[0], default=None)
    return table


_TABLES = {role: options(role) for role in (*ROLES, None)}
_COSTS = {role: np.array([[FAR if x is None else x[0] for x in row] for row in table], np.int64) for role, table in _TABLES.items()}


def _known(role: str | None) -> str | None:
    return role if role in ROLES else None


def step_costs(before: np.ndarray, role: str | None) -> np.ndarray:
    """Least costs by state after a turn; before may be a vector or a matrix of rows of them."""
    return np.minimum((before[..., :, None] + _COSTS[_known(role)]).min(axis=-2), FAR)


def solve(roles: list[str | None], start: np.ndarray, last: int | None) -> tuple[list[int], int]:
    """The states after each turn, and the state before the first; last: the final state, else the cheapest."""
    costs = [start]
    for role in roles:
        costs.append(step_costs(costs[-1], role))
    state = int(costs[-1].argmin()) if last is None else last
    states = [state]
    for i in range(len(roles) - 1, -1, -1):
        state = int((costs[i] + _COSTS[_known(roles[i])][:, state]).argmin())
        states.append(state)
    return states[-2::-1], states[-1]


START = np.array([0] + [FAR] * len(ROLES), np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Runs of equal conversation ids in a sorted partition: id, rows (turn, role, text)."""
    key, rows, begun = None, [], False
    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if begun and conv != key:
                yield key, rows
                rows = []
            key, begun = conv, True
            rows.append((turn, role, text))
    if begun:
        yield key, rows


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per turn: conv_id, turn, role, role_out, action, inserted (roles of empty messages put before it), rendered.

    The rendered parts of a conversation, in order of its turns, are the repaired conversation.
    """
    spark = conversations.sparkSession
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    # written once, so that all passes see the same partitions
    dealt = cut(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last conversation's piece of the partition, with costs from each state to each."""
        found: list[tuple] = []
        for nth, (conv, turns) in enumerate(_pieces(batches)):
            if len(found) > 1:
                found.pop()
            found.append((nth, conv, turns))
        part, out = TaskContext.get().partitionId(), []
        for nth, conv, turns in found:
            matrix = np.where(np.eye(len(STATES), dtype=bool), 0, FAR)
            for _, r, _ in turns:
                matrix = step_costs(matrix, r)
            out.append((part, nth, conv, [int(x) for x in matrix.ravel()]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.list_(pa.int64()))], names=["part", "nth", "conv", "matrix"])

    pieces = sorted(dealt.mapInArrow(ends, "part int, nth long, conv long, matrix array<long>").collect())
    chains: list[list] = []
    for p in pieces:
        if chains and chains[-1][-1][2] == p[2]:
            chains[-1].append(p)
        else:
            chains.append([p])
    starts: dict[tuple[int, int], list[int]] = {}
    linked = [c for c in chains if len(c) > 1]
    for chain in linked:
        costs = START
        for p in chain:
            starts[p[0], p[1]] = [int(x) for x in costs]
            costs = np.minimum((costs[:, None] + np.array(p[3]).reshape(len(STATES), -1)).min(axis=0), FAR)
    held = spark.sparkContext.broadcast(starts)

    def backs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For pieces of spread conversations: the state before the piece for each state after it."""
        part, out = TaskContext.get().partitionId(), []
        for nth, (_, turns) in enumerate(_pieces(batches)):
            if (begin := held.value.get((part, nth))) is not None:
                out.append((part, nth, [solve([r for _, r, _ in turns], np.array(begin), last)[1] for last in range(len(STATES))]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], names=["part", "nth", "before"])

    ended: dict[tuple[int, int], tuple[int | None, bool]] = {}
    if linked:
        before = {(r[0], r[1]): r[2] for r in dealt.mapInArrow(backs, "part int, nth long, before array<int>").collect()}
        for chain in linked:
            last = chain[-1]
            costs = np.array(starts[last[0], last[1]])
            state = int((costs[:, None] + np.array(last[3]).reshape(len(STATES), -1)).min(axis=0).argmin())
            for p in reversed(chain):
                ended[p[0], p[1]] = (state, p is last)
                state = before[p[0], p[1]][state]
    plan = spark.sparkContext.broadcast((starts, ended))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        begun, endings = plan.value
        out: list[tuple] = []
        for nth, (conv, turns) in enumerate(_pieces(batches)):
            start = np.array(begun.get((part, nth), START))
            last, closes = endings.get((part, nth), (None, True))
            roles = [r for _, r, _ in turns]
            states, state = solve(roles, start, last)
            for i, ((at, r, body), new) in enumerate(zip(turns, states, strict=True)):
                _, action, inserted = _TABLES[_known(r)][state][new]
                if action.startswith("merge"):
                    piece = "\n" + body
                else:
                    empty = "".join(OPEN.format(role=x) + CLOSE for x in inserted)
                    piece = (CLOSE if state else "") + empty + OPEN.format(role=STATES[new]) + body
                if closes and i == len(turns) - 1:
                    piece += CLOSE
                out.append((conv, at, r, STATES[new], action, inserted, piece))
                state = new
            if len(out) >= 2_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        names = ["conv_id", "turn", "role", "role_out", "action", "inserted", "rendered"]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=names)

    return dealt.mapInArrow(render, "conv_id long, turn long, role string, role_out string, action string, inserted array<string>, rendered string")


def least_cost(roles: list[str | None]) -> int:
    """Brute force: the least cost over all sequences of states."""
    import itertools

    best = FAR
    for states in itertools.product(range(1, len(STATES)), repeat=len(roles)):
        total, state = 0, 0
        for role, new in zip(roles, states, strict=True):
            step = options(role if role in ROLES else None)[state][new]
            total += FAR if step is None else step[0]
            state = new
        best = min(best, total)
    return best if roles else 0


def cost_of(action: str, inserted: list[str]) -> int:
    return {"keep": 0, "relabel": RELABEL, "merge": MERGE, "merge_relabel": MERGE + RELABEL}[action] + INSERT * len(inserted)
