"""Chat formatting: role sequences are repaired at least cost, then rendered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.common import record_batch, slices, stored

ROLES = ("system", "user", "assistant")
SYSTEM, USER, ASSISTANT = range(3)
#: States of the automaton: nothing said, then the role that spoke last.
START, N_STATES = 3, 4
#: Costs: joining a message to the one before, changing its role, an empty message put in.
MERGE, RELABEL, INSERT = 1.0, 3.0, 2.0
#: Rows that are solved together; only tables of this size are held in a task.
BLOCK_ROWS = 4096
FOREVER = 1e18
BEGIN, END = "<|im_start|>", "<|im_end|>\n"

# Legal turns: a system message at the start only, then user and assistant in turn.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _insertions(state: int, role: int) -> tuple[int, ...] | None:
    """Empty messages needed after ``state`` before ``role`` may speak; None if it never may."""
    paths: list[tuple[int, tuple[int, ...]]] = [(state, ())]
    for _ in range(N_STATES):
        for at, put in paths:
            if role in LEGAL[at]:
                return put
        paths = [(n, (*put, n)) for at, put in paths for n in LEGAL[at] if n != SYSTEM]
    return None


def moves(role: int) -> list[tuple[int, int, float, str, tuple[int, ...]]]:
    """(state, next state, cost, action, roles put in) for a message of ``role`` (-1: unknown)."""
    out = []
    for state in range(N_STATES):
        for new in range(3):
            cost = 0.0 if new == role else RELABEL
            action = "keep" if new == role else "relabel"
            if state == new:
                out.append((state, new, cost + MERGE, f"{action}+merge", ()))
            put = _insertions(state, new)
            if put is not None:
                name = f"{action}+insert" if put else action
                out.append((state, new, cost + INSERT * len(put), name, put))
    return out


MOVES = {role: moves(role) for role in (-1, *range(3))}


def _matrices() -> dict[int, np.ndarray]:
    found = {}
    for role, some in MOVES.items():
        cost = np.full((N_STATES, N_STATES), FOREVER)
        for state, new, c, _, _ in some:
            cost[state, new] = min(cost[state, new], c)
        found[role] = cost
    return found


COSTS = _matrices()


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def role_number(role: str | None) -> int:
    low = (role or "").strip().lower()
    return ROLES.index(low) if low in ROLES else -1


def solve(roles: list[int], start: int, end: int) -> list[tuple[int, str, tuple[int, ...], float]]:
    """Cheapest (role, action, roles put in, cost) of each message from state ``start`` to ``end``.

    Ties go to the first move in the order of :func:`moves`.
    """
    costs = [np.full(N_STATES, FOREVER)]
    costs[0][start] = 0.0
    back: list[list] = []
    for role in roles:
        now, new, via = costs[-1], np.full(N_STATES, FOREVER), [None] * N_STATES
        for move in MOVES[role]:
            c = now[move[0]] + move[2]
            if c < new[move[1]]:
                new[move[1]], via[move[1]] = c, move
        costs.append(new)
        back.append(via)
    out, state = [], end
    for via in reversed(back):
        move = via[state]
        out.append((move[1], move[3], move[4], move[2]))
        state = move[0]
    return out[::-1]


def rendered(
    position: int, role: int, action: str, put: tuple[int, ...], text: str
) -> str:
    """What a message adds to the rendered conversation: a new one ends the one before."""
    if action.endswith("+merge"):
        return f"\n\n{text}"
    empty = "".join(f"{BEGIN}{ROLES[r]}\n{END}" for r in put)
    return f"{END if position else ''}{empty}{BEGIN}{ROLES[role]}\n{text}"


def repair(turns: DataFrame) -> DataFrame:
    """One row per message: conv_id, position, turn, old_role, role, action, inserted, cost, rendered.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Messages of a conversation
    are ordered by turn, then role and text (nulls first), and numbered by ``position``. A dynamic
    program over the automaton of legal turns (an optional system message, then user and assistant
    in turn, a user first) finds the cheapest repair: a message keeps or changes its role, joins
    the message before, or gets empty messages put in before it. Unknown and null roles have to be
    relabelled; a null text is empty. ``rendered`` pieces in the order of positions, put together,
    are the conversation.

    A conversation may hold most of all rows. Rows are dealt by ranges of (conversation, turn),
    so such a one spreads over tasks, and cut into blocks of ``BLOCK_ROWS``. A block of a
    conversation is a 4 x 4 matrix of least costs from state to state; matrices are multiplied
    (min, plus) over a conversation's blocks to choose the state at each border, and then every
    block is solved by itself. Repeated rows are messages of their own. An empty table gives
    an empty result.
    """
    key = ["conv_id", "turn", "role", "_hash"]
    rows = turns.select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("_hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange(*key).sortWithinPartitions(*key, "text").drop("_hash")
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
         ("text", pa.string()), ("part", pa.int64()), ("block", pa.int64()), ("at", pa.int64())]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers rows within (part, conversation) and cuts blocks."""
        part, last, at = TaskContext.get().partitionId(), object(), 0
        for some in slices(batches, 4096):
            ids, places = some.column(0).to_pylist(), []
            for conv in ids:
                at = 0 if conv != last else at + 1
                last = conv
                places.append(at)
            blocks = [x // BLOCK_ROWS for x in places]
            yield record_batch(
                schema, [*some.columns[:4], [part] * len(ids), blocks, places]
            )

    kinds = "conv_id long, turn long, role string, text string, part long, block long, at long"
    numbered = stored(
        dealt.select("conv_id", F.col("turn").cast("long"), "role", "text").mapInArrow(number, kinds),
        "turns",
    )
    block = ["conv_id", "part", "block"]

    costs = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()),
         ("costs", pa.list_(pa.float64()))]
    )

    def one_block(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("at").to_numpy(), kind="stable")
        roles = [role_number(x) for x in rows.column("role").take(pa.array(order)).to_pylist()]
        total = COSTS[roles[0]]
        for role in roles[1:]:
            total = min_plus(total, COSTS[role])
        first = [rows.column(c)[0].as_py() for c in block]
        columns = [[x] for x in (*first, len(roles), total.ravel().tolist())]
        return pa.Table.from_batches([record_batch(costs, columns)])

    found = numbered.select(*block, "at", "role").groupBy(*block).applyInArrow(
        one_block, "conv_id long, part long, block long, n long, costs array<double>"
    )
    borders = _borders(stored(found, "blocks"))

    out = pa.schema(
        [("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()),
         ("old_role", pa.string()), ("role", pa.string()), ("action", pa.string()),
         ("inserted", pa.int64()), ("cost", pa.float64()), ("rendered", pa.string())]
    )

    def render(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("at").to_numpy(), kind="stable")))
        get = {name: rows.column(name).to_pylist() for name in rows.column_names}
        steps = solve(
            [role_number(x) for x in get["role"]], get["enter"][0], get["leave"][0]
        )
        base = get["base"][0]
        pieces = [
            rendered(base + i, *step[:3], text)
            for i, (step, text) in enumerate(zip(steps, get["text"], strict=True))
        ]
        if get["is_last"][0]:
            pieces[-1] += END
        columns = [
            get["conv_id"], [base + i for i in range(len(steps))], get["turn"], get["role"],
            [ROLES[s[0]] for s in steps], [s[1] for s in steps], [len(s[2]) for s in steps],
            [s[3] for s in steps], pieces,
        ]
        return pa.Table.from_batches([record_batch(out, columns)])

    whole = _null_safe(numbered, borders, block)
    kinds = (
        "conv_id long, position long, turn long, old_role string, role string, action string, "
        "inserted long, cost double, rendered string"
    )
    return whole.groupBy(*block).applyInArrow(render, kinds)


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which a null conversation equals another."""
    other = right.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(other, same).drop(*[f"_{c}" for c in on])


def _borders(blocks: DataFrame) -> DataFrame:
    """States in which each block is entered and left, and messages before it.

    One row per block of up to ``BLOCK_ROWS`` messages. Most conversations are one block; the
    blocks of one conversation go through its task one after another, 16 numbers each.
    """
    out = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()),
         ("enter", pa.int64()), ("leave", pa.int64()), ("base", pa.int64()),
         ("is_last", pa.bool_())]
    )

    def walk(rows: pa.Table) -> pa.Table:
        some = sorted(rows.to_pylist(), key=lambda r: (r["part"], r["block"]))
        costs, via = [np.full(N_STATES, FOREVER)], []
        costs[0][START] = 0.0
        for r in some:
            matrix = np.array(r["costs"]).reshape(N_STATES, N_STATES)
            total = costs[-1][:, None] + matrix
            via.append(total.argmin(axis=0))
            costs.append(total.min(axis=0))
        state, states = int(costs[-1].argmin()), []
        for step in reversed(via):
            states.append((int(step[state]), state))
            state = int(step[state])
        states.reverse()
        base, columns = 0, [[] for _ in out]
        for r, (enter, leave) in zip(some, states, strict=True):
            row = (r["conv_id"], r["part"], r["block"], enter, leave, base, r is some[-1])
            for column, x in zip(columns, row, strict=True):
                column.append(x)
            base += r["n"]
        return pa.Table.from_batches([record_batch(out, columns)])

    kinds = (
        "conv_id long, part long, block long, enter long, leave long, base long, "
        "is_last boolean"
    )
    return blocks.groupBy("conv_id").applyInArrow(walk, kinds)
