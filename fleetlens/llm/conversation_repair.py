"""Conversation structure repair: the cheapest edits that make turns alternate, by runs of equal symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.common import SPACES, record_batch, slices, stored, worker_state

#: Costs of an edit; a truncated message that stays costs one more.
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the automaton of ``(s?(ua)+)?``: nothing yet, then what came last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
N_STATES = 4
#: From state and role initial to the next state. Messages may end after NOTHING and ASSISTANT.
NEXT = {
    (NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
ENDS = (NOTHING, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
FOREVER = 1 << 60
#: A message that has to go; the other symbols are 2 x place in INITIALS + truncated.
GONE = 8
INITIALS = "sua"
LEGAL_PAIRS = {"su", "ua", "au"}
#: Rows read from Arrow at a time.
ROWS = 4096
#: Steps of runs of up to 2**CACHED_BITS messages are remembered.
CACHED_BITS = 12
REMEMBERED = 1 << 13

Costs = tuple[int, ...]
Matrix = tuple[Costs, ...]


class Step(NamedTuple):
    """What happens to one message: initials put in before it, its edit, its initial afterwards."""

    before: str
    edit: str
    initial: str


#: Each possible step has one character, so that the steps of a run are a text.
STEPS = [
    Step(before, edit, initial)
    for before in ("", "u", "a", "ua", "au")
    for edit, initial in (("D", ""), *((e, i) for e in "KR" for i in INITIALS))
]
CODES = {step: chr(65 + n) for n, step in enumerate(STEPS)}


def inserted(state: int) -> tuple[str, int]:
    """The only message that may be put in after ``state``, and the state it leads to."""
    initial = "a" if state == USER else "u"
    return initial, NEXT[state, initial]


def edits(symbol: int, state: int) -> list[tuple[str, str, int, int]]:
    """(letter, initial afterwards, cost, next state) of a message without insertions, letters in order."""
    out = [("D", "", DELETE, state)]
    if symbol != GONE:
        own, extra = INITIALS[symbol >> 1 :][:1], symbol & 1
        if (state, own) in NEXT:
            out.append(("K", own, extra * TRUNCATED, NEXT[state, own]))
        for initial in NAMES:
            if (state, initial) in NEXT:
                cost = RELABEL + extra * TRUNCATED
                out.append(("R", initial, cost, NEXT[state, initial]))
    return out


def min_plus(a: Matrix, b: Matrix) -> Matrix:
    columns = list(zip(*b, strict=True))
    return tuple(
        tuple(min(x + y for x, y in zip(row, c, strict=True)) for c in columns) for row in a
    )


def applied(matrix: Matrix, after: Costs) -> Costs:
    """Least costs before, from those after."""
    return tuple(min(x + y for x, y in zip(row, after, strict=True)) for row in matrix)


def _insertions() -> Matrix:
    """Cost of any number of insertions from state to state."""
    costs = [[FOREVER] * N_STATES for _ in range(N_STATES)]
    for begin in range(N_STATES):
        state = begin
        for n in range(N_STATES):
            costs[begin][state] = min(costs[begin][state], n * INSERT)
            state = inserted(state)[1]
    return tuple(map(tuple, costs))


INSERTIONS = _insertions()
#: Least cost of coming to an end from each state.
AT_END: Costs = applied(INSERTIONS, tuple(0 if s in ENDS else FOREVER for s in range(N_STATES)))
IDENTITY: Matrix = tuple(
    tuple(0 if i == j else FOREVER for j in range(N_STATES)) for i in range(N_STATES)
)


def bits(length: int) -> list[int]:
    """Powers of two that make up ``length``, largest first."""
    return [k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def normal(costs: Costs) -> Costs:
    """Only differences of costs matter."""
    least = min(costs)
    return tuple(c - least for c in costs)


class Runs:
    """Ways through runs of equal messages; what was found stays remembered, up to a number of entries."""

    def __init__(self):
        self.powers: dict[tuple[int, int], Matrix] = {}
        self.costs: dict[tuple[int, int, Costs], Costs] = {}
        self.steps: dict[tuple[int, int, int, Costs], tuple[str, int]] = {}

    def power(self, symbol: int, k: int) -> Matrix:
        """Least costs from state to state over 2**k equal messages, insertions before each included."""
        key = symbol, k
        if key not in self.powers:
            if k:
                half = self.power(symbol, k - 1)
                self.powers[key] = min_plus(half, half)
            else:
                costs = [[FOREVER] * N_STATES for _ in range(N_STATES)]
                for state in range(N_STATES):
                    for _, _, cost, to in edits(symbol, state):
                        costs[state][to] = min(costs[state][to], cost)
                self.powers[key] = min_plus(INSERTIONS, tuple(map(tuple, costs)))
        return self.powers[key]

    def before(self, symbol: int, length: int, after: Costs) -> Costs:
        """Least costs before a run, from those after it."""
        key = symbol, length, after
        if key not in self.costs:
            if len(self.costs) >= REMEMBERED:
                self.costs.clear()
            for k in reversed(bits(length)):
                after = normal(applied(self.power(symbol, k), after))
            self.costs[key] = after
        return self.costs[key]

    def matrix(self, runs: list[tuple[int, int]]) -> Matrix:
        total = IDENTITY
        for symbol, length in runs:
            for k in bits(length):
                total = min_plus(total, self.power(symbol, k))
        return total

    def unrolled(self, symbol: int, k: int, state: int, after: Costs) -> tuple[str, int]:
        """Codes of the steps over 2**k equal messages from ``state``, and the state they lead to.

        ``after`` are the least costs from each state after them. Of the cheapest letters the least
        in ASCII order come out: at each place the least that can still be completed at least cost.
        """
        key = symbol, k, state, after
        if key in self.steps:
            return self.steps[key]
        if k:
            middle = normal(applied(self.power(symbol, k - 1), after))
            first, between = self.unrolled(symbol, k - 1, state, middle)
            second, last = self.unrolled(symbol, k - 1, between, after)
            found = first + second, last
        else:
            found = self.one(symbol, state, after)
        if k <= CACHED_BITS:
            if len(self.steps) >= REMEMBERED:
                self.steps.clear()
            self.steps[key] = found
        return found

    def one(self, symbol: int, state: int, after: Costs) -> tuple[str, int]:
        best, before = applied(self.power(symbol, 0), after), ""
        while True:
            # D comes before I, and I before K and R.
            for letter, initial, cost, to in edits(symbol, state):
                if letter != "D" and best[state] == INSERT + best[inserted(state)[1]]:
                    break
                if best[state] == cost + after[to]:
                    return CODES[Step(before, letter, initial)], to
            initial, state = inserted(state)
            before += initial


def runs_state() -> Runs:
    return worker_state("conversation-runs", Runs)


def run_matrix(runs: list[tuple[int, int]]) -> Matrix:
    return runs_state().matrix(runs)


def unroll(runs: list[tuple[int, int]], state: int, after: Costs) -> tuple[str, int]:
    """Codes of the steps of a sequence of runs from ``state``, and the state they lead to."""
    known = runs_state()
    ends = [normal(after)]
    for symbol, length in reversed(runs):
        ends.append(known.before(symbol, length, ends[-1]))
    ends.pop()
    out = []
    for symbol, length in runs:
        vectors, parts = [ends.pop()], bits(length)
        for k in reversed(parts[1:]):
            vectors.append(normal(applied(known.power(symbol, k), vectors[-1])))
        for k in parts:
            codes, state = known.unrolled(symbol, k, state, vectors.pop())
            out.append(codes)
    return "".join(out), state


def tail(state: int) -> str:
    """Initials of the messages put in at the end."""
    out = ""
    while state not in ENDS:
        initial, state = inserted(state)
        out += initial
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """Test damage by crc32(``conv_id:turn``) % 20: rows lost, emptied, cut, repeated, relabelled.

    Nulls are one blank there and in role and text. ``copies`` is 2 for a repeated row.
    """
    blank = F.lit(" ")
    parts = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *parts).cast("binary")) % 20
    text = F.coalesce("text", blank)
    cut = F.regexp_replace(text, "[.!?]", "")
    return turns.filter(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, cut).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _ordered(turns: DataFrame, copies: str | None) -> DataFrame:
    """Distinct messages with the number of times each occurs, in order: ``id`` grows.

    The upper bits of ``id`` are the part of the table, so a conversation's messages are one
    stretch of a part or of several. Equal rows are one row, however many.
    """
    blank = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = ["conv_id", "turn", "role"]
    dealt = rows.repartitionByRange(*key, F.substring("text", 1, 64))
    dealt = dealt.sortWithinPartitions(*key, "text")
    end = F.rtrim("text", F.lit(SPACES))
    return stored(
        dealt.withColumns(
            {
                "id": F.monotonically_increasing_id(),
                "hash": F.md5(F.col("text").cast("binary")),
                "blank": end == "",
                "truncated": ~F.right(end, F.lit(1)).isin(".", "!", "?"),
            }
        ),
        "messages",
    )


def _symbols(messages: DataFrame) -> DataFrame:
    """(id, conv_id, initial, symbol, copies, blank, duplicate, truncated) without texts.

    ``blank``, ``duplicate`` and ``truncated`` are numbers of rows with that first fault.
    """
    light = messages.select("id", "conv_id", "role", "hash", "blank", "truncated", "copies")
    same = light.filter(~F.col("blank")).groupBy("conv_id", "role", "hash")
    same = same.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = same.select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), "first"
    )
    # The first of equal messages has no match, so only repeats are in the join's result twice.
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
    on = on & (F.col("hash") == F.col("h")) & (F.col("id") != F.col("first"))
    marked = light.join(same, on, "left")
    again = F.col("first").isNotNull() & ~F.col("blank")
    initial = F.substring("role", 1, 1)
    place = F.instr(F.lit(INITIALS), initial) - 1
    place = F.when((initial == "") | (place < 0), len(INITIALS)).otherwise(place)
    faulty = again | F.col("blank")
    symbol = F.when(faulty, GONE).otherwise(2 * place + F.col("truncated").cast("int"))
    zero = F.lit(0).cast("long")
    return marked.select(
        "id",
        "conv_id",
        initial.alias("initial"),
        symbol.cast("int").alias("symbol"),
        "copies",
        F.when(F.col("blank"), F.col("copies")).otherwise(zero).alias("blank"),
        F.when(F.col("blank"), zero)
        .when(again, F.col("copies"))
        .otherwise(F.col("copies") - 1)
        .alias("duplicate"),
        (~faulty & F.col("truncated")).cast("long").alias("truncated"),
    )


PART = "shiftright(id, 33)"
_BLOCK = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("first_id", pa.int64()), ("border", pa.bool_()),
     ("runs", pa.list_(pa.int64())), ("initials", pa.list_(pa.string())),
     ("matrix", pa.list_(pa.int64()))]
)
_BLOCK_KINDS = (
    "conv_id long, part long, first_id long, border boolean, runs array<long>, "
    "initials array<string>, matrix array<long>"
)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each (part, conversation); the columns begin with part and conv_id."""
    key, rows = None, []
    for some in slices(batches, ROWS):
        columns = [c.to_pylist() for c in some.columns]
        for k, group in groupby(zip(*columns, strict=True), lambda r: r[:2]):
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.extend(group)
    if rows:
        yield key, rows


def _blocks(symbols: DataFrame) -> DataFrame:
    """The runs of each conversation's stretch in a part, and of those at a part's ends their matrix."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def emitted(last: bool) -> list[list]:
            """A stretch is held back until it is known whether its part goes on."""
            out = [held.pop(0)] if held else []
            if out and last:
                out[0][3] = True
            for row in out:
                if row[3]:
                    pairs = zip(row[4][::2], row[4][1::2], strict=True)
                    row[6] = [c for line in run_matrix(list(pairs)) for c in line]
            return out

        ready, part = [], None
        for (now, conv), rows in _stretches(batches):
            ready += emitted(now != part)
            runs = [x for s, g in groupby(r[4] for r in rows) for x in (s, sum(1 for _ in g))]
            held.append([conv, now, rows[0][2], now != part, runs, [r[3] for r in rows], None])
            part = now
            if len(ready) >= ROWS:
                yield record_batch(_BLOCK, list(zip(*ready, strict=True)))
                ready = []
        ready += emitted(True)
        if ready:
            yield record_batch(_BLOCK, list(zip(*ready, strict=True)))

    part = F.expr(PART).alias("part")
    light = symbols.select(part, "conv_id", "id", "initial", "symbol")
    light = light.repartition("part").sortWithinPartitions("id")
    return stored(light.mapInArrow(collapse, _BLOCK_KINDS), "blocks")


_AFTER = pa.schema(
    [("c", pa.int64()), ("p", pa.int64()), ("after", pa.list_(pa.int64())), ("previous", pa.string()),
     ("is_first", pa.bool_()), ("is_last", pa.bool_())]
)
_AFTER_KINDS = (
    "c long, p long, after array<long>, previous string, is_first boolean, is_last boolean"
)


def _costs_after(borders: DataFrame) -> DataFrame:
    """Least costs after each stretch at the border of a part, from the matrices of those behind it.

    There are two such stretches a part at most, so a conversation brings 16 numbers per part.
    """

    def walk(rows: pa.Table) -> pa.Table:
        some, out = sorted(rows.to_pylist(), key=lambda r: r["part"]), []
        after: Costs = AT_END
        for n in range(len(some) - 1, -1, -1):
            r = some[n]
            previous = some[n - 1]["last_initial"] if n else None
            out.append((r["conv_id"], r["part"], after, previous, n == 0, n == len(some) - 1))
            flat = r["matrix"]
            matrix = tuple(tuple(flat[i : i + N_STATES]) for i in range(0, len(flat), N_STATES))
            after = normal(applied(matrix, after))
        return pa.Table.from_batches([record_batch(_AFTER, list(zip(*out, strict=True)))])

    light = borders.select("conv_id", "part", "matrix", F.expr("initials[size(initials) - 1]").alias("last_initial"))
    return light.groupBy("conv_id").applyInArrow(walk, _AFTER_KINDS)


def _same_block() -> Column:
    return F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def _entered(borders: DataFrame, after: DataFrame) -> DataFrame:
    """The state in which each stretch at a border is entered, beside the costs after it."""
    exits = pa.schema([*_AFTER, ("exits", pa.list_(pa.int64()))])
    starts = pa.schema([*_AFTER, ("state", pa.int64())])

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 64):
            rows = some.to_pylist()
            out = [
                [unroll(_pairs(r["runs"]), s, tuple(r["after"]))[1] for s in range(N_STATES)]
                for r in rows
            ]
            kept = [some.column(some.schema.get_field_index(f.name)) for f in _AFTER]
            yield record_batch(exits, [*kept, out])

    def walk(rows: pa.Table) -> pa.Table:
        state, out = NOTHING, []
        for r in sorted(rows.to_pylist(), key=lambda r: r["p"]):
            out.append([r[f.name] for f in _AFTER] + [state])
            state = r["exits"][state]
        return pa.Table.from_batches([record_batch(starts, list(zip(*out, strict=True)))])

    left = borders.select("conv_id", "part", "runs").join(after, _same_block())
    left = left.select("runs", *_AFTER.names)
    left = left.mapInArrow(leave, f"{_AFTER_KINDS}, exits array<long>")
    return left.groupBy("c").applyInArrow(walk, f"{_AFTER_KINDS}, state long")


_EDIT = pa.schema(
    [("id", pa.int64()), ("before", pa.string()), ("edit", pa.string()), ("initial", pa.string()),
     ("after", pa.string()), ("illegal", pa.int64())]
)


def _edits(blocks: DataFrame, entered: DataFrame) -> DataFrame:
    """One row per message: id, before, edit, initial, after, illegal (with the message before it)."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 64):
            out: list[tuple] = []
            for r in some.to_pylist():
                rest = tuple(r["after"]) if r["border"] else AT_END
                codes, state = unroll(_pairs(r["runs"]), r["state"] if r["border"] else NOTHING, rest)
                previous = r["previous"]
                for n, (code, initial) in enumerate(zip(codes, r["initials"], strict=True)):
                    step = STEPS[ord(code) - 65]
                    wrong = previous is not None and previous + initial not in LEGAL_PAIRS
                    out.append((r["first_id"] + n, *step, "", int(wrong)))
                    previous = initial
                if not r["border"] or r["is_last"]:
                    out[-1] = (*out[-1][:4], tail(state), out[-1][5])
            if out:
                yield record_batch(_EDIT, list(zip(*out, strict=True)))

    known = blocks.join(entered, _same_block(), "left")
    known = known.select("first_id", "border", "runs", "initials", "after", "previous", "is_last", "state")
    kinds = "id long, before string, edit string, initial string, after string, illegal long"
    return known.mapInArrow(choose, kinds)


def repair(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """One row per distinct message: what is edited, and the message afterwards.

    ``turns`` has conv_id, turn, role, text; ``copies`` names a column with the number of times a
    row stands there (default: once); other columns are not read. Columns of the result: conv_id, id (grows in the order of the
    messages), turn, old_role, text, copies, blank, duplicate, truncated (rows with that first
    fault), illegal (neighbours, the one before included, whose role initials are not su, ua or au),
    before (initials of empty messages put in before it), edit (K, R or D), role (afterwards; null if
    deleted), after (initials put in at the end), cost. Further copies of a message are deleted, which
    ``edit`` does not show and ``cost`` holds.

    Messages of a conversation are ordered by turn (nulls first), then role and text. Null role
    and text are one blank; a null conv_id is a conversation; an empty role fits nowhere. A blank
    message (nothing but white space) and one whose role and text stood before have to go. Any other
    is kept, relabelled as user or assistant, or deleted, and empty messages may be put in, so that role
    initials give ``(s?(ua)+)?``. Of the cheapest repairs that with the least letters in ASCII order
    is chosen. An empty table gives an empty result.

    A conversation may hold most of all rows: rows are dealt by ranges, so it spreads over parts. In
    a part, equal neighbours among the symbols (initial, fault) are one run. A run is passed by binary
    powers of its 4 x 4 (min, plus) matrix. Where a conversation goes on in the next part, the
    matrices of its stretches give the costs at the borders, and the states at which borders are crossed
    follow from the choices of each stretch.
    """
    messages = _ordered(turns, copies)
    symbols = stored(_symbols(messages), "symbols")
    blocks = _blocks(symbols)
    borders = blocks.filter("border")
    after = stored(_costs_after(borders), "costs")
    entered = stored(_entered(borders, after), "entered")
    chosen = _edits(blocks, entered)
    faults = symbols.select("id", "blank", "duplicate", F.col("truncated").alias("cut"))
    rows = messages.select("conv_id", "id", "turn", "role", "text", "copies")
    rows = rows.join(faults, "id").join(chosen, "id")
    extra = F.col("copies") - 1
    stays = F.col("edit") != "D"
    cost = (
        F.length("before") * INSERT
        + F.length("after") * INSERT
        + F.when(F.col("edit") == "R", RELABEL).when(stays, 0).otherwise(DELETE)
        + F.when(stays, F.col("cut") * TRUNCATED).otherwise(0)
        + extra * DELETE
    )
    named = F.when(F.col("initial") == "u", NAMES["u"]).otherwise(NAMES["a"])
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") == "R", named)
    return rows.select(
        "conv_id", "id", "turn", F.col("role").alias("old_role"), "text", "copies", "blank",
        "duplicate", F.col("cut").alias("truncated"), (F.col("illegal") + extra).alias("illegal"),
        "before", "edit", role.alias("role"), "after", cost.cast("long").alias("cost"),
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_REPORT = pa.schema(
    [("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()),
     ("repaired_sha256", pa.string())]
)


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair`'s result: sums, all edits, hash of what came out.

    ``audit`` has the letters in order, I for a message put in. ``repaired_sha256`` is that of the
    ``role:text`` lines of the repaired conversation. A hash needs its texts in order, so a task goes
    through the sorted rows of a conversation one by one and keeps the hash and the letters only.
    """
    wanted = ["conv_id", "id", *COUNTS, "copies", "before", "edit", "role", "after", "text"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        conv, open_ = None, False
        totals, letters, lines, digest = [0] * len(COUNTS), [], 0, hashlib.sha256()

        def line(text: str) -> None:
            nonlocal lines
            digest.update((f"\n{text}" if lines else text).encode())
            lines += 1

        for some in slices(batches, 256):
            columns = [c.to_pylist() for c in some.columns]
            for row in zip(*columns, strict=True):
                if not open_ or row[0] != conv:
                    if open_:
                        ready.append((conv, *totals, "".join(letters), digest.hexdigest()))
                    conv, open_ = row[0], True
                    totals, letters, lines, digest = [0] * len(COUNTS), [], 0, hashlib.sha256()
                totals = [a + b for a, b in zip(totals, row[2:], strict=False)]
                copies, before, edit, role, after, text = row[2 + len(COUNTS) :]
                for initial in before:
                    line(f"{NAMES[initial]}:")
                if edit != "D":
                    line(f"{role}:{text}")
                for initial in after:
                    line(f"{NAMES[initial]}:")
                letters.append(f"{'I' * len(before)}{edit}{'D' * (copies - 1)}{'I' * len(after)}")
            if len(ready) >= ROWS:
                yield record_batch(_REPORT, list(zip(*ready, strict=True)))
                ready = []
        if open_:
            ready.append((conv, *totals, "".join(letters), digest.hexdigest()))
        if ready:
            yield record_batch(_REPORT, list(zip(*ready, strict=True)))

    sorted_ = repaired.select(*wanted).repartition("conv_id").sortWithinPartitions("conv_id", "id")
    kinds = ", ".join(f"{c} long" for c in ("conv_id", *COUNTS))
    return sorted_.mapInArrow(summed, f"{kinds}, audit string, repaired_sha256 string")


def gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): turns missing between a conversation's first and last; nulls do not count."""
    each = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"))
    one = each.agg(F.lit(1).alias("_one")).groupBy("conv_id")
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return one.agg(F.coalesce(span, F.lit(0).cast("long")).alias("gaps"))


def report(turns: DataFrame, conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """One row per conv_id of ``conversations``: gaps, fault counts, cost, audit and hash of the repair.

    A conversation without messages in ``turns`` has zeros, an empty audit and the hash of nothing.
    """
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = every.unionByName(gaps(turns), allowMissingColumns=True)
    found = found.unionByName(digests(repair(turns, copies)), allowMissingColumns=True)
    nothing = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0).cast("long")
    return found.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), zero).alias(c) for c in ("gaps", *COUNTS)],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"),
    )
