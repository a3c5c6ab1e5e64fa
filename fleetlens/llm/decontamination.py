"""Benchmark decontamination by templates: numbers, names and units are slots, the rest must match."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.common import record_batch, slices, worker_state

#: Words of a template window, and the share of an item's windows that a document must hold.
WINDOW, SHARE = 8, 0.5
#: Words of an item that contaminate, whatever their share, when they stand in a row unchanged.
RUN = 13
#: Benchmark windows that are looked up at a time; more go over the documents in more passes.
WINDOWS_AT_ONCE = 1_000_000
# Unit words (in lower case) that a template replaces.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour "
    "hours day days week weeks month months year years cent cents dollar dollars euro euros usd "
    "eur percent degree degrees meter meters metre metres gram grams kilogram kilograms"
).split()
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?")
EDGES = re.compile(r"^\W+|\W+$")
#: Slot kinds; a plain word has kind 0.
PLAIN, NUM, UNIT, NAME = range(4)


LINE = "\x00"
MARKS, ENDS = frozenset(".,;:!?"), frozenset(".!?:|")


class Canonical(dict):
    """Number of each word, with what a template needs to know of it, remembered up to a bound."""

    MOST = 200_000

    def __init__(self):
        self.units = frozenset(UNITS)
        self.slot_ids = np.array([xxhash.xxh64_intdigest(f"\x00{k}") for k in range(4)], np.uint64)
        self.ids, self.values = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.kinds, self.capital, self.ends = (np.zeros(1024, t) for t in (np.int8, bool, bool))

    def __missing__(self, word: str) -> int:
        """Notes template id, kind, value, whether it may be a name, and whether it ends a sentence."""
        i = self[word] = len(self)
        if i == len(self.ids):
            for name in ("ids", "values", "kinds", "capital", "ends"):
                setattr(self, name, np.concatenate([getattr(self, name)] * 2))
        plain, end = word, word[-1:]
        if not word.isalpha() and end in MARKS:
            plain = word[:-1]
        if plain.isalpha():  # most words: letters, and a mark at most
            core, letters = plain, True
        else:
            core, letters = "" if word == LINE else EDGES.sub("", word), False
            end = word.rstrip("\"')]»”’")[-1:]
        self.capital[i] = self.kinds[i] = self.values[i] = 0
        self.ends[i] = word == LINE or end in ENDS
        if core:
            low = core.lower()
            self.ids[i] = self.values[i] = xxhash.xxh64_intdigest(low) or 1
            if not letters and NUMBER.fullmatch(core):
                self.kinds[i] = NUM
            elif low in self.units:
                self.kinds[i] = UNIT
            else:
                self.capital[i] = core[0].isupper() and not core.isupper()
            if self.kinds[i]:
                self.ids[i] = self.slot_ids[self.kinds[i]]
        return i

    def text(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template ids, kinds and values of a text's words; words without a core are left out.

        A name is a capitalised word inside a sentence; at the start of one, or of a line, the
        capital says nothing and the word counts as it is.
        """
        if len(self) > self.MOST:
            self.clear()
        words = text.replace(LINE, " ").replace("\n", f" {LINE} ").split()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        values = self.values[at]
        ends = self.ends[at]
        name = self.capital[at]
        name[:1] = False
        name[1:] &= ~ends[:-1]
        ids, kinds = np.where(name, self.slot_ids[NAME], self.ids[at]), self.kinds[at]
        kinds[name] = NAME
        kept = values != 0
        return ids[kept], kinds[kept], values[kept]


MIX = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(64)], dtype=np.uint64)


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` template ids."""
    n = len(ids) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    mixed = ids ^ (ids >> np.uint64(29))
    total = mixed[:n] * MIX[0]
    for j in range(1, size):
        total += mixed[j : j + n] * MIX[j]
    return (total ^ (total >> np.uint64(32))) * MIX[63]


def consistent(kinds, values, other_kinds, other_values) -> bool:
    """Whether equal slots of one side are equal on the other, one to one, within each kind."""
    there: dict[tuple, int] = {}
    back: dict[tuple, int] = {}
    rows = (kinds.tolist(), values.tolist(), other_kinds.tolist(), other_values.tolist())
    for kind, value, other_kind, other in zip(*rows, strict=True):
        if kind != other_kind:
            return False
        if kind == PLAIN:
            if value != other:
                return False
        elif there.setdefault((kind, value), other) != other or back.setdefault(
            (kind, other), value
        ) != value:
            return False
    return True


def longest_run(same: np.ndarray) -> int:
    """Length of the longest run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


class Index:
    """Windows of some benchmark items: sorted hashes with item and position, and a bit filter."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        canonical = Canonical()
        self.items = {}
        keys, owners, places = [], [], []
        for number, (item_id, text) in enumerate(items):
            ids, kinds, values = canonical.text(text or "")
            if not len(ids):
                continue
            # An item shorter than a window is one window of its own length.
            width = min(size, len(ids))
            self.items[number] = (item_id, kinds, values, width)
            found = windows(ids, width)
            keys.append(found)
            owners.append(np.full(len(found), number))
            places.append(np.arange(len(found)))
        self.widths = sorted({x[3] for x in self.items.values()})
        keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owners = np.concatenate(owners)[order] if len(keys) else keys
        self.places = np.concatenate(places)[order] if len(keys) else keys
        self.bits = np.zeros(1 << 24, bool)
        self.bits[(self.keys >> np.uint64(40)).astype(np.int64)] = True

    def matches(self, text: str, canonical: Canonical, share: float, run: int) -> list[tuple]:
        """(item_id, windows found, windows of the item, slots differ) of contaminating items."""
        ids, kinds, values = canonical.text(text)
        held: dict[int, dict[int, list[int]]] = {}
        for width in self.widths:
            hashes = windows(ids, width)
            if not len(hashes):
                continue
            places = np.flatnonzero(self.bits[(hashes >> np.uint64(40)).astype(np.int64)])
            if not len(places):
                continue
            first = np.searchsorted(self.keys, hashes[places], "left")
            last = np.searchsorted(self.keys, hashes[places], "right")
            for at, a, b in zip(places.tolist(), first.tolist(), last.tolist(), strict=True):
                for i in range(a, b):
                    number, place = int(self.owners[i]), int(self.places[i])
                    if self.items[number][3] == width:
                        held.setdefault(number, {}).setdefault(at - place, []).append(place)
        out = []
        for number, lines in held.items():
            item_id, item_kinds, item_values, width = self.items[number]
            total = len(item_kinds) - width + 1
            # Pieces of an item may stand apart, so windows count over all shifts that hold
            # their slots; each shift is checked by itself. Where slots disagree, windows
            # without any changed value still count.
            good: set[int] = set()
            differ, longest = False, 0
            for shift, found in lines.items():
                covered = np.unique(np.concatenate([np.arange(p, p + width) for p in set(found)]))
                here = covered + shift
                same = np.zeros(len(item_kinds), bool)
                same[covered] = item_values[covered] == values[here]
                longest = max(longest, longest_run(same))
                if consistent(
                    item_kinds[covered], item_values[covered], kinds[here], values[here]
                ):
                    good.update(found)
                    differ |= not same[covered].all()
                else:
                    good.update(p for p in found if same[p : p + width].all())
            if good and (len(good) >= share * total or longest >= run):
                out.append((item_id, len(good), total, differ))
        return sorted(out)


def _blocks(
    docs: DataFrame, benchmark: DataFrame, window: int, windows_at_once: int
) -> list[Callable[[], tuple[Index, Canonical]]]:
    """What loads each block of the benchmark in a task; a block is broadcast as texts."""
    items = benchmark.filter(F.trim("text") != "").filter("item_id is not null")
    items = items.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    # A word takes two characters or more, so a block has no more windows than asked for, about.
    blocks = 1 + int(size) // (2 * windows_at_once)
    found = []
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        some = sorted((r["item_id"], r["text"]) for r in mine.collect())
        shared = docs.sparkSession.sparkContext.broadcast(some)
        key = ("benchmark", xxhash.xxh64_hexdigest(repr(some)), window)

        def load(shared=shared, key=key) -> tuple[Index, Canonical]:
            return worker_state(key, lambda: (Index(shared.value, window), Canonical()))

        found.append(load)
    return found


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    share: float = SHARE,
    run: int = RUN,
    windows_at_once: int = WINDOWS_AT_ONCE,
) -> DataFrame:
    """Pairs of documents and benchmark items they hold: doc_id, item_id, n_windows, n_item_windows,
    reparameterised.

    Both sides become templates: numbers, units and names (capitalised inside a sentence) are
    slots, other words are in lower case without marks at their ends. Windows of ``window``
    template words are joined by hash. For each alignment that windows propose, slots must agree
    one to one (equal values in the item stand where equal values stand in the document), else
    only its windows without any changed value count. A pair is returned when windows that count
    are at least ``share`` of the item's, or when ``run`` words of the item stand in a row with
    the same values. ``reparameterised`` tells that a slot has another value.

    The benchmark is the query set: it is read in blocks of at most about ``windows_at_once``
    windows, each broadcast and looked up in one pass over the documents. Null or empty texts
    match nothing; items of fewer words than a window are one window; items without id are not
    searched for. Equal items are found each; repeated documents give repeated rows. No items give
    no rows. Other columns are not read.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()),
         ("n_item_windows", pa.int64()), ("reparameterised", pa.bool_())]
    )
    kinds = "doc_id long, item_id long, n_windows long, n_item_windows long, reparameterised boolean"
    rows = docs.select("doc_id", "text")

    def look_up(load):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, canonical = load()
            for part in slices(batches):
                out = []
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if text:
                        out += [(doc_id, *m) for m in index.matches(text, canonical, share, run)]
                if out:
                    yield record_batch(schema, list(zip(*out, strict=True)))

        return find

    found = None
    for load in _blocks(docs, benchmark, window, windows_at_once):
        pairs = rows.mapInArrow(look_up(load), kinds)
        found = pairs if found is None else found.unionByName(pairs)
    return found


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    share: float = SHARE,
    run: int = RUN,
    windows_at_once: int = WINDOWS_AT_ONCE,
) -> DataFrame:
    """The rows of ``docs``, with all columns, that :func:`contaminated` finds no item in."""
    at = docs.columns.index("text")

    def look_up(load):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, canonical = load()
            for part in slices(batches):
                texts = part.column(at).to_pylist()
                kept = [not (x and index.matches(x, canonical, share, run)) for x in texts]
                yield part.filter(pa.array(kept, pa.bool_()))

        return find

    for load in _blocks(docs, benchmark, window, windows_at_once):
        docs = docs.mapInArrow(look_up(load), docs.schema)
    return docs
