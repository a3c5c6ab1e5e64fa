"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A text is one query with all its words, wherever they stand, and an example is the whole text of a
labelled row. A few words among hundreds hardly change a plain cosine, so in texts of over ``WINDOW``
words a term that speaks for toxic labels weighs more, by the root of the number of words
(:func:`stretch`); its share of the vector then does not fade in long texts.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.common import drop_states, record_batch, slices, stored, text_slices, worker_state
from fleetlens.operators.ranking import top_per_group

#: Bounds of the sample of labelled rows, per class; neighbours that vote.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_000, 2_000
NEIGHBOURS, BLOCK = 25, 512
#: Blocks at most; with more examples the blocks are larger.
MOST_BLOCKS = 8
#: Terms with the longest lists, whose weights are a matrix; the others are lists in blocks.
HEAD = 2048
#: Terms of all examples together; of a sample with more, the longest texts are no examples.
MOST_POSTINGS = 4_000_000
#: Frequent terms whose presence orders the examples, so that like ones share blocks.
ORDER_TERMS = 24
PREFIXES = range(4, 9)
#: Vote of the base rate, in neighbours of similarity 1.
PRIOR_VOTE = 0.01
#: Words of a text that is compared plainly, and how fast telling terms gain in longer ones.
WINDOW, STRETCH = 16, 0.5
#: Passages of ``WINDOW`` words shown of a text, and the score from which on they are.
WINDOWS, SHOWN = 3, 0.5
#: Bytes of text that are worked on at a time.
TEXT_BYTES, ROWS = 4 << 20, 1024
#: Texts that are compared at a time.
TEXTS = 256
#: Lots of labelled rows from which the sample is chosen.
DEALT = 16
#: Standard errors a term's log odds lose, and terms kept whose rest is above 0 (the greatest).
ERRORS, TELLING, LONGEST = 3.0, 50_000, 64
#: ASCII characters that are neither letter nor digit.
MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SHINGLE = 5


def word_terms(word: str) -> list[str]:
    """The word in lower case without marks at its ends, and its beginnings as ``abc-``."""
    core = EDGES.sub("", word.lower())
    if not core:
        return []
    return [core, *(f"{core[:n]}-" for n in PREFIXES if len(core) >= n)]


def sketch(words: list[str]) -> int:
    """Least hash of the runs of five words: near copies mostly share it."""
    runs = range(max(1, len(words) - SHINGLE + 1))
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + SHINGLE])) >> 1 for i in runs)


def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term) >> 1


@lru_cache(100_000)
def prefix_hash(prefix: str) -> int:
    return term_hash(f"{prefix}-")


def core_of(word: str) -> str:
    core = word.lower()
    return core if core.isalnum() else EDGES.sub("", core)


def term_name(term: str) -> str:
    """The term, or a digest of a term with a word of over ``LONGEST`` letters."""
    return term if len(term) <= LONGEST else f"{xxhash.xxh3_128_hexdigest(term)}\0"


def word_hashes(word: str) -> list[int]:
    """Hashes of :func:`word_terms`; those of beginnings are remembered, a bounded number of them."""
    core = core_of(word)
    if not core:
        return []
    longest = min(len(core), PREFIXES[-1])
    return [term_hash(core), *[prefix_hash(core[:n]) for n in range(PREFIXES[0], longest + 1)]]


def stretch(words: np.ndarray | int) -> np.ndarray:
    """What a telling term gains, per unit that it speaks for toxic, in a text of so many words."""
    return STRETCH * np.maximum(np.sqrt(np.maximum(words, 1) / WINDOW) - 1, 0)


def telling_terms(sample: DataFrame, sizes: dict[int, int]) -> dict[str, float]:
    """The terms that speak for toxic (``abc-`` is a beginning), and how much each does.

    That is the logarithm of the ratio of its shares of toxic and of clean texts of the sample, less
    ``ERRORS`` standard errors, where above 0. Counted in tasks, summed by Spark. Words of over
    ``LONGEST`` letters do not count, so what reaches the driver is bounded.
    """
    schema = pa.schema([("term", pa.string()), ("label", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush() -> Iterator[pa.RecordBatch]:
            for label, some in held.items():
                yield record_batch(schema, [list(some), [label] * len(some), list(some.values())])
                some.clear()

        for part in slices(batches, 64):
            for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = {w for w in text.split() if len(w) <= LONGEST}
                held[label].update({t for w in words for t in word_terms(w)})
                if len(held[0]) + len(held[1]) > 200_000:
                    yield from flush()
        yield from flush()

    found = sample.select("_label", "_text").mapInArrow(count, "term string, label int, n long")
    toxic, clean = (
        F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)) + 0.5 for k in (1, 0)
    )
    odds = F.log(F.col("_toxic") / (sizes[1] + 1)) - F.log(F.col("_clean") / (sizes[0] + 1))
    less = ERRORS * F.sqrt(1 / F.col("_toxic") + 1 / F.col("_clean"))
    rated = found.groupBy("term").agg(toxic.alias("_toxic"), clean.alias("_clean"))
    rated = rated.select("term", (odds - less).alias("value")).filter("value > 0")
    return dict(map(tuple, rated.orderBy(F.desc("value"), "term").limit(TELLING).collect()))


class Weights:
    """How much a word speaks for toxic: the most of its terms, found by growing beginnings."""

    def __init__(self, telling: dict[str, float]):
        self.words = {t: v for t, v in telling.items() if not t.endswith("-")}
        self.starts = {t[:-1]: v for t, v in telling.items() if t.endswith("-")}
        for term in [*self.words, *self.starts]:
            for n in range(PREFIXES[0], min(len(term), PREFIXES[-1]) + 1):
                self.starts.setdefault(term[:n], 0.0)

    def __call__(self, word: str) -> float:
        core, most = core_of(word), 0.0
        for n in range(PREFIXES[0], min(len(core), PREFIXES[-1]) + 1):
            value = self.starts.get(core[:n])
            if value is None:
                return most
            most = max(most, value)
        return max(most, self.words.get(core, 0.0))


def document_counts(docs: DataFrame, terms: np.ndarray, names: pa.Array) -> tuple[int, np.ndarray]:
    """Rows with text and, per term of the examples, those that hold it, over all of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, names))
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])
    size = len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_states()  # an earlier model, so that a worker never holds two
        terms, names = shared.value
        finder = TermFinder(terms, names=names)
        total = np.zeros(size + 1, np.int64)
        for part in text_slices(batches, 0, ROWS, TEXT_BYTES):
            total[-1] += part.num_rows
            np.add.at(total, finder.batch(part.column(0))[0], 1)
        at = np.flatnonzero(total)
        yield record_batch(schema, [at, total[at]])

    rows = docs.filter(F.col("text").isNotNull()).select("text")
    counts = rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = np.zeros(size + 1, np.int64)
    got = counts.toArrow()
    found[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return int(found[-1]), found[:-1]


class TermFinder:
    """Terms of words that the examples have, and the passages of a text that say most.

    ``terms`` (sorted hashes) hold every beginning of a word that they hold, so a word's search ends at
    the first beginning they lack. Words seen before are remembered up to a number of bytes.
    """

    MOST_BYTES = 48 << 20

    def __init__(
        self, terms: np.ndarray, telling: dict[str, float] | None = None, names: pa.Array | None = None
    ):
        self.terms, self.weight = terms, Weights(telling or {})
        self.names = pa.array([], pa.string()) if names is None else names
        self.known, self.marks, self.starts, self.held = {}, {}, {}, 0

    def room(self, new: list[str]) -> None:
        self.held += sum(map(len, new)) + 200 * len(new)

    def age(self) -> None:
        if self.held > self.MOST_BYTES:
            self.known.clear()
            self.marks.clear()
            self.starts.clear()
            self.held = 0

    def find(self, term: int) -> int:
        at = int(self.terms.searchsorted(term))
        return at if at < len(self.terms) and self.terms[at] == term else -1

    def learn(self, words: list[str]) -> None:
        starts, first, last = self.starts, PREFIXES[0], PREFIXES[-1]
        for word in words:
            core, found = core_of(word), []
            for n in range(first, min(len(core), last) + 1):
                start = core[:n]
                at = starts.get(start)
                if at is None:
                    at = starts[start] = self.find(term_hash(f"{start}-"))
                    self.held += 150
                if at < 0:
                    break
                found.append(at)
            else:
                if core and (at := self.find(term_hash(core))) >= 0:
                    found.append(at)
            self.known[word] = tuple(found)
        self.room(words)

    def weigh(self, words: list[str]) -> None:
        """Remembers each word's mark: millionths it speaks for toxic, then its letters."""
        weight = self.weight
        self.marks.update({w: round(weight(w) * 1e6) * 1000 + min(len(w), 60) for w in words})
        self.room(words)

    def windows(self, text: str) -> list[tuple[list[str], bool]]:
        """The heaviest windows, heaviest first; ties to the longer words, then to the first.

        With each, whether it is the first or has a word that speaks for toxic.
        """
        words = text.split()
        if len(words) <= WINDOW:
            return [(words, True)]
        self.age()
        if new := list(set(words).difference(self.marks)):
            self.weigh(new)
        marks = np.fromiter(map(self.marks.__getitem__, words), np.int64, len(words))
        total = np.cumsum(marks)
        heavy = total[WINDOW - 1 :].copy()
        heavy[1:] -= total[:-WINDOW]
        found = []
        for _ in range(WINDOWS):
            i = int(np.argmax(heavy))
            if heavy[i] < 0:
                break
            found.append((words[i : i + WINDOW], not found or bool(heavy[i] >= 1000)))
            heavy[max(0, i - WINDOW + 1) : i + WINDOW] = -1
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the text's terms, ascending, and how often each is there."""
        return self.counts(text.split())

    def counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.age()
        known, words = self.known, Counter(words)
        if new := [w for w in words if w not in known]:
            self.learn(new)
        lists = list(map(known.__getitem__, words))
        flat = np.fromiter(chain.from_iterable(lists), np.int64)
        each = np.fromiter(words.values(), np.int64, len(words))
        times = np.repeat(each, np.fromiter(map(len, lists), np.int64, len(lists)))
        terms, place = np.unique(flat, return_inverse=True)
        return terms, np.bincount(place, times, minlength=len(terms)).astype(np.int64)


    def terms_of_each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known terms of each word, one word after another, and how many they are.

        As :meth:`learn` finds them, for many words at once: Arrow looks up all cores and beginnings.
        """
        ascii = pc.string_is_ascii(words)
        cores = pc.ascii_trim(pc.ascii_lower(words), MARKS)
        if other := [core_of(w) for w in words.filter(pc.invert(ascii)).to_pylist()]:
            cores = pc.replace_with_mask(cores, pc.invert(ascii), pa.array(other, pa.string()))
        encoded = cores.dictionary_encode()
        cores, which = encoded.dictionary, encoded.indices.to_numpy()
        length = pc.utf8_length(cores).to_numpy()
        long = np.flatnonzero(length > LONGEST)
        names, owners = [cores], [(np.arange(len(cores)), np.arange(len(cores)))]
        if len(long):
            digests = [term_name(w) for w in cores.take(pa.array(long)).to_pylist()]
            names = [pc.replace_with_mask(cores, pa.array(length > LONGEST), pa.array(digests, pa.string()))]
        # From the longest beginnings on, so that each one is cut from those before, once.
        starts, at, which_start, found = cores.slice(0, 0), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for n in reversed(PREFIXES):
            more = np.flatnonzero(length == n if found else length >= n)
            cut = pc.utf8_slice_codeunits(pa.concat_arrays([starts, cores.take(pa.array(more))]), 0, n)
            encoded = cut.dictionary_encode()
            each = encoded.indices.to_numpy()
            which_start = np.concatenate([each[which_start], each[len(starts) :]])
            at, starts = np.concatenate([at, more]), encoded.dictionary
            found.append((pc.binary_join_element_wise(starts, "-", ""), (at, which_start)))
        for name, owner in reversed(found):
            names.append(name)
            owners.append(owner)
        every = pc.fill_null(pc.index_in(pa.concat_arrays(names), value_set=self.names), -1).to_numpy()
        ends = np.cumsum([len(x) for x in names])
        found = np.concatenate([every[end - len(x) : end][at] for end, x, (_, at) in zip(ends, names, owners, strict=True)])
        owner = np.concatenate([at for at, _ in owners])[found >= 0]
        order = np.argsort(owner, kind="stable")
        flat, sizes = found[found >= 0][order].astype(np.int64), np.bincount(owner, minlength=len(cores))
        last = np.cumsum(sizes)[which]
        return flat[spans(last - sizes[which], last)], sizes[which]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every text (null: empty) all terms, ascending, and how often each is there.

        Both one text after another, then the numbers of terms and of words of each text.
        """
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        size = np.diff(lists.offsets.to_numpy())
        encoded = lists.flatten().dictionary_encode()
        words = encoded.dictionary
        # A text's place in the batch and a word's number are one key; then the same with its terms.
        key = np.repeat(np.arange(len(size)), size) * len(words) + encoded.indices.to_numpy()
        key, times = np.unique(key, return_counts=True)
        owner, word = np.divmod(key, max(1, len(words)))
        filled = pc.binary_length(words).to_numpy() > 0
        n_words = np.bincount(owner, times * filled[word], minlength=len(size)).astype(np.int64)

        flat, sizes = self.terms_of_each(words)
        last = np.cumsum(sizes)[word]
        each = sizes[word]
        key = np.repeat(owner, each) * len(self.terms) + flat[spans(last - each, last)]
        order = np.argsort(key)
        key, times = key[order], np.repeat(times, each)[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times, first) if len(first) else times
        owner, terms = np.divmod(key[first], max(1, len(self.terms)))
        return terms, times, np.bincount(owner, minlength=len(size)), n_words


def spans(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each begin up to its end, one range after another."""
    sizes = ends - begins
    shift = np.cumsum(sizes) - sizes
    out = np.repeat(begins - shift, sizes)
    out += np.arange(len(out))
    return out


@dataclass
class Model:
    """Examples with distinct vectors, in blocks, and what turns votes into scores.

    Weights are made from the counts where they are needed, so that little is sent.
    """

    terms: np.ndarray  # sorted hashes
    names: pa.Array  # what a text's terms are found by, in the same order
    idf: np.ndarray
    base_rate: float
    empty_rate: float
    votes: np.ndarray  # per example: weight of toxic and of clean labelled rows
    ids: list[int]  # per example: smallest doc_id of those rows
    begins: np.ndarray  # per term: where its list begins in ``at`` and ``weight``; and the end
    at: np.ndarray  # examples, ascending in each list
    times: np.ndarray  # how often the example has the term
    telling: dict[str, float]  # terms that speak for toxic, and how much
    speaks: np.ndarray  # the same per term, 0 for the others
    words: np.ndarray  # per example: words of the text
    slope: float = 1.0
    offset: float = 0.0

    @property
    def postings(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per term: examples, weights."""
        if "weight" not in self.__dict__:
            self.prepare()
        bounds = zip(self.begins[:-1].tolist(), self.begins[1:].tolist(), strict=True)
        return [(self.at[a:b], self.weight[a:b]) for a, b in bounds]

    def share(self, docs: DataFrame) -> Model:
        """Sends the lists to the executors, once; calibration does not change them."""
        self.name = uuid.uuid4().hex
        self.shared = docs.sparkSession.sparkContext.broadcast(dict(self.__dict__))
        return self

    def loader(self):
        """What gives a task the model and its term finder."""
        name, shared, slope, offset = self.name, self.shared, self.slope, self.offset

        def make():
            kept = Model.__new__(Model)
            kept.__dict__.update(shared.value)
            return kept, TermFinder(kept.terms, kept.telling, kept.names)

        def load():
            state = worker_state(("toxicity", name), make)
            state[0].slope, state[0].offset = slope, offset
            return state

        return load

    def prepare(self) -> Model:
        """Weights, and of each list, per block, the greatest weight and where its part begins."""
        self.at = self.at.astype(np.int32)
        self.weight = np.repeat(self.idf, np.diff(self.begins)) * (1 + np.log(self.times.astype(float)))
        spoken = np.flatnonzero(np.repeat(self.speaks, np.diff(self.begins)))
        speaks = np.repeat(self.speaks, np.diff(self.begins))[spoken]
        self.weight[spoken] *= 1 + stretch(self.words)[self.at[spoken]] * speaks
        square = np.bincount(self.at, self.weight * self.weight, minlength=len(self.ids))
        self.weight /= np.sqrt(square)[self.at]
        self.block = max(BLOCK, -(-len(self.ids) // MOST_BLOCKS))
        blocks = max(1, -(-len(self.ids) // self.block))
        place = np.repeat(np.arange(len(self.terms)) * blocks, np.diff(self.begins)) + self.at // self.block
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        most = np.zeros(len(self.terms) * blocks, np.float32)
        if len(starts):
            # Rounded up, so that a bound is never too small.
            greatest = np.maximum.reduceat(self.weight, starts).astype(np.float32)
            most[place[starts]] = np.nextafter(greatest, np.float32(np.inf))
        self.most = most.reshape(-1, blocks)
        self.part_begins = np.searchsorted(place, np.arange(len(most) + 1)).astype(np.int32)
        longest = np.argsort(-np.diff(self.begins), kind="stable")[:HEAD]
        self.row = np.full(len(self.terms), -1)
        self.row[longest] = np.arange(len(longest))
        self.head = np.zeros((len(longest), len(self.ids)))
        for row, term in enumerate(longest.tolist()):
            places = slice(self.begins[term], self.begins[term + 1])
            self.head[row, self.at[places]] = self.weight[places]
        return self

    def vector(self, counts: dict[int, int], words: int = 0) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        times = np.array([counts[t] for t in terms.tolist()], np.int64)
        return terms, self.weights(terms, times, np.array([len(terms)]), np.array([words]))

    def weights(
        self, terms: np.ndarray, times: np.ndarray, sizes: np.ndarray, words: np.ndarray
    ) -> np.ndarray:
        """Of texts one after another, with ``sizes`` terms and ``words`` words; each of norm 1."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        weights = self.idf[terms] * (1 + np.log(times))
        weights *= 1 + stretch(words)[owner] * self.speaks[terms]
        square = np.bincount(owner, weights * weights, minlength=len(sizes))
        return weights / np.sqrt(square)[owner]

    def nearest(
        self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS
    ) -> list[tuple[float, int]]:
        return self.nearest_of_each(terms, weights, np.array([len(terms)]), k)[0]

    def nearest_of_each(
        self, terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int = NEIGHBOURS
    ) -> list[list[tuple[float, int]]]:
        """Per text the ``k`` examples of greatest cosine above 0, exactly; ties by number.

        What the terms with the longest lists give is one product of matrices for ``TEXTS`` texts at a time.
        """
        if "head" not in self.__dict__:
            self.prepare()
        if len(sizes) > TEXTS:
            ends = np.cumsum(sizes)[TEXTS - 1 :: TEXTS]
            parts = (np.split(x, ends) for x in (terms, weights))
            some = (sizes[i : i + TEXTS] for i in range(0, len(sizes), TEXTS))
            return [x for one in zip(*parts, some, strict=False) for x in self.nearest_of_each(*one, k)]
        row, owner = self.row[terms], np.repeat(np.arange(len(sizes)), sizes)
        head, tail = row >= 0, np.flatnonzero(row < 0)
        own = np.zeros((len(sizes), len(self.head)))
        own[owner[head], row[head]] = weights[head]
        begun = own @ self.head
        ends = np.searchsorted(owner[tail], np.arange(len(sizes) + 1))
        limits = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        rest, weights = terms[tail], weights[tail]
        return [
            self.search(rest[a:b], weights[a:b], score, k)
            for (a, b), score in zip(limits, begun, strict=True)
        ]

    def search(
        self, terms: np.ndarray, weights: np.ndarray, score: np.ndarray, k: int
    ) -> list[tuple[float, int]]:
        """:meth:`nearest` where ``score`` has what other terms give each example.

        No score falls when the lists are added, so the k-th best of ``score`` is a floor. Blocks in which
        no example can reach it stay closed; the parts of the lists in all others are added at once.
        """
        if not len(score):
            return []
        floor = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0.0
        bound = np.maximum.reduceat(score, np.arange(0, len(score), self.block))
        bound = bound + weights @ self.most[terms]
        opened = np.flatnonzero(bound >= floor - 1e-11)
        if len(opened) == len(bound):
            begins, ends = self.begins[terms], self.begins[terms + 1]
        else:
            part = (terms[:, None] * len(bound) + opened).ravel()
            begins, ends = self.part_begins[part], self.part_begins[part + 1]
            weights = np.repeat(weights, len(opened))
        sizes = ends - begins
        places = spans(begins, ends)
        found = self.weight.take(places)
        found *= np.repeat(weights, sizes)
        total = score + np.bincount(self.at.take(places), found, minlength=len(score))
        least = np.partition(total, len(total) - k)[len(total) - k] if len(total) > k else 0.0
        at = np.flatnonzero(total > max(0.0, least - 1e-11))
        best = total[at]
        rank = np.lexsort((at, -np.round(best, 12)))[:k]
        return list(zip(best[rank].tolist(), at[rank].tolist(), strict=True))

    def vote(
        self, found: list[tuple[float, int]], without: dict[int, tuple[float, float]] | None = None
    ) -> float:
        """Share of toxic among the neighbours' labels, each by the square of its cosine.

        ``without`` (per example: weight of clean and of toxic) takes a row's own labels out, for
        fitting; the neighbours after take its place.
        """
        toxic, total, left = PRIOR_VOTE * self.base_rate, PRIOR_VOTE, NEIGHBOURS
        for similarity, at in found:
            yes, no = self.votes[at]
            if without and at in without:
                no, yes = no - without[at][0], yes - without[at][1]
            n = yes + no
            if n > 1e-9 and left:
                # An example of many rows counts as more neighbours, less than in proportion.
                weight = similarity**2 * math.log1p(n)
                toxic, total, left = toxic + weight * yes / n, total + weight, left - 1
        return toxic / total

    unit: tuple[float, float] = (1.0, 1.0)

    def calibrated(self, vote: float) -> float:
        x = math.log(max(vote, 1e-6) / max(1 - vote, 1e-6))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.offset))))

    def score(self, found: list[tuple[float, int]]) -> float:
        """Score of a text with terms by its neighbours."""
        return self.calibrated(self.vote(found))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope (kept positive) and offset by Newton's method with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        ridge = 1e-2
        ga, gb = (g * x).sum() + ridge * (a - 1), g.sum() + ridge * b
        haa, hab, hbb = (h * x * x).sum() + ridge, (h * x).sum(), h.sum() + ridge
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 0.1), b


def learn(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    *,
    sample_toxic: int = SAMPLE_TOXIC,
    sample_clean: int = SAMPLE_CLEAN,
) -> Model | None:
    """Model from rows of ``labels`` (doc_id, toxic) for which ``use`` holds and ``docs`` has text.

    A bounded sample: per class the rows first by a hash of the id, ``sample_toxic`` and
    ``sample_clean`` of them, of near copies (equal least shingle hash) one; each stands for as
    many rows as its class has for one of the sample. Examples are the whole texts of the sample
    (the shortest of them that have ``MOST_POSTINGS`` terms together); terms are all their words, toxic
    or clean, and their beginnings. Document frequencies are counted over all of ``docs``. Votes are
    calibrated on the sample, each row without its own label. Labels of one id that differ count as toxic when half or more are. None when
    the labels hold fewer than two classes.
    """
    label = labels.filter(use & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    label = label.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("_label"))
    counts = label.groupBy("_label").agg(F.count("*").alias("n")).collect()
    sizes = {r["_label"]: r["n"] for r in counts}
    parts = []
    for value, bound in ((1, sample_toxic), (0, sample_clean)):
        some = label.filter(F.col("_label") == value)
        order = [F.xxhash64("doc_id"), F.col("doc_id")]
        # First within each of DEALT lots, so that the last task gets a bounded number of rows.
        some = some.withColumn("_lot", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(DEALT)))
        some = top_per_group(some, ["_lot"], order, bound).drop("_lot")
        parts.append(top_per_group(some, ["_label"], order, bound))
    # Ids are chosen before any text is read; their number is bounded, so they are broadcast.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", F.col("text").alias("_text"))
    return _fit(docs, rows.join(chosen, "doc_id"), sizes)


def _fit(docs: DataFrame, sample: DataFrame, sizes: dict) -> Model | None:
    schema = pa.schema(
        [("_sketch", pa.int64()), ("doc_id", pa.int64()), ("_label", pa.int32()),
         ("_text", pa.string())]
    )

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            texts = part.column(2).to_pylist()
            sketches = [sketch(x.split()) for x in texts]
            yield record_batch(schema, [sketches, *(part.column(i) for i in range(3))])

    kinds = "_sketch long, doc_id long, _label int, _text string"
    every = sample.select("doc_id", "_label", "_text").mapInArrow(sketched, kinds)
    first = F.struct("doc_id", "_text")
    distinct = every.groupBy("_sketch", "_label").agg(F.min(first).alias("_one"))
    distinct = stored(distinct.select("_label", "_one.*"), "examples")
    n = {r["_label"]: r["n"] for r in distinct.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    telling = telling_terms(distinct, n)
    vectors = examples_that_fit(stored(_vectors(distinct), "vectors"))
    rows = vectors.drop("names").toArrow()  # rows and all their terms are bounded
    n = Counter(rows.column("label").to_pylist())
    if not n[0] or not n[1]:
        return None
    unit = (sizes[0] / n[0], sizes[1] / n[1])
    pairs = vectors.select(F.explode(F.arrays_zip("terms", "names")).alias("one")).select("one.*")
    pairs = pairs.distinct().toArrow().combine_chunks().sort_by("terms")
    terms = pairs.column("terms").to_numpy()
    names = pa.concat_arrays(pairs.column("names").chunks) if len(terms) else pa.array([], pa.string())
    total, with_term = document_counts(docs, terms, names)
    idf = np.log((1 + total) / (1 + with_term)) + 1
    model, place = _model(rows, terms, names, idf, sizes, unit, telling)
    load, shared = model.share(docs).loader(), docs.sparkSession.sparkContext.broadcast(place)
    vote_schema = pa.schema(
        [("doc_id", pa.int64()), ("label", pa.int32()), ("vote", pa.float64())]
    )

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = load()[0]
        for part in slices(batches, 64):
            hashes, times = (part.column(c).flatten().to_numpy() for c in (2, 3))
            size = pc.list_value_length(part.column(2)).to_numpy()
            at = np.searchsorted(kept.terms, hashes)
            weights = kept.weights(at, times, size, part.column(4).to_numpy())
            found = kept.nearest_of_each(at, weights, size, NEIGHBOURS + 1)
            out, ends = [], np.cumsum(size)
            for i, (doc_id, label) in enumerate(zip(*(c.to_pylist() for c in part.columns[:2]), strict=True)):
                if size[i]:
                    own = slice(ends[i] - size[i], ends[i])
                    example = shared.value[vector_key(hashes[own], times[own])]
                    no, yes = (label == k and kept.unit[k] for k in (0, 1))
                    out.append((doc_id, label, kept.vote(found[i], {example: (no, yes)})))
            if out:
                yield record_batch(vote_schema, list(zip(*out, strict=True)))

    got = sorted(map(tuple, vectors.mapInArrow(votes, "doc_id long, label int, vote double").collect()))
    ys = np.array([label for _, label, _ in got], float)
    if len(set(ys.tolist())) == 2:
        xs = np.array([math.log(max(v, 1e-6) / max(1 - v, 1e-6)) for _, _, v in got])
        weight = np.where(ys == 1, unit[1], unit[0])
        model.slope, model.offset = platt(xs, ys, weight * len(weight) / weight.sum())
    return model


def vector_key(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    both = np.concatenate([hashes.astype(np.int64), counts.astype(np.int64)])
    return xxhash.xxh3_128_digest(both.tobytes())


def _vectors(distinct: DataFrame) -> DataFrame:
    """doc_id, label, term hashes and counts, number of words and names of terms of each whole text."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int64())),
         ("counts", pa.list_(pa.int32())), ("words", pa.int64()), ("names", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            terms, counts, words, names = [], [], [], []
            for text in part.column(2).to_pylist():
                held = Counter(text.split())
                found: Counter = Counter()
                named: dict[int, str] = {}
                for word, n in held.items():
                    for term in word_terms(word):
                        number = term_hash(term)
                        found[number] += n
                        named[number] = term_name(term)
                terms.append(sorted(found))
                counts.append([found[t] for t in terms[-1]])
                words.append(held.total())
                names.append([named[t] for t in terms[-1]])
            yield record_batch(schema, [part.column(0), part.column(1), terms, counts, words, names])

    kinds = "doc_id long, label int, terms array<long>, counts array<int>, words long, names array<string>"
    return distinct.select("doc_id", "_label", "_text").mapInArrow(run, kinds)


def examples_that_fit(vectors: DataFrame) -> DataFrame:
    """The rows of fewest terms that have at most ``MOST_POSTINGS`` together."""
    sizes = vectors.select(F.size("terms").alias("n"), "doc_id").toArrow()
    n, ids = (sizes.column(c).to_numpy() for c in ("n", "doc_id"))
    order = np.lexsort((ids, n))
    dropped = order[np.cumsum(n[order].astype(np.int64)) > MOST_POSTINGS]
    return vectors.filter(~F.col("doc_id").isin(ids[dropped].tolist())) if len(dropped) else vectors


def _model(
    rows: pa.Table, hashes: np.ndarray, names: pa.Array, idf: np.ndarray, sizes: dict, unit: tuple, telling: dict
) -> tuple[Model, dict[bytes, int]]:
    """The model without calibration, and the number of each example by its key."""
    ids, labels, words = (rows.column(c).to_pylist() for c in ("doc_id", "label", "words"))
    every, times = (rows.column(c).combine_chunks() for c in ("terms", "counts"))
    empty, by_key = [0.0, 0.0], {}
    for i in sorted(range(len(ids)), key=lambda i: (ids[i], labels[i])):
        found, n = (x[i].values.to_numpy() for x in (every, times))
        if not len(found):
            empty[labels[i]] += unit[labels[i]]
            continue
        one = found, n, ids[i], [0.0, 0.0], words[i]
        by_key.setdefault(vector_key(found, n), one)[3][1 - labels[i]] += unit[labels[i]]
    base_rate = sizes[1] / (sizes[0] + sizes[1])
    keys = sorted(by_key)
    picked = [by_key[k] for k in keys]
    none = np.empty(0, np.int64)
    terms = np.searchsorted(hashes, np.concatenate([none, *(t for t, *_ in picked)]))
    counts = np.concatenate([none, *(n for _, n, *_ in picked)])
    owner = np.repeat(np.arange(len(picked)), [len(t) for t, *_ in picked])

    frequent = np.argsort(-np.bincount(terms, minlength=len(hashes)), kind="stable")[:ORDER_TERMS]
    alike = np.zeros(len(picked), np.int64)
    for j, term in enumerate(frequent.tolist()):
        alike[owner[terms == term]] |= 1 << (ORDER_TERMS - j)
    order = np.argsort(alike, kind="stable")
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    owner = position[owner]

    by_term = np.lexsort((owner, terms))
    begins = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(hashes)))])
    speaks = np.zeros(len(hashes))
    told = {term_hash(term): value for term, value in telling.items()}
    if told:
        numbers = np.array(list(told), np.int64)
        at = np.minimum(np.searchsorted(hashes, numbers), len(hashes) - 1)
        speaks[at[hashes[at] == numbers]] = np.array(list(told.values()))[hashes[at] == numbers]
    votes = np.array([picked[i][3] for i in order.tolist()]).reshape(-1, 2)
    model = Model(
        hashes, names, idf, base_rate, empty[1] / sum(empty) if sum(empty) else base_rate, votes,
        [picked[i][2] for i in order.tolist()], begins.astype(np.int64),
        *(x[by_term].astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (owner, counts)),
        telling, speaks, np.array([picked[i][4] for i in order.tolist()], np.int64),
    )
    model.unit = unit
    return model, {key: int(position[i]) for i, key in enumerate(keys)}


def score(docs: DataFrame, model: Model | None, evidence: int = 3) -> DataFrame:
    """doc_id, score, evidence (doc_id, similarity of the nearest examples), passages of whole texts.

    Scores are 0 to 1, from all words of the text. A text with no term of any example (also a null or
    empty one) gets the rate of toxic rows among examples without any; without a model every score
    is 0. From a score of ``SHOWN`` on, ``passages`` are the heaviest ones with a word that speaks for
    toxic. Repeated rows are scored each. Other columns of ``docs`` are not read.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("score", pa.float64()),
         ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64())]))),
         ("passages", pa.list_(pa.string()))]
    )
    kinds = (
        "doc_id long, score double, evidence array<struct<doc_id: long, similarity: double>>, "
        "passages array<string>"
    )
    rows = docs.select("doc_id", "text")
    load = model.loader() if model else lambda: (None, None)

    def judged(kept: Model, finder: TermFinder, texts: pa.Array) -> list[tuple]:
        terms, times, sizes, words = finder.batch(texts)
        found = kept.nearest_of_each(terms, kept.weights(terms, times, sizes, words), sizes)
        out = []
        for i, (near, size) in enumerate(zip(found, sizes.tolist(), strict=True)):
            value, shown = kept.score(near) if size else kept.empty_rate, []
            if size and value >= SHOWN:
                shown = [
                    " ".join(w) for w, _ in finder.windows(texts[i].as_py())
                    if any(finder.weight(x) > 0 for x in w)
                ]
            named = [{"doc_id": kept.ids[at], "similarity": s} for s, at in near[:evidence]]
            out.append((value, named, shown))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, finder = load()
        for part in text_slices(batches, 1, ROWS, TEXT_BYTES):
            # Copies in one slice are judged once.
            texts = pc.fill_null(part.column(1), "").dictionary_encode()
            some = judged(kept, finder, texts.dictionary) if kept else [(0.0, [], [])] * len(texts.dictionary)
            each = [some[i] for i in texts.indices.to_pylist()]
            if each:
                yield record_batch(schema, [part.column(0), *zip(*each, strict=True)])

    return rows.mapInArrow(run, kinds)
