"""Repeated passages: token k-mers as edges of a De Bruijn graph, compacted into paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.llm.common import discard, record_batch, slices, stored, worker_state

#: Words of an edge; words of the seeds by which edges meet.
EDGE, SEED = 20, 6
#: Bits of a sliding minimum that tell where it stands, so words that are hashed at once.
PLACE_BITS = 24
WORDS_AT_ONCE = 1 << 20
MIX = np.array([xxhash.xxh64_intdigest(f"graph{i}") | 1 for i in range(32)], dtype=np.uint64)


class WordHashes(dict):
    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """``bytes.split`` cuts at the six ASCII white-space bytes and nowhere else."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _join(a: np.ndarray, b: np.ndarray, shift: int, c: int) -> np.ndarray:
    """Hash of runs ``a`` each followed by the run of ``b`` that begins ``shift`` words later."""
    n = min(len(a), len(b) - shift)
    if n <= 0:
        return np.empty(0, np.uint64)
    x = a[:n] * MIX[c] + b[shift : shift + n] * MIX[c + 1]
    return (x ^ (x >> np.uint64(31))) * MIX[c + 2]


def run_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all seeds and, two independent ones, of all edges of a word hash sequence."""
    two = _join(h, h, 1, 0)
    four = _join(two, two, 2, 3)
    eight = _join(four, four, 4, 6)
    sixteen = _join(eight, eight, 8, 9)
    return (
        _join(four, two, 4, 12),
        _join(sixteen, four, 16, 15),
        _join(_join(eight, eight, 8, 18), _join(two, two, 2, 21), 16, 24),
    )


def sliding_minimum(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` elements in a row."""
    least, width = x, 1
    while 2 * width <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = size - width
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def nonbranching_runs(h: np.ndarray, ends: np.ndarray):
    """Runs of edges with the same seed: (start, edges, seed, content, check) arrays.

    ``h`` holds the documents' word hashes one after another, ``ends`` where each ends. An
    edge's seed is the least of the seed hashes inside it, the leftmost of equals, which depends
    on its words only, so equal edges have equal seeds. Edges in a row with the same seed at the
    same place make a run of at most 15, and its first and last edge hold all its words.
    """
    none = np.empty(0, np.int64)
    if len(h) < EDGE:
        return none, none, none, none, none
    seeds, edges, checks = run_hashes(h)
    place = np.uint64((1 << PLACE_BITS) - 1)
    keyed = (seeds & ~place) | np.arange(len(seeds), dtype=np.uint64)
    least = sliding_minimum(keyed, EDGE - SEED + 1)
    at = np.arange(len(edges))
    document_end = np.repeat(ends, np.diff(ends, prepend=0))[: len(at)]
    starts = at[at + EDGE <= document_end]
    if not len(starts):
        return none, none, none, none, none
    where = (least[starts] & place).astype(np.int64)
    new = np.concatenate([[True], where[1:] != where[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(starts)]]))
    begin, last = starts[first], starts[first + n - 1]
    size = n.astype(np.uint64)

    def whole(x: np.ndarray, c: int) -> np.ndarray:
        y = x[begin] * MIX[c] + x[last] * MIX[c + 1] + size * MIX[c + 2]
        return ((y ^ (y >> np.uint64(29))) * MIX[c]).astype(np.int64)

    return begin, n, seeds[where[first]].astype(np.int64), whole(edges, 27), whole(checks, 28)


def _groups(texts: list, known: WordHashes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents' word hashes, some at a time: first and end document, hashes, document ends.

    A document with more words than fit at once is cut into overlapping parts; then ``first`` is
    the document and ``end`` = -offset - 1 tells where the part begins.
    """
    if len(known) > known.MOST:
        known.clear()
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        words = words_of(text)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if held and size + len(h) > WORDS_AT_ONCE:
            yield first, i, np.concatenate(held), np.cumsum([len(x) for x in held])
            held, first, size = [], i, 0
        if len(h) > WORDS_AT_ONCE:
            step = WORDS_AT_ONCE - EDGE + 1
            for offset in range(0, len(h) - EDGE + 1, step):
                part = h[offset : offset + WORDS_AT_ONCE]
                yield i, -offset - 1, part, np.array([len(part)])
            first = i + 1
            continue
        held.append(h)
        size += len(h)
    if held:
        yield first, len(texts), np.concatenate(held), np.cumsum([len(x) for x in held])


def _document_runs(texts: list, known: WordHashes):
    """Per group of texts: document index, start in it, edges, seed, content, check."""
    for first, end, h, ends in _groups(texts, known):
        begin, n, seed, content, check = nonbranching_runs(h, ends)
        if end < 0:
            yield np.full(len(begin), first), begin - end - 1, n, seed, content, check
        else:
            owner = np.searchsorted(ends, begin, "right")
            yield owner + first, begin - (ends - np.diff(ends, prepend=0))[owner], n, seed, content, check


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, copy and text of rows with an id; copy numbers different texts of one id."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    many = rows.groupBy("doc_id").agg(F.min(text).alias("_a"), F.max(text).alias("_b"))
    many = stored(many.filter("_a != _b").select("doc_id"), "copies")
    if not many.head(1):  # nothing to number, so texts need not be joined
        return rows.select("doc_id", F.lit(0).alias("copy"), "text")
    again = rows.join(many, "doc_id")
    again = again.select(F.col("doc_id").alias("_id"), text.alias("_text")).distinct()
    number = F.dense_rank().over(Window.partitionBy("_id").orderBy("_text")) - 1
    again = again.select("_id", "_text", number.alias("_copy"))
    same = (F.col("doc_id") == F.col("_id")) & (text == F.col("_text"))
    return rows.join(again, same, "left").select(
        "doc_id", F.coalesce("_copy", F.lit(0)).alias("copy"), "text"
    )


def _runs(docs: DataFrame) -> DataFrame:
    """seed, content, check, doc_id, copy, start, n of every run of edges."""
    schema = pa.schema(
        [("seed", pa.int64()), ("content", pa.int64()), ("check", pa.int64()),
         ("doc_id", pa.int64()), ("copy", pa.int32()), ("start", pa.int64()), ("n", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state("graph words", WordHashes)
        for part in slices(batches):
            doc_id = np.array(part.column(0).to_pylist(), np.int64)
            copy = np.array(part.column(1).to_pylist(), np.int32)
            for at, start, n, seed, content, check in _document_runs(
                part.column(2).to_pylist(), known
            ):
                columns = [seed, content, check, doc_id[at], copy[at], start, n]
                yield record_batch(schema, columns)

    kinds = "seed long, content long, check long, doc_id long, copy int, start long, n int"
    return docs.mapInArrow(run, kinds)


def _edges(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """edge, check, doc_id, copy, start of the edges in the asked runs (doc_id, copy, start, n)."""
    lists = asked.groupBy("doc_id", "copy").agg(
        F.collect_list(F.struct("start", "n")).alias("_asked")
    )
    schema = pa.schema(
        [("edge", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()),
         ("copy", pa.int32()), ("start", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state("graph words", WordHashes)
        for part in slices(batches, 64):
            if len(known) > known.MOST:
                known.clear()
            out: list[list] = [[], [], [], [], []]
            for doc_id, copy, text, asked in zip(
                *(c.to_pylist() for c in part.columns), strict=True
            ):
                words = words_of(text)
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                _, edges, checks = run_hashes(h)
                at = np.unique(
                    np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in asked])
                )
                out[0].append(edges[at].astype(np.int64))
                out[1].append(checks[at].astype(np.int64))
                out[2].append(np.full(len(at), doc_id))
                out[3].append(np.full(len(at), copy, np.int32))
                out[4].append(at)
            if out[0]:
                yield record_batch(schema, [np.concatenate(x) for x in out])

    joined = docs.join(lists, ["doc_id", "copy"]).select("doc_id", "copy", "text", "_asked")
    return joined.mapInArrow(run, "edge long, check long, doc_id long, copy int, start long")


def repeated_paths(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Edges that also start earlier, as paths: doc_id, copy, start, n, from_id, from_copy, from_start.

    ``docs`` as :func:`_identified` gives it, ``runs`` those of repeated seeds. A run whose words
    began earlier somewhere is a repeat as a whole. Of equal runs only the first is looked at
    further, and only if its seed occurs in other runs too: its single edges are compared. Every
    edge lies in some run, so the least place of an edge is the least over first runs.
    """
    place = F.struct("doc_id", "copy", "start")
    kinds = runs.groupBy("seed", "content", "check").agg(F.min(place).alias("_first"), F.first("n").alias("n"))
    several = kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("_kinds")).filter("_kinds > 1")
    again = (
        runs.join(kinds.drop("n"), ["seed", "content", "check"])
        .filter(place != F.col("_first"))
        .select("doc_id", "copy", "start", "n", "_first")
    )
    asked = kinds.join(several, "seed", "left_semi").select("_first.*", "n")
    asked = stored(asked, "asked")
    edges = stored(_edges(docs, asked), "edges")
    least = edges.groupBy("edge", "check").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    least = least.filter("_first != _last").drop("_last")
    single = (
        edges.join(least, ["edge", "check"])
        .filter(place != F.col("_first"))
        .select("doc_id", "copy", "start", F.lit(1).alias("n"), "_first")
    )
    return again.unionByName(single).select(
        "doc_id", "copy", "start", "n",
        F.col("_first.doc_id").alias("from_id"),
        F.col("_first.copy").alias("from_copy"),
        F.col("_first.start").alias("from_start"),
    )


def compacted(paths: list[tuple]) -> list[tuple]:
    """Paths that go on in the same source, one after another, as one: (start, n, source, from_start)."""
    out: list[list] = []
    for source, shift, start, n in sorted(
        ((p["from_id"], p["from_copy"]), p["from_start"] - p["start"], p["start"], p["n"])
        for p in paths
    ):
        end = start + n
        if out and out[-1][2:] == [source, shift] and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, source, shift])
    return [(a, b - a, source, a + shift) for a, b, source, shift in out]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeats, n_words, n_removed and paths of each row.

    Words lie between ASCII white space, unchanged. A run of 20 words is an edge; a word is removed
    if an edge over it also starts earlier: in a smaller doc_id, or further up in the same document.
    Kept words are joined by one blank. ``paths`` lists the repeated passages after compaction:
    start, n_words, from_id, from_start.

    1. Each edge belongs to a seed of its words; edges in a row with one seed are one run. Seeds
       that occur once are dropped, most of the corpus with them.
    2. Runs meet by content, and where runs differ, edges meet by hash (:func:`repeated_paths`).
       Two independent 64-bit hashes must agree at the passage and at its source.
    3. Paths come back to their documents, where those that follow each other become one.

    Texts are shuffled by document twice, for the edges and for the result; each step is kept as a
    table and its shuffle files go before the next begins. Rows that share an id but not the text
    count as documents of their own, in the order of a hash; equal rows are one document and are
    returned each. Rows without id stay whole and are no source. Null and empty texts, and those
    under 20 words, lose nothing.
    """
    known = _identified(docs)
    every = stored(_runs(known), "runs")
    seeds = every.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    seeds = stored(seeds.select("seed"), "seeds")
    runs = stored(every.join(seeds, "seed", "left_semi"), "runs")
    discard(every)
    found = stored(repeated_paths(known, runs), "paths")
    lists = found.groupBy("doc_id", "copy").agg(
        F.collect_list(F.struct("start", "n", "from_id", "from_copy", "from_start")).alias("_paths")
    )
    rows = known.join(lists, ["doc_id", "copy"], "left").select("doc_id", "text", "_paths")
    nameless = docs.filter(F.col("doc_id").isNull()).select("doc_id", "text")
    nameless = nameless.withColumn("_paths", F.lit(None).cast(rows.schema["_paths"].dataType))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()),
         ("n_removed", pa.int64()),
         ("paths", pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()),
                                       ("from_id", pa.int64()), ("from_start", pa.int64())])))]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            out: list[list] = [[], [], [], [], []]
            ids, texts, lists = (c.to_pylist() for c in part.columns)
            for doc_id, text, paths in zip(ids, texts, lists, strict=True):
                left = words = words_of(text)
                merged = compacted(paths) if paths else []
                if merged:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for start, n, _, _ in merged:
                        gone[start] += 1
                        gone[start + n + EDGE - 1] -= 1
                    kept = np.cumsum(gone)[:-1] == 0
                    left = [w for w, keep in zip(words, kept.tolist(), strict=True) if keep]
                spans = [
                    {"start": a, "n_words": n + EDGE - 1, "from_id": source[0], "from_start": b}
                    for a, n, source, b in merged
                ]
                text = b" ".join(left).decode("utf-8", "surrogatepass")
                row = (doc_id, text, len(words), len(words) - len(left), spans)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield record_batch(schema, out)

    kinds = (
        "doc_id long, text string, n_words long, n_removed long, paths array<struct<start: long, "
        "n_words: long, from_id: long, from_start: long>>"
    )
    return rows.unionByName(nameless).mapInArrow(cut, kinds)

