"""Exact n-gram Jaccard join: light sets by fixed-size subsets, heavy ones by inverted lists.

Where the similarity is low, sets that may link meet in the lists of their rarest elements instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.llm.common import discard, record_batch, slices, stored, worker_state
from fleetlens.llm.components import components

NGRAM, PERCENT = 3, 90
#: Boundaries between light and heavy sets whose cost is compared, and the cost of a pair of rows
#: in one list in units of the cost of sending a row.
BOUNDARIES, PAIR_COST = (0, 9, 18, 28), 0.5
#: Subsets of a light set; a boundary is not tried where a set of its size would have more.
MOST_SUBSETS = 500
#: Shingles that one task compares at most, about; a larger family is compared block by block.
FAMILY_SHINGLES = 2_000_000
#: Sets whose copies a task leaves out.
SEEN_SETS = 100_000
#: Linked sets have to share one of so many elements among their rarest ones, and one more.
RARE_SHARE = 16
#: Sets in a list of rare elements whose pairs are counted; the sets of a longer one are one family.
PAIRED_SETS = 8
#: Ids of sets that may link, up to which every task gets them all; with more, texts are shuffled.
SENT_IDS = 1_000_000
MIX = np.array([xxhash.xxh64_intdigest(f"mix{i}") | 1 for i in range(64)], dtype=np.uint64)


class WordHashes(dict):
    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def lower_ascii(text: str) -> bytes:
    """UTF-8 of the text with A-Z in lower case; ``bytes.lower`` touches no other byte."""
    return text.encode("utf-8", "surrogatepass").lower()


def shingle_set(text: str | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; shorter texts are one run.

    ``bytes.split`` cuts at the six ASCII white-space bytes and nowhere else.
    """
    words = lower_ascii(text).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > known.MOST:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    m = len(h) - size + 1
    total = np.full(m, size, np.uint64) * MIX[63]
    for j in range(size):
        x = h[j : j + m] * MIX[j]
        total += (x ^ (x >> np.uint64(31))) * MIX[j + 16]
    return np.unique((total ^ (total >> np.uint64(29))) * MIX[62])


def most_different(a: int, b: int, percent: int) -> int:
    """Elements in which two linked sets of these sizes differ at most."""
    return (100 - percent) * (a + b) // (100 + percent)


def partners(size: int, percent: int) -> range:
    """Sizes of sets that can link to one of ``size``."""
    return range(-(-size * percent // 100), size * 100 // percent + 1)


def interval(size: int, boundary: int, percent: int) -> tuple[int, int, int]:
    """Number, first and last size of the interval of heavy sizes that holds ``size``.

    An interval ends where a set of its first size can link no further, so linked sets lie in
    the same interval or in neighbours. A size under the first interval counts as number -1.
    """
    first, number = boundary + 1, 0
    if size < first:
        return -1, 0, boundary
    while True:
        last = first * 100 // percent
        if size <= last:
            return number, first, last
        first, number = last + 1, number + 1


def heavy_keys(shingles: np.ndarray, number: int, last: int, percent: int) -> list[int]:
    """Keys of the inverted lists of interval ``number``, whose largest set has ``last`` elements.

    Elements are dealt by hash to two segments more than linked sets can differ in elements,
    so linked sets agree in two segments at least. A list holds the sets with the same content
    in a segment. An empty segment says little: two of them make one list.
    """
    m = most_different(last, last, percent) + 2
    segment = (shingles >> np.uint64(20)) % np.uint64(m)
    order = np.argsort(segment, kind="stable")
    at, x = segment[order], shingles[order]
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    y = x * MIX[40]
    y = (y ^ (y >> np.uint64(32))) * MIX[41]
    own = (np.uint64(number) + np.uint64(1)) * MIX[42]
    sums = np.add.reduceat(y, begins) + at[begins] * MIX[43] + own
    keys = ((sums ^ (sums >> np.uint64(30))) * MIX[44]).astype(np.int64).tolist()
    empty = sorted(set(range(m)).difference(at[begins].tolist()))
    for pair in combinations(empty, 2):
        keys.append(xxhash.xxh64_intdigest(repr((number, *pair))) - (1 << 63))
    return keys


def light_keys(shingles: np.ndarray, boundary: int, percent: int) -> list[int]:
    """Hashes of the subsets of the sizes that linked light sets must share.

    A partner of size t shares a subset of (size + t - most different) / 2 elements, so all
    subsets of these sizes are enumerated, by leaving out one or two elements at most.
    """
    size, keys = len(shingles), set()
    y = shingles * MIX[50]
    y = (y ^ (y >> np.uint64(32))) * MIX[51]
    total = y.sum(dtype=np.uint64)
    for t in partners(size, percent):
        if t > boundary or t < 1:
            continue
        shared = -(-percent * (size + t) // (100 + percent))
        left_out = size - shared
        if left_out < 0:
            continue
        sums = [total] if not left_out else [
            total - sum((y[i] for i in some), np.uint64(0))
            for some in combinations(range(size), left_out)
        ]
        mixed = (np.array(sums, np.uint64) ^ np.uint64(shared)) * MIX[52]
        keys.update(((mixed ^ (mixed >> np.uint64(31))) * MIX[53]).astype(np.int64).tolist())
    return sorted(keys)


def n_subsets(size: int, percent: int) -> int:
    """How many subsets a light set of this size has, for partners up to its own size."""
    sizes = {-(-percent * (size + t) // (100 + percent)) for t in partners(size, percent) if 1 <= t <= size}
    return sum(comb(size, shared) for shared in sizes if shared <= size)


def boundaries(percent: int) -> tuple[int, ...]:
    """Boundaries to compare: the lower the similarity, the fewer sizes have few subsets."""
    return tuple(b for b in BOUNDARIES if n_subsets(b, percent) <= MOST_SUBSETS)


def list_keys(shingles: np.ndarray, boundary: int, percent: int) -> list[int]:
    """Keys under which a set meets every set that it links to."""
    size = len(shingles)
    if not size:
        return []
    with np.errstate(over="ignore"):
        keys = light_keys(shingles, boundary, percent) if size <= boundary else []
        number, _, last = interval(size, boundary, percent)
        if number >= 0:
            keys += heavy_keys(shingles, number, last, percent)
        after = last + 1  # first size of the next interval
        if size >= -(-after * percent // 100):
            keys += heavy_keys(shingles, number + 1, after * 100 // percent, percent)
    return keys


def link_roots(sets: list[np.ndarray], percent: int) -> list[int]:
    """Per set the first one of its component, by exact links found over inverted lists.

    Sets go by size; each scans the lists of its elements among the sets before it and counts
    what it shares. Sets already joined are not compared any more.
    """
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(x) for x in sets])
    if not len(sets) or not sizes.sum():
        return parent
    elements, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by_code = np.argsort(codes, kind="stable")
    begins = np.searchsorted(codes[by_code], np.arange(len(elements) + 1))
    listed, ends = owner[by_code], np.cumsum(sizes)
    for i in np.argsort(sizes, kind="stable").tolist():
        mine = codes[ends[i] - sizes[i] : ends[i]]
        long = begins[mine + 1] - begins[mine] > 1
        spans = zip(begins[mine[long]].tolist(), begins[mine[long] + 1].tolist(), strict=True)
        hits = [listed[a:b] for a, b in spans]
        if not hits:
            continue
        others, shared = np.unique(np.concatenate(hits), return_counts=True)
        union = sizes[i] + sizes[others] - shared
        for j in others[100 * shared >= percent * union].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_id (128-bit hash of the set; null without set or id), text_hash per row."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()),
         ("text_hash", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state("words", WordHashes)
        for part in slices(batches):
            sets = [shingle_set(x, n, known) for x in part.column(1).to_pylist()]
            ids = [
                xxhash.xxh3_128_digest(x.tobytes()) if len(x) and doc_id is not None else None
                for x, doc_id in zip(sets, part.column(0).to_pylist(), strict=True)
            ]
            yield record_batch(schema, [part.column(0), [len(x) for x in sets], ids, part.column(2)])

    rows = docs.select("doc_id", "text", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, text_hash long")


def node(set_id: bytes) -> int:
    """Short name of a set in lists; if two sets ever share one, they only join a family."""
    return int.from_bytes(set_id[:8], "big", signed=True)


def _keys(docs: DataFrame, n: int, boundaries, percent: int, most: int | None = None) -> DataFrame:
    """(boundary, key, node) of each row and boundary; with ``most``, of sets up to that size."""
    schema = pa.schema([("boundary", pa.int32()), ("key", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state("words", WordHashes)
        for part in slices(batches, 64):
            rows: list[list] = [[], [], []]
            for text in part.column(0).to_pylist():
                own = shingle_set(text, n, known)
                if not len(own) or (most and len(own) > most):
                    continue
                name = node(xxhash.xxh3_128_digest(own.tobytes()))
                for boundary in boundaries:
                    keys = list_keys(own, boundary, percent)
                    rows[0] += [boundary] * len(keys)
                    rows[1] += keys
                    rows[2] += [name] * len(keys)
            if rows[0]:
                yield record_batch(schema, rows)

    rows = docs.filter("doc_id is not null").select("text")
    return rows.mapInArrow(run, "boundary int, key long, node long")


def _elements(rows: DataFrame, n: int, half: bool = False) -> DataFrame:
    """(element, node) of the sets of ``rows`` (text), or of their elements with an even hash."""
    schema = pa.schema([("element", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = worker_state("words", WordHashes), set()
        for part in slices(batches, 32):
            elements, nodes = [], []
            for text in part.column(0).to_pylist():
                own = shingle_set(text, n, known)
                name = node(xxhash.xxh3_128_digest(own.tobytes()))
                if len(own) and name not in seen:
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(name)
                    some = (own[own & np.uint64(1) == 0] if half else own).astype(np.int64)
                    elements.append(some)
                    nodes.append(np.full(len(some), name))
            if elements:
                yield record_batch(schema, [np.concatenate(elements), np.concatenate(nodes)])

    return rows.select("text").mapInArrow(run, "element long, node long")


def _linkable(rows: DataFrame, first: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the distinct sets ``first`` that may link: no other set has few enough of their elements.

    A set links to another only if all but some of its elements are in it, so not if more than these
    are in no other set at all. Of the elements, those with an even hash are looked at, which is
    enough for sets that have little in common with any other, and never wrong.
    """
    found = _elements(rows.filter("doc_id is not null"), n, half=True)
    # Most elements are in one set only, so tasks send them as they are; copies are left out above.
    owners = found.repartition("element").groupBy("element").agg(F.min("node").alias("node"), F.max("node").alias("_last"))
    alone = owners.filter("node = _last").groupBy("node").agg(F.count(F.lit(1)).alias("_alone"))
    name = F.conv(F.hex(F.substring("set_id", 1, 8)), 16, -10).cast("long")
    every = first.withColumn("node", name).join(alone, "node", "left")
    spared = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100)
    return every.filter(F.coalesce("_alone", F.lit(0)) <= spared).select("node", "n_shingles", "doc_id")


def _rare_lists(listed: DataFrame, may: DataFrame, n: int, percent: int) -> DataFrame:
    """(element, node, n_shingles, least): the rarest elements of each set of ``may``, of those in other sets too.

    All elements are ordered by the number of sets that hold them, then by hash. Of linked sets each
    has at least ``shared`` of its elements in the other, so the first ``least`` that two of them share
    are, in both, among the first ``n_shingles - shared + least``. Elements of one set only come first
    in that order and meet nothing, so a set's rarest are told by counting from its most frequent one.
    Rows with one id and one set may send it twice, so places count distinct elements.
    """
    size = F.col("n_shingles")
    shared = F.ceil(size * percent / 100)
    least = F.least(F.floor(size / RARE_SHARE) + 1, shared).cast("int").alias("least")
    in_all = Window.partitionBy("element")
    found = _elements(listed, n).repartition("element").select(
        "element", "node", F.count(F.lit(1)).over(in_all).alias("_sets"),
        F.min("node").over(in_all).alias("_a"), F.max("node").over(in_all).alias("_b"),
    )
    found = found.filter("_a != _b").select("node", "element", "_sets")
    found = found.join(may.select("node", "n_shingles").distinct(), "node")
    order = Window.partitionBy("node").orderBy(F.desc("_sets"), F.desc("element"))
    found = found.select("element", "node", "n_shingles", least, F.dense_rank().over(order).alias("_at"))
    return found.filter(F.col("_at") > shared - F.col("least")).drop("_at").distinct()


def _rare_edges(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join all sets which share enough of their rarest elements into families.

    Pairs of sets that meet in short lists are counted. In a longer list the sets of like size are
    joined to the least one of them, without making pairs.
    """
    lengths = lists.groupBy("element").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    lists = lists.join(lengths, "element")
    some = lists.filter(F.col("_n") <= PAIRED_SETS)
    a = some.select("element", F.col("node").alias("a"), F.col("n_shingles").alias("_a"), F.col("least").alias("_la"))
    b = some.select("element", F.col("node").alias("b"), F.col("n_shingles").alias("_b"), F.col("least").alias("_lb"))
    like = (100 * F.least("_a", "_b") >= percent * F.greatest("_a", "_b")) & (F.col("a") < F.col("b"))
    pairs = a.join(b, "element").filter(like).select("a", "b", F.least("_la", "_lb").alias("_least"))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"), F.min("_least").alias("_least"))
    # Linked sets have sizes of the same or neighbouring classes, so they meet in the class of the larger one.
    scale = F.floor(F.log("n_shingles") / float(np.log(100 / percent)) + 1e-9)
    long = lists.filter(F.col("_n") > PAIRED_SETS).select(
        "element", "node", F.explode(F.array(scale, scale + 1)).alias("_class")
    )
    hubs = long.groupBy("element", "_class").agg(F.min("node").alias("hub"), F.max("node").alias("_last"))
    hubs = hubs.filter("hub != _last").drop("_last")
    joined = long.join(hubs, ["element", "_class"]).filter("node != hub")
    joined = joined.select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return pairs.filter("_n >= _least").select("a", "b").unionByName(joined)


def choose_boundary(short: DataFrame, n: int, percent: int) -> int:
    """Boundary of least cost among :func:`boundaries`, from the keys of ``short`` documents.

    The boundary changes only what sets up to a little over the largest one emit. Its cost is
    the number of rows sent plus ``PAIR_COST`` for each pair of rows that meet in a list.
    """
    tried = boundaries(percent)
    most = interval(max(tried) + 1, max(tried), percent)[2]
    keys = _keys(short, n, tried, percent, most)
    lists = keys.groupBy("boundary", "key").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cost = F.sum(F.col("n") + PAIR_COST * F.col("n") * (F.col("n") - 1) / 2)
    rows = lists.groupBy("boundary").agg(cost.alias("cost")).collect()
    return min(((r["cost"], -r["boundary"]) for r in rows), default=(0, 0))[1] * -1


def near_components(
    docs: DataFrame,
    *,
    n: int = NGRAM,
    percent: int = PERCENT,
    text_hash: bool = False,
    sift: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text); exact.

    A document's set holds the distinct runs of ``n`` words, A-Z in lower case; a shorter text is
    one run; without words the set is empty and links with nothing (its component is its own
    id). Two documents link when their sets' Jaccard similarity is at least ``percent`` / 100.
    ``component_id`` is the least doc_id reachable by links.

    1. Rows with equal sets are one class, shown by its least document.
    2. Sets meet in lists. Light sets enumerate the fixed-size subsets that linked sets share;
       heavy sets go to inverted lists, one per segment of their elements rather than per
       element, so that a frequent shingle makes no long list. Cost decides the boundary.
    3. Lists join classes to families by their least member, without making pairs.
    4. A family's sets are sent to one task, or, above ``FAMILY_SHINGLES``, block against block
       of neighbouring sizes; there each set scans the inverted lists of its elements, and links
       are exact. Only links that join components come out.
    5. Components of these links are the result.

    Rows that share an id keep their own set; the id then stands for each of them. Rows without
    an id link with nothing, and their component is null. ``text_hash`` adds the column of that name,
    xxhash64 of the text, by which rows with one id are told apart. ``sift`` first counts how many
    elements of a set no other has, and instead of step 2 makes lists of the rarest elements of the sets
    that may link: two more shuffles, worth it where the similarity is so low that sets with a common
    passage would meet in many lists and be one family, whose blocks grow with the square of its size.
    """
    rows = docs.select("doc_id", "text")
    classes = stored(_classes(rows, n), "sets")
    first = classes.filter("set_id is not null").groupBy("set_id", "n_shingles").agg(
        F.min("doc_id").alias("doc_id")
    )
    listed = rows
    if sift:
        may = stored(_linkable(rows, first, n, percent), "linkable")
        # Kept, since their texts are read twice and each time all texts would be read, or shuffled.
        ids = may.select("doc_id").distinct()
        ids = F.broadcast(ids) if may.count() <= SENT_IDS else ids
        listed = stored(rows.join(ids, "doc_id", "left_semi"), "listed")
        keys = stored(_rare_lists(listed, may, n, percent), "lists")
        edges = _rare_edges(keys, percent)
    else:
        largest = max(boundaries(percent))
        most = interval(largest + 1, largest, percent)[2]
        short = rows.filter(F.length("text") <= 64 * (most + n))
        boundary = choose_boundary(short, n, percent)
        # Kept, since the lists are read twice and making them costs more than reading.
        keys = stored(_keys(rows, n, (boundary,), percent).select("key", "node"), "lists")
        hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_last"))
        hubs = hubs.filter("hub != _last").drop("_last")
        meets = keys.join(hubs, "key").filter("node != hub")
        edges = meets.select(F.col("node").alias("a"), F.col("hub").alias("b"))
    families = stored(components(edges), "families")
    discard(keys)

    links = stored(_family_links(listed, families, first, n, percent), "links")
    if sift:
        discard(listed)
    linked = components(links)
    named = first.join(linked, first["set_id"] == linked["node"], "left").select(
        "set_id", "doc_id", F.coalesce("root", "set_id").alias("root")
    )
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("set_id", "component_id")
    full = classes.join(named, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    names = ["doc_id", "n_shingles", component.alias("component_id")]
    return full.select(*names, *(["text_hash"] if text_hash else []))


def _family_links(
    rows: DataFrame, families: DataFrame, first: DataFrame, n: int, percent: int
) -> DataFrame:
    """Links (a, b) between sets of a family that join components."""
    name = F.conv(F.hex(F.substring("set_id", 1, 8)), 16, -10).cast("long")  # as node()
    member = families.join(first.withColumn("node", name), "node").select(
        "set_id", "doc_id", "n_shingles", "root"
    )
    # Sizes of linked sets lie in the same or neighbouring classes of a geometric scale.
    scale = F.floor(F.log("n_shingles") / float(np.log(100 / percent))).cast("long")
    member = member.withColumn("_class", scale)
    total = member.groupBy("root").agg(F.sum("n_shingles").alias("_all"))
    size = member.groupBy("root", "_class").agg(F.sum("n_shingles").alias("_sum"))
    blocks = size.select(
        F.col("root"), "_class", F.ceil(F.col("_sum") * 2 / FAMILY_SHINGLES).alias("_blocks")
    )
    next_blocks = blocks.select(
        "root", (F.col("_class") - 1).alias("_class"), F.col("_blocks").alias("_next")
    )
    before = blocks.select(
        "root", (F.col("_class") + 1).alias("_class"), F.col("_blocks").alias("_before")
    )
    member = (
        member.join(total, "root")
        .join(blocks, ["root", "_class"])
        .join(next_blocks, ["root", "_class"], "left")
        .join(before, ["root", "_class"], "left")
    )
    own = F.pmod(F.xxhash64("set_id"), F.col("_blocks"))

    def cell(low, i, high, j):
        return F.concat_ws("/", low, i, high, j)

    def upto(count):
        count = F.coalesce(count, F.lit(0))
        return F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(
            F.array().cast("array<long>")
        )

    c = F.col("_class")
    same = F.transform(
        upto(F.col("_blocks")), lambda j: cell(c, F.least(own, j), c, F.greatest(own, j))
    )
    above = F.transform(upto(F.col("_next")), lambda j: cell(c, own, c + 1, j))
    below = F.transform(upto(F.col("_before")), lambda j: cell(c - 1, j, c, own))
    cells = F.when(F.col("_all") <= FAMILY_SHINGLES, F.array(F.lit("all"))).otherwise(
        F.array_distinct(F.concat(same, above, below))
    )
    sent = member.select("set_id", "doc_id", "root", cells.alias("_cells"))

    schema = pa.schema(
        [("root", pa.int64()), ("cell", pa.string()), ("set_id", pa.binary()),
         ("shingles", pa.binary())]
    )

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state("words", WordHashes)
        for part in slices(batches, 64):
            out: list[list] = [[], [], [], []]
            columns = [x.to_pylist() for x in part.columns]
            for text, set_id, root, cells in zip(*columns, strict=True):
                own = shingle_set(text, n, known).tobytes()
                if xxhash.xxh3_128_digest(own) != set_id:
                    continue  # another row of the same id
                for cell in cells:
                    for column, x in zip(out, (root, cell, set_id, own), strict=True):
                        column.append(x)
            yield record_batch(schema, out)

    texts = rows.join(sent, "doc_id").select("text", "set_id", "root", "_cells")
    sets = texts.mapInArrow(shingled, "root long, cell string, set_id binary, shingles binary")
    sets = sets.dropDuplicates(["root", "cell", "set_id"])
    link = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def compare(rows: pa.Table) -> pa.Table:
        names = rows.column("set_id").to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        raw = rows.column("shingles").to_pylist()
        roots = link_roots([np.frombuffer(raw[i], np.uint64) for i in order], percent)
        pairs = [(names[order[i]], names[order[r]]) for i, r in enumerate(roots) if i != r]
        columns = list(zip(*pairs, strict=True)) if pairs else [[], []]
        return pa.Table.from_batches([record_batch(link, columns)])

    return sets.groupBy("root", "cell").applyInArrow(compare, "a binary, b binary")
