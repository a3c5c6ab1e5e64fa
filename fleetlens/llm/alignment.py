"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes, counted by bitmaps per pair."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.common import record_batch, stored, text_slices, worker_state

#: Bytes of parts and their results that a worker remembers in a generation, of two.
REMEMBERED_BYTES = 40 << 20
#: A longer part is not remembered.
LONG_PART = 64
#: Parts that are encoded together.
PARTS_AT_ONCE = 2_000
ROWS_AT_ONCE = 256
#: Documents of a chunk: places fit 16 bits. A chunk also ends when it holds this many links.
CHUNK_DOCS = 1 << 16
CHUNK_LINKS = 2 << 20
#: A container with as many documents is a bitset instead of a list of places.
DENSE = 4096
BITSET_BYTES = CHUNK_DOCS // 8
#: Bits of an id in a pair.
ID_BITS = 24
#: Before a blank or line feed after a non-blank.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: What parts that are encoded together follow.
HEAD = " ."


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteTokenizer:
    """Ids and bytes of a byte-level tokenizer; special tokens in a text are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_of_letter()
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        known = [all(c in letters for c in name) for name in names]
        self.bytes = [
            bytes(letters[c] for c in name) if ok else name.encode()
            for name, ok in zip(names, known, strict=True)
        ]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokenizer:
    """Ids and bytes of a piece model that puts a blank before a text."""

    BLANK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.bytes.append(piece.replace(self.BLANK, " ").encode())
            if self.BLANK in piece.lstrip(self.BLANK) or "\n" in piece:
                raise ValueError(f"piece {piece!r} goes over a blank, so parts are not independent")

    def ids(self, texts: list[str]) -> list[list[int]]:
        """``texts`` begin with the blank that the model puts in by itself."""
        return self.model.encode([x[1:] for x in texts], num_threads=1)


class Side:
    """The bytes of a tokenizer's ids, and their decimal texts with what may follow in a group."""

    def __init__(self, tokenizer: ByteTokenizer | PieceTokenizer, end: str):
        self.tokenizer = tokenizer
        self.bytes = np.array(tokenizer.bytes, object)
        self.sizes = np.fromiter(map(len, tokenizer.bytes), np.int64, len(tokenizer.bytes))
        n = len(tokenizer.bytes)
        self.texts = np.array([[f"{i}{c}".encode() for i in range(n)] for c in (",", end)], object)
        self.lengths = np.fromiter(map(len, self.texts[0]), np.int64, n)

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``text`` and the byte offsets where they end; None if they do not give it back."""
        ids = np.asarray(self.tokenizer.ids([text])[0], np.int64)
        same = b"".join(self.bytes[ids].tolist()) == text.encode()
        return (ids, np.cumsum(self.sizes[ids])) if same else None


class Part(NamedTuple):
    """Alignment of one part of a text: its links as pairs, its groups as text."""

    links: bytes
    groups: bytes
    n_a: int
    n_b: int
    n_groups: int

    def size(self) -> int:
        return 250 + len(self.links) + len(self.groups)


class Aligner:
    """Aligned parts of texts.

    Neither kind of tokenizer has a piece that goes on from a non-blank into a blank or a line feed,
    so a text may be cut before every one of these that follows a non-blank: no token and no group
    crosses a cut, and distinct parts are encoded once, many at a time. A part whose bytes are
    not those of its tokens (None) spoils its whole text.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Side(ByteTokenizer(path_a), "|"), Side(PieceTokenizer(path_b), ";")
        if max(len(self.a.bytes), len(self.b.bytes)) > 1 << ID_BITS:
            raise ValueError(f"ids have more than {ID_BITS} bits")
        self.new: dict[str, Part | None] = {}
        self.old: dict[str, Part | None] = {}
        self.size = 0

    def together(self, parts: list[str]) -> list[Part | None]:
        """Alignments of parts that, put together, may be cut at their ends again."""
        text = HEAD + "".join(parts)
        ends = np.cumsum([len(HEAD), *[len(p.encode()) for p in parts]])
        side_a, side_b = self.a.encoded(text), self.b.encoded(text)
        if side_a is None or side_b is None:
            if len(parts) == 1:
                return [None]
            return [one for p in parts for one in self.together([p])]
        (ids_a, ends_a), (ids_b, ends_b) = side_a, side_b
        # Between two neighbouring ends of either side one token of each overlaps the other.
        every = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        again = every[1:] == every[:-1]
        shared, every = every[1:][again], every[np.append(True, ~again)]
        links = ids_a[np.searchsorted(ends_a, every)] << ID_BITS
        links = (links | ids_b[np.searchsorted(ends_b, every)]).astype(np.uint64)
        groups, after = self.texts(ids_a, ends_a, ids_b, ends_b, shared)
        n_links, n_groups = (np.searchsorted(x, ends, "right") for x in (every, shared))
        n_a, n_b = (np.searchsorted(x, ends, "right").tolist() for x in (ends_a, ends_b))
        at, texts = n_links.tolist(), after[n_groups - 1].tolist()
        whole, n_groups = links.tobytes(), n_groups.tolist()
        return [
            Part(
                whole[8 * at[i] : 8 * at[i + 1]],
                groups[texts[i] : texts[i + 1] - 1],
                n_a[i + 1] - n_a[i],
                n_b[i + 1] - n_b[i],
                n_groups[i + 1] - n_groups[i],
            )
            for i in range(len(parts))
        ]

    def texts(self, ids_a, ends_a, ids_b, ends_b, shared) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;`` of all groups one after another, and where each group's text ends."""
        pieces = np.empty(len(ids_a) + len(ids_b), object)
        sizes = np.empty(len(pieces), np.int64)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        at_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")
        at_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        for side, ids, ends, group, at in (
            (self.a, ids_a, ends_a, group_a, at_a), (self.b, ids_b, ends_b, group_b, at_b)
        ):
            pieces[at] = side.texts[(shared[group] == ends).astype(np.int64), ids]
            sizes[at] = side.lengths[ids]
        text = b"".join(pieces.tolist())
        last = np.searchsorted(group_b, np.arange(len(shared)), "right") - 1
        return text, np.cumsum(sizes)[at_b[last]]

    def align(self, parts: list[str]) -> list[Part | None]:
        """A part that ends in white space would run into the next one, so it is encoded alone."""
        out: dict[str, Part | None] = {}
        joined = [p for p in parts if not p[-1].isspace()]
        for start in range(0, len(joined), PARTS_AT_ONCE):
            some = joined[start : start + PARTS_AT_ONCE]
            out.update(zip(some, self.together(some), strict=True))
        for part in parts:
            if part not in out:
                out[part] = self.together([part])[0]
        return [out[p] for p in parts]

    def known(self, parts: set[str]) -> dict[str, Part | None]:
        """Alignments of distinct parts; frequent ones stay remembered, within a number of bytes."""
        found, missing = {}, []
        for part in parts:
            if part in self.new:
                found[part] = self.new[part]
            elif part in self.old:
                found[part] = self._remember(part, self.old[part])
            else:
                missing.append(part)
        for part, aligned in zip(missing, self.align(missing), strict=True):
            found[part] = self._remember(part, aligned) if len(part) <= LONG_PART else aligned
        if self.size > REMEMBERED_BYTES:
            self.old, self.new, self.size = self.new, {}, 0
        return found

    def _remember(self, part: str, aligned: Part | None) -> Part | None:
        self.new[part] = aligned
        self.size += 200 + len(part) + (aligned.size() if aligned else 0)
        return aligned

    def batch(self, texts: list[str]) -> list[list[Part] | None]:
        """Parts of each text in order; None where tokens do not give the text back, or it is empty."""
        cut = [CUT.split(f" {t}") if t else [] for t in texts]
        found = self.known({p for parts in cut for p in parts})
        out = []
        for parts in cut:
            aligned = [found[p] for p in parts]
            out.append(None if not aligned or None in aligned else aligned)
        return out


def containers(places: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Compressed bitmaps of sorted places, cut at ``ends``: lists of 16 bits, or bitsets if dense."""
    sizes = np.diff(ends, prepend=0)
    dense = np.flatnonzero(sizes >= DENSE)
    pieces, lengths, at = [], sizes * 2, 0
    for n in dense.tolist():
        begin, end = int(ends[n] - sizes[n]), int(ends[n])
        bits = np.zeros(CHUNK_DOCS, np.uint8)
        bits[places[begin:end]] = 1
        pieces += [places[at:begin].astype("<u2").tobytes(), np.packbits(bits, bitorder="little").tobytes()]
        at = end
    pieces.append(places[at:].astype("<u2").tobytes())
    lengths[dense] = BITSET_BYTES
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(pieces))]
    )


def opened(container: bytes) -> np.ndarray:
    """Places in a compressed bitmap, in order."""
    if len(container) == BITSET_BYTES:
        bits = np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little")
        return np.flatnonzero(bits).astype(np.uint16)
    return np.frombuffer(container, "<u2")


def inverted(links: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs, documents and links of each, and planes: (pair, n_docs, n_links, offsets, bitmaps).

    Bitmap k of a pair holds the documents in whose number of links of the pair bit k is set. The
    documents of the pair are all its bitmaps OR-ed; its links are the sum of 2**k x bits of bitmap k.
    """
    found, times = np.unique((links << np.uint64(16)) | places, return_counts=True)
    pair, place = found >> np.uint64(16), (found & np.uint64(CHUNK_DOCS - 1)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    n_docs = np.diff(np.append(starts, len(pair)))
    n_links = np.add.reduceat(times, starts)
    number = np.repeat(np.arange(len(starts)), n_docs)
    planes = np.frexp(np.maximum.reduceat(times, starts))[1]
    offsets = np.concatenate([[0], np.cumsum(planes)])
    bitmap, at = [], []
    for k in range(int(planes.max())):
        chosen = np.flatnonzero(times >> k & 1)
        bitmap.append(offsets[number[chosen]] + k)
        at.append(place[chosen])
    bitmap, at = np.concatenate(bitmap), np.concatenate(at)
    order = np.argsort(bitmap, kind="stable")
    ends = np.cumsum(np.bincount(bitmap, minlength=offsets[-1]))
    return pair[starts], n_docs, n_links, offsets, containers(at[order], ends)


_TABLE = pa.schema(
    [("chunk", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
     ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
     ("groups_sha256", pa.string()), ("pair", pa.int64()), ("n_docs", pa.int64()),
     ("bitmaps", pa.list_(pa.binary()))]
)
_KINDS = (
    "chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pair long, n_docs long, bitmaps array<binary>"
)
DOCUMENT = ("chunk", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


class Chunk:
    """Documents whose links are inverted together."""

    def __init__(self, number: int):
        self.number, self.docs, self.links, self.places, self.n_links = number, [], [], [], 0

    def add(self, doc_id: int | None, parts: list[Part] | None) -> None:
        place = len(self.docs)
        if parts is None:
            self.docs.append((place, doc_id, 0, 0, 0, 0, ""))
            return
        links, groups, *sums = zip(*parts, strict=True)
        links = np.frombuffer(b"".join(links), np.uint64)
        self.links.append(links)
        self.places.append(np.full(len(links), place, np.uint64))
        self.n_links += len(links)
        digest = hashlib.sha256(b";".join(groups)).hexdigest()
        self.docs.append((place, doc_id, *map(sum, sums), len(links), digest))

    def full(self) -> bool:
        return len(self.docs) == CHUNK_DOCS or self.n_links >= CHUNK_LINKS

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The documents, then a row per pair with its bitmaps."""
        n = len(self.docs)
        columns = [[self.number] * n, *map(list, zip(*self.docs, strict=True))]
        yield record_batch(_TABLE, [*columns, *[pa.nulls(n, f.type) for f in list(_TABLE)[8:]]])
        if not self.links:
            return
        links, places = np.concatenate(self.links), np.concatenate(self.places)
        self.links, self.places = [], []
        pair, n_docs, n_links, offsets, bitmaps = inverted(links, places)
        size = 1 << 14
        for start in range(0, len(pair), size):
            end = min(start + size, len(pair))
            inside = offsets[start : end + 1]
            lists = pa.ListArray.from_arrays(
                pa.array(inside - inside[0], pa.int32()),
                bitmaps.slice(inside[0], inside[-1] - inside[0]),
            )
            m = end - start
            empty = [pa.nulls(m, f.type) for f in list(_TABLE)[1:6]]
            yield record_batch(
                _TABLE,
                [np.full(m, self.number), *empty, n_links[start:end], pa.nulls(m, pa.string()),
                 pair[start:end].astype(np.int64), n_docs[start:end], lists],
            )


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The alignment of every text as a table with rows of two kinds.

    Rows with a null ``pair`` are documents: chunk, place (in the chunk), doc_id, n_a, n_b (tokens of
    each side), n_groups (pieces between byte offsets where tokens of both sides end), n_links (pairs
    of token occurrences that overlap), groups_sha256. The others are the inverted index: ``pair``
    (id of A x 2**24 + id of B), chunk, n_docs, n_links, and ``bitmaps``: compressed sets of places in
    the chunk, one per bit of a document's number of links.

    ``docs`` has doc_id and text; other columns are not read. A blank is put before a text. A null or
    empty text, and one that the tokens of a side do not give back, has zeros and an empty hash.
    Repeated rows are documents of their own. Chunks are cut while a task reads, by number
    of documents and links, so a task holds one of them whatever the table holds.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_state(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk(number)
        for some in text_slices(batches, 1, ROWS_AT_ONCE):
            ids, texts = (c.to_pylist() for c in some.columns)
            for doc_id, parts in zip(ids, aligner.batch(texts), strict=True):
                chunk.add(doc_id, parts)
                if chunk.full():
                    yield from chunk.rows()
                    number += 1
                    chunk = Chunk(number)
        if chunk.docs:
            yield from chunk.rows()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _KINDS)


def pair_counts(table: DataFrame) -> DataFrame:
    """Pairs of the whole corpus: pair, n_docs, n_links, is_best (no pair of its id of B has more links).

    Chunks hold different documents, so the bits of a pair's bitmaps add up over chunks.
    """
    pairs = table.filter("pair is not null").groupBy("pair")
    pairs = pairs.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    pairs = pairs.withColumn("_b", F.col("pair").bitwiseAND((1 << ID_BITS) - 1))
    best = pairs.groupBy("_b").agg(F.max("n_links").alias("_most"))
    return pairs.join(best, "_b").select(
        "pair", "n_docs", "n_links", (F.col("n_links") == F.col("_most")).alias("is_best")
    )


def pair_documents(table: DataFrame) -> DataFrame:
    """The index as one row per pair and document: a, b, doc_id, n (links of the pair there)."""
    schema = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pair, bitmaps in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                times = np.zeros(CHUNK_DOCS, np.int64)
                for k, bitmap in enumerate(bitmaps):
                    times[opened(bitmap)] += 1 << k
                at = np.flatnonzero(times)
                n = len(at)
                yield record_batch(schema, [[chunk] * n, at, [pair] * n, times[at]])

    rows = table.filter("pair is not null").select("chunk", "pair", "bitmaps")
    rows = rows.mapInArrow(postings, "chunk long, place int, pair long, n long")
    docs = table.filter("pair is null").select("chunk", "place", "doc_id")
    return rows.join(docs, ["chunk", "place"]).select(
        F.shiftright("pair", ID_BITS).alias("a"),
        F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b"),
        "doc_id",
        "n",
    )


_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()),
     ("groups_sha256", pa.string())]
)


class Scores:
    """Sums by place of the chunks of a task."""

    def __init__(self):
        self.sums: dict[int, np.ndarray] = {}
        self.docs: dict[int, list[pa.RecordBatch]] = {}

    def of(self, chunk: int, places: int) -> np.ndarray:
        have = self.sums.get(chunk)
        if have is None or have.shape[1] < places:
            wider = np.zeros((2, min(CHUNK_DOCS, 2 * places)), np.int64)
            if have is not None:
                wider[:, : have.shape[1]] = have
            self.sums[chunk] = have = wider
        return have

    def add(self, chunks: np.ndarray, counts: np.ndarray, best: np.ndarray, lists: pa.ListArray) -> None:
        """Adds every pair's count to the documents in its bitmaps, times the value of the bitmap's bit."""
        offsets = lists.offsets.to_numpy()
        bitmaps = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        number = np.repeat(np.arange(len(lists)), np.diff(offsets))
        bit = np.arange(len(number)) - (offsets[:-1] - offsets[0])[number]
        begins = np.frombuffer(bitmaps.buffers()[1], np.int32)
        begins = begins[bitmaps.offset : bitmaps.offset + len(bitmaps) + 1].astype(np.int64)
        data = np.frombuffer(bitmaps.buffers()[2] or b"", np.uint8)
        sizes = np.diff(begins)
        for chunk in np.unique(chunks).tolist():
            mine = (chunks == chunk)[number]
            sparse = np.flatnonzero(mine & (sizes < BITSET_BYTES))
            before = np.cumsum(sizes[sparse]) - sizes[sparse]
            taken = np.repeat(begins[sparse] - before, sizes[sparse])
            taken += np.arange(len(taken))
            places = [data[taken].view("<u2").astype(np.int64)]
            owners = [np.repeat(sparse, sizes[sparse] // 2)]
            for n in np.flatnonzero(mine & (sizes == BITSET_BYTES)).tolist():
                some = opened(data[begins[n] : begins[n + 1]].tobytes()).astype(np.int64)
                places.append(some)
                owners.append(np.full(len(some), n))
            place, owner = np.concatenate(places), np.concatenate(owners)
            if len(place):
                sums, pair, value = self.of(chunk, int(place.max()) + 1), number[owner], 1 << bit[owner]
                np.add.at(sums[0], place, best[pair] * value)
                np.add.at(sums[1], place, counts[pair] * value)

    def results(self) -> Iterator[pa.RecordBatch]:
        for chunk, batches in self.docs.items():
            for docs in batches:
                place = docs.column("place").to_numpy()
                n_best, count_sum = self.of(chunk, int(place.max()) + 1)[:, place]
                get = [docs.column(c) for c in DOCUMENT[2:]]
                yield record_batch(_SCORED, [*get[:5], n_best, count_sum, get[5]])


def scored(table: DataFrame) -> DataFrame:
    """Documents of :func:`align`'s table (kept as a table) with the counts of their links.

    Columns: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the most links of all
    with its id of B, ties included), count_sum (of the pair's links in the whole corpus, over the
    document's links), groups_sha256. The bitmaps of a pair take its count back to the documents
    they hold: rows go to the tasks of their chunks, which hold two sums per document.
    """
    counts = pair_counts(table).select("pair", F.col("n_links").alias("count"), "is_best")
    pairs = table.filter("pair is not null").select("chunk", "pair", "bitmaps").join(counts, "pair")
    pairs = pairs.select("chunk", "count", F.col("is_best").cast("long").alias("best"), "bitmaps")
    docs = table.filter("pair is null").select(*DOCUMENT)
    both = docs.unionByName(pairs, allowMissingColumns=True).select(*DOCUMENT, "count", "best", "bitmaps")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores()
        for batch in batches:
            is_doc = batch.column("place").is_valid()
            docs = batch.filter(is_doc)
            chunks = docs.column("chunk").to_numpy()
            for chunk in np.unique(chunks).tolist():
                some = docs.filter(pa.array(chunks == chunk))
                scores.docs.setdefault(chunk, []).append(some.select(list(DOCUMENT)))
            pairs = batch.filter(pc.invert(is_doc))
            if pairs.num_rows:
                numbers = [pairs.column(c).to_numpy() for c in ("chunk", "count", "best")]
                scores.add(*numbers, pairs.column("bitmaps"))
        yield from scores.results()

    kinds = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _SCORED)
    return both.repartition("chunk").mapInArrow(sums, kinds)


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """:func:`scored` of all ``docs``, by way of a kept table."""
    return scored(stored(align(docs, path_a, path_b), "alignment"))
