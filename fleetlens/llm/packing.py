"""Best-fit packing of token sequences with certified bin counts and repair between partitions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.common import record_batch, stored, text_slices
from fleetlens.llm.encoding import ROWS_ENCODED, encoder

PARTITION_PIECES = 4096
FAN_IN = 8


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. Ties go in the order given.

    Bins are kept by free space; a bit set of the free sizes that occur finds the tightest bin.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_free: dict[int, list[int]] = {}
    sizes = n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = sizes >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                sizes &= ~(1 << free)
        else:
            free, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - free
        rest = free - length
        if rest:
            by_free.setdefault(rest, []).append(b)
            sizes |= 1 << rest
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    The first counts lengths over ``capacity - t`` as whole bins and drops those under ``t``;
    the second rounds ``(k + 1) * length / capacity`` down unless it is whole. Each keeps the
    sum of a full bin at 1 or less, so a sum rounded up bounds the number of bins.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    number = np.concatenate([[0], np.cumsum(count)])
    t = np.arange(capacity // 2 + 1)
    whole = number[-1] - number[capacity - t + 1]
    middle = tokens[capacity - t + 1] - tokens[t]
    most = int(np.max(whole + -(-middle // capacity)))
    x = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, 65):
        scaled = (k + 1) * x
        # In units of 1 / (k * capacity): x / capacity where whole, else floor(scaled / capacity) / k.
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        most = max(most, -(-int((value * count).sum()) // (k * capacity)))
    return most


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, keep_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids and ``end_id``; a null text is empty. Only longer documents
    are cut, and only their last piece may be shorter. ``keep_ids`` adds the ids themselves.
    """
    fields = [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if keep_ids:
        fields, kinds = [*fields, ("ids", pa.binary())], f"{kinds}, ids binary"
    schema = pa.schema(fields)
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for rows in text_slices(batches, 1, ROWS_ENCODED):
            out, found = [], encode.batch(rows.column(1))
            for doc_id, ids in zip(rows.column(0).to_pylist(), found, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, part) if keep_ids else row)
            yield record_batch(schema, list(zip(*out, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(cut, kinds)


def pack(
    pieces: DataFrame,
    capacity: int,
    *,
    partition_pieces: int = PARTITION_PIECES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Packs ``pieces`` (any columns, with length) and adds sequence_id and offset.

    Rows are numbered, dealt to partitions of about ``partition_pieces`` by a hash of the number
    (so equal rows spread) and packed best-fit decreasing. :func:`lower_bound` certifies a
    partition that has as few bins as possible. Any other has a gap: it hands over its emptiest
    bins, at most ``partition_pieces / fan_in`` pieces of them, ``fan_in`` neighbours pool what
    they hand over and pack it anew. A new packing counts if it has fewer bins, else the old one
    stays. Pools that are not certified go on to the next level until one pool is left, so there
    are log(partitions) levels, each with a fraction of the rows before, and no task ever holds
    much over ``partition_pieces`` rows. Lengths must be 1 to ``capacity``. An empty table gives
    an empty table.
    """
    numbered = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    n = numbered.count()
    groups = max(1, -(-n // partition_pieces))
    schema = pa.schema(
        [("_row", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()),
         ("offset", pa.int64()), ("_group", pa.int64()), ("_open", pa.bool_())]
    )
    kinds = "_row long, length long, sequence_id long, offset long, _group long, _open boolean"

    def packer(level: int, last: bool):
        def one(rows: pa.Table) -> pa.Table:
            number, length, old, old_at, group = (
                rows.column(i).to_numpy().astype(np.int64) for i in range(5)
            )
            order = np.argsort(number)
            number, length, old, old_at = number[order], length[order], old[order], old_at[order]
            bins, at = best_fit_decreasing(length, capacity)
            before = len(np.unique(old)) if level else len(length) + 1
            if bins.max() + 1 < before:
                names, at = (level << 56) + (int(group[0]) << 24) + bins, at
            else:
                names, at = old, old_at
            names_of, index = np.unique(names, return_inverse=True)
            gap = len(names_of) > lower_bound(length, capacity)
            opened = np.zeros(len(length), bool)
            if gap and not last:
                free = capacity - np.bincount(index, weights=length).astype(np.int64)
                emptiest = np.argsort(-free, kind="stable")
                held = np.cumsum(np.bincount(index)[emptiest])
                chosen = emptiest[(held <= partition_pieces // fan_in) & (free[emptiest] > 0)]
                opened = np.isin(index, chosen)
            columns = [number, length, names, at, np.full(len(number), group[0] // fan_in), opened]
            return pa.Table.from_batches([record_batch(schema, columns)])

        return one

    todo = numbered.select(
        "_row", "length", F.lit(0).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"),
    )
    done, level = [], 0
    while True:
        last = groups == 1
        out = stored(todo.groupBy("_group").applyInArrow(packer(level, last), kinds), "packed")
        done.append(out.filter(~F.col("_open")).select("_row", "sequence_id", "offset"))
        todo = out.filter("_open").drop("_open")
        if last or not todo.head(1):
            break
        groups, level = -(-groups // fan_in), level + 1
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return numbered.join(placed, "_row").drop("_row")


def token_packing(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Encodes, cuts and packs ``docs`` (doc_id, text); other columns are not read.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Empty and null texts
    are a piece of one id; a null doc_id stays null; repeated rows are packed each for itself.
    """
    return pack(token_pieces(docs, tokenizer, end_id, capacity), capacity)
