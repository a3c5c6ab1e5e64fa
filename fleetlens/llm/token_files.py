"""Token ids as length-delimited binary records with masked checksums and an offset index.

A shard holds records one after another. A record is

    length of the payload   unsigned 64 bit, little endian
    masked checksum of it   unsigned 32 bit
    payload                 document id (signed 64 bit), then ids (unsigned, ``width`` bytes each)
    masked checksum of it   unsigned 32 bit

with crc32 rotated right by 15 bits plus a constant as the masked checksum. Beside a shard lies
its index: per record the document id, the offset and the payload's length (64 bits each), so
that records can be read in any order. A manifest table lists shards in order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fleetlens.llm.common import drop_states, record_batch, slices, text_slices
from fleetlens.llm.encoding import ROWS_ENCODED, encoder

MASK_DELTA = 0xA282EAD8
FRAME = 8 + 4 + 4
INDEX_ROW = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8")])
SHARD_BYTES = 64 << 20
MANIFEST = "part long, seq long, shard string, n_docs long, n_ids long, n_bytes long, width int"


class DamagedFile(ValueError):
    """A record whose length, checksum or index entry does not fit."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join(
        (head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload)))
    )


def read_record(stream, at: str) -> bytes:
    head = stream.read(12)
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise DamagedFile(f"{at}: length of a record")
    length = struct.unpack("<Q", head[:8])[0]
    body = stream.read(length + 4)
    if len(body) < length + 4 or struct.unpack("<I", body[length:])[0] != masked(body[:length]):
        raise DamagedFile(f"{at}: payload of a record")
    return body[:length]


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class ShardWriter:
    """One shard and its index. The name is new for each attempt; only the manifest counts."""

    def __init__(self, folder: str, part: int, seq: int, width: int):
        self.fs, root = open_folder(folder)
        self.fs.create_dir(root, recursive=True)
        self.part, self.seq, self.width = part, seq, width
        self.name = f"tokens-{part:08d}-{seq:04d}-{uuid.uuid4().hex}"
        self.path = f"{root}/{self.name}"
        self.data = self.fs.open_output_stream(f"{self.path}.records")
        self.rows: list[tuple[int, int, int]] = []
        self.offset = self.n_ids = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        payload = struct.pack("<q", doc_id) + ids
        self.data.write(framed(payload))
        self.rows.append((doc_id, self.offset, len(payload)))
        self.offset += len(payload) + FRAME
        self.n_ids += len(ids) // self.width

    def close(self) -> tuple:
        self.data.close()
        with self.fs.open_output_stream(f"{self.path}.index") as index:
            index.write(np.array(self.rows, dtype=INDEX_ROW).tobytes())
        n = len(self.rows)
        return self.part, self.seq, self.name, n, self.n_ids, self.offset, self.width


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    *,
    width: int = 2,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encodes ``docs`` (doc_id, text; other columns are not read) and writes them to ``folder``.

    Shards follow each other in ascending doc_id order, documents of equal id by
    a hash of the text. A null
    text is empty and gives the end id alone; rows without an id are not written. Rows are dealt
    by ranges of doc_id, so ids lie next to each other and no task holds more than a range; a
    task writes as it reads and starts a new shard after ``shard_bytes``. A repeated task writes
    files of its own, and the manifest names those of the attempt that counted. ``width`` is the
    number of bytes of an id. Returns the manifest, also kept below ``folder``. An empty table
    gives an empty manifest.
    """
    schema = pa.schema(
        [("part", pa.int64()), ("seq", pa.int64()), ("shard", pa.string()), ("n_docs", pa.int64()),
         ("n_ids", pa.int64()), ("n_bytes", pa.int64()), ("width", pa.int32())]
    )
    end = int(end_id).to_bytes(width, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, width)
        part, seq, shard = TaskContext.get().partitionId(), 0, None
        for rows in text_slices(batches, 1, ROWS_ENCODED):
            found = encode.batch(rows.column(1))
            for doc_id, ids in zip(rows.column(0).to_pylist(), found, strict=True):
                shard = shard or ShardWriter(folder, part, seq, width)
                shard.add(doc_id, ids + end)
                if shard.offset >= shard_bytes:
                    yield record_batch(schema, list(zip(shard.close(), strict=True)))
                    shard, seq = None, seq + 1
        if shard:
            yield record_batch(schema, list(zip(shard.close(), strict=True)))

    rows = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    # Range limits are found from a sample of the sort key, which so must not hold texts.
    ordered = (
        rows.withColumn("_hash", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_hash")
        .sortWithinPartitions("doc_id", "_hash", "text")
        .drop("_hash")
    )
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids.

    ``ids`` are unsigned 32-bit little-endian integers whatever the files' width is. Each shard
    is one task, read record by record; every checksum and the index are checked.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = read_manifest(spark, folder).withColumn(
        "base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
         ("ids", pa.binary())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_states()
        fs, root = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                width, start = row["width"], row["base"]
                path = f"{root}/{row['shard']}"
                with fs.open_input_stream(f"{path}.index") as stream:
                    index = np.frombuffer(stream.read(), dtype=INDEX_ROW)
                if len(index) != row["n_docs"]:
                    raise DamagedFile(f"{path}: index")
                out: list[tuple] = []
                held = offset = 0
                with fs.open_input_stream(f"{path}.records", buffer_size=1 << 20) as stream:
                    for doc_id, at, length in index.tolist():
                        payload = read_record(stream, path)
                        own = struct.unpack("<q", payload[:8])[0]
                        if (own, offset, len(payload)) != (doc_id, at, length):
                            raise DamagedFile(f"{path}: index")
                        offset += length + FRAME
                        ids = np.frombuffer(payload, f"<u{width}", offset=8).astype("<u4")
                        out.append((doc_id, start, len(ids), ids.tobytes()))
                        start += len(ids)
                        held += len(payload)
                        if held > 1 << 22:
                            yield record_batch(schema, list(zip(*out, strict=True)))
                            out, held = [], 0
                if out:
                    yield record_batch(schema, list(zip(*out, strict=True)))

    tasks = shards.select("shard", "n_docs", "width", "base")
    tasks = tasks.repartition(max(1, shards.count()), "shard")
    return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(spark: SparkSession, folder: str, doc_ids: DataFrame) -> DataFrame:
    """The asked documents' ids (doc_id, ids), read by offset in the order of the request.

    ``doc_ids`` has a column doc_id. The indexes are joined to the request, and each found
    record is read by itself, as a shuffled training read would.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()),
         ("width", pa.int32())]
    )

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{root}/{row['shard']}.index") as stream:
                    index = np.frombuffer(stream.read(), dtype=INDEX_ROW)
                n = len(index)
                yield record_batch(
                    schema,
                    [index["doc_id"], [row["shard"]] * n, index["offset"].astype("i8"),
                     [row["width"]] * n],
                )

    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for rows in slices(batches):
            found = []
            for row in rows.to_pylist():
                path = f"{root}/{row['shard']}.records"
                with fs.open_input_file(path) as stream:
                    stream.seek(row["offset"])
                    payload = read_record(stream, path)
                found.append(np.frombuffer(payload, f"<u{row['width']}", offset=8).astype("<u4"))
            ids = [x.tobytes() for x in found]
            yield record_batch(out, [rows.column(0).to_pylist(), ids])

    shards = read_manifest(spark, folder).select("shard", "width")
    shards = shards.repartition(max(1, shards.count()), "shard")
    index = shards.mapInArrow(entries, "doc_id long, shard string, offset long, width int")
    wanted = index.join(doc_ids.select("doc_id").distinct(), "doc_id")
    return wanted.mapInArrow(pick, "doc_id long, ids binary")
