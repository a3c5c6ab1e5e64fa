"""Language by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fleetlens.llm.common import record_batch, slices, worker_state
from fleetlens.operators.ranking import top_per_group

#: Bounds of the sample a dictionary is made of, per language: documents, characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 1_000
#: Places of a longer text that its characters are taken from, evenly from beginning to end.
PIECES = 10
#: Bytes of a text that are compressed at a time, so that a long text cannot teach itself.
BLOCK_BYTES = 16_384
LEVEL = 5
#: Least relative distance of the two smallest sizes; below it the answer is rejected.
NARROW = 0.01
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower case, and one blank for whatever is not a letter: marks and capitals have no language."""
    return OTHER.sub(" ", text.lower())


def pieces(chars: int) -> Column:
    """The whole text, or ``PIECES`` parts from all over it that make ``chars`` characters."""
    text, size = F.col("text"), max(1, chars // PIECES)
    last = F.length(text) - size
    some = [
        F.substring(text, (1 + F.floor(last * i / (PIECES - 1))).cast("int"), F.lit(size))
        for i in range(PIECES)
    ]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws(" ", *some))


def learn_dictionaries(
    docs: DataFrame,
    learn: Column,
    *,
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
) -> dict[str, bytes]:
    """Raw-content dictionaries by language from the rows (doc_id, text, lang) that ``learn`` names.

    A bounded sample: per language the ``sample_docs`` distinct texts first by hash, and of each
    ``sample_chars`` characters from all over it, letters only. Rows without text or language
    teach nothing. Hashes are made distinct and chosen without the texts, and the driver gets
    the bounded sample only. Languages come in the order of their rows, most first,
    which decides ties. A table without such rows gives no dictionary.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull() & (F.trim("text") != "")).select(
        "lang", F.xxhash64("text").alias("_hash"), "text"
    )
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    hashes = rows.select("lang", "_hash").distinct()
    first = F.broadcast(top_per_group(hashes, ["lang"], [F.col("_hash")], sample_docs))
    chosen = rows.join(first, ["lang", "_hash"])
    sample = chosen.select("lang", "_hash", pieces(sample_chars).alias("_text")).distinct().collect()
    found: dict[str, list[str]] = {}
    for row in sorted(sample, key=lambda r: (r["_hash"], r["_text"])):
        found.setdefault(row["lang"], []).append(row["_text"])
    order = sorted(found, key=lambda k: (-size[k], k))
    return {k: " ".join(map(letters, found[k])).encode("utf-8", "replace") for k in order}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.by_language = {}
        for name, raw in dictionaries.items():
            kept = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(level=LEVEL)
            self.by_language[name] = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=kept, write_content_size=False, write_dict_id=False
            )

    def sizes(self, text: str) -> list[tuple[int, str]]:
        """Total compressed size by language, smallest first, ties in the order learned."""
        data = letters(text).encode("utf-8", "replace")
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [
            (sum(len(c.compress(b)) for b in blocks), name) for name, c in self.by_language.items()
        ]
        return sorted(sizes, key=lambda x: x[0])


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], *, narrow: float = NARROW
) -> DataFrame:
    """Adds lang_pred, score, margin and rejected to ``docs``, which needs a column text.

    The whole text's letters are compressed with each dictionary in blocks, and the language
    with the smallest total is chosen. ``margin`` is the distance to the second smallest total as
    a share of it; ``score`` = margin / (margin + narrow), so a rejected answer scores under 0.5.
    A text that is null or has no letter, and any text when nothing was learned, is ``und`` with
    score 0 and rejected. With one language only there is no rival, and the margin is 1. Equal
    sizes are a margin of 0. Columns of ``docs`` with these names are replaced.
    """
    added = ["lang_pred", "score", "margin", "rejected"]
    rows = docs.drop(*added)
    at = rows.columns.index("text")
    kinds = dict(zip(added, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True))
    arrow = pa.schema(
        [("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()),
         ("rejected", pa.bool_())]
    )
    key = hashlib.sha256(repr(list(dictionaries.items())).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def answer(text: str | None, kept: Compressors) -> tuple:
        if not text or not kept.by_language or not LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0, True
        sizes = kept.sizes(text)
        best, rival = sizes[0], sizes[1] if len(sizes) > 1 else None
        margin = (rival[0] - best[0]) / rival[0] if rival else 1.0
        score = margin / (margin + narrow) if margin + narrow > 0 else 0.0
        return best[1], score, margin, margin < narrow

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_state(("zstd", key), lambda: Compressors(shared.value))
        for part in slices(batches):
            found = [answer(text, kept) for text in part.column(at).to_pylist()]
            more = record_batch(arrow, list(zip(*found, strict=True)))
            schema = part.schema
            for field in arrow:
                schema = schema.append(field)
            yield pa.RecordBatch.from_arrays([*part.columns, *more.columns], schema=schema)

    more = [T.StructField(name, kinds[name]) for name in added]
    return rows.mapInArrow(predict, T.StructType([*rows.schema.fields, *more]))
