"""Token ids of whole texts by the ``tokenizers`` library, with a memory of parts seen before."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fleetlens.llm.common import worker_state

#: Bytes of remembered parts and ids; beyond them those not met for longest are forgotten.
KEPT_BYTES = 24 << 20
#: Letters that no normalizer changes in number, so a run of them is one piece of any text.
PLAIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Marks that may follow a word; a piece begins at the first (an apostrophe may begin another).
MARKS = re.escape(".,!?;:|*$%&#")
#: A part that begins with this one does not follow a blank. Texts that hold it are encoded whole.
NO_BLANK = "\x01"
WORDS_AT_ONCE = 500
#: Texts encoded together; more share more words, fewer take less memory.
ROWS_ENCODED = 4096
#: A blank at the start or after white space of any kind.
ODD = (
    r"(?:^|[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]) "
)


def cut_by_pattern(step: dict) -> bool:
    """Whether a pre-tokenizer is one for which the cuts of :class:`WordEncoder` are exact."""
    if step["type"] == "Sequence":
        return cut_by_pattern(step["pretokenizers"][0])
    if step["type"] == "ByteLevel":
        return step["use_regex"] and not step["add_prefix_space"]
    letters_or_marks = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        step["type"] == "Split"
        and step["invert"]
        and step["behavior"] == "Removed"
        and step["pattern"].get("Regex", "").endswith(letters_or_marks)
    )


class WordEncoder:
    """Ids of texts as little-endian unsigned integers of ``width`` bytes.

    Both kinds of tokenizers used here cut a text into pieces by a pattern and encode each piece
    by itself. No piece goes on from a non-blank into a blank, from a letter into a mark or round
    a single line feed. So a text may be cut before every blank that follows a non-blank, between
    a plain letter and a mark and on both sides of a line feed between a letter or mark and a
    letter; each distinct part is encoded once and the ids are joined. With any other tokenizer
    (:func:`cut_by_pattern`) whole texts are encoded.
    """

    def __init__(self, path: str, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            self.cuts = cut_by_pattern(json.load(file)["pre_tokenizer"] or {"type": None})
        self.kind = f"<u{width}"
        self.width = width
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.by_end = bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))
        self.edge = np.array(
            [x.endswith("</w>") if self.by_end else x.startswith("Ġ") for x in names]
        )
        self.parts = pa.array([], pa.string())
        self.sizes = self.starts = self.met = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)
        self.time = 0

    def ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype=self.kind).tobytes() for x in found]

    def plain_ids(self, words: list[str]) -> list[bytes]:
        """Plain words after a blank, encoded as one text and cut where words begin or end."""
        found: list[bytes] = []
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = words[start : start + WORDS_AT_ONCE]
            text = "".join([f" {x}" for x in some])
            one = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.asarray(one.ids, dtype=np.int64)
            cuts = np.flatnonzero(self.edge[ids]) + self.by_end
            cuts = [0, *cuts.tolist()] if self.by_end else [*cuts.tolist(), len(ids)]
            if len(cuts) == len(some) + 1 and cuts[0] == 0 and cuts[-1] == len(ids):
                whole, w = ids.astype(self.kind).tobytes(), self.width
                found += [whole[a * w : b * w] for a, b in zip(cuts, cuts[1:], strict=False)]
            else:
                found += self.ids([f" {x}" for x in some])
        return found

    def part_ids(self, parts: pa.Array) -> list[bytes]:
        plain = pc.match_substring_regex(parts, f"^[{PLAIN}]+$")
        words = self.plain_ids(parts.filter(plain).to_pylist())
        others = parts.filter(pc.invert(plain)).to_pylist()
        rest = self.ids([x[1:] if x.startswith(NO_BLANK) else f" {x}" for x in others])
        plain = plain.to_numpy(zero_copy_only=False)
        out = np.empty(len(parts), object)
        out[plain], out[~plain] = words, rest
        return out.tolist()

    def known(self, parts: pa.Array) -> np.ndarray:
        """Places of distinct parts among those remembered; new ones are encoded and added."""
        found = pc.index_in(parts, value_set=self.parts)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = parts.take(pa.array(missing))
            ids = self.part_ids(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
            at[missing] = len(self.parts) + np.arange(len(missing))
            starts = len(self.pool) + np.cumsum(sizes) - sizes
            self.parts = pa.concat_arrays([self.parts, new])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.starts = np.concatenate([self.starts, starts])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), self.kind)])
        self.time += 1
        self.met[at] = self.time
        return at

    def gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts at these places one after another, and where each part's end."""
        lengths = self.sizes[at]
        ends = np.cumsum(lengths)
        place = np.repeat(self.starts[at] - (ends - lengths), lengths)
        place += np.arange(len(place))
        return self.pool[place], ends

    def forget(self) -> None:
        """Keeps the parts met last, up to half of ``KEPT_BYTES``, once there are more than that."""
        numbers = 3 * 8 + 4
        if self.parts.nbytes + self.pool.nbytes + numbers * len(self.parts) <= KEPT_BYTES:
            return
        text = pc.binary_length(self.parts).to_numpy().astype(np.int64)
        size = text + numbers + 4 + self.sizes * self.width
        order = np.argsort(-self.met, kind="stable")
        kept = np.sort(order[np.cumsum(size[order]) <= KEPT_BYTES // 2])
        self.pool, ends = self.gathered(kept)
        self.sizes, self.met = self.sizes[kept], self.met[kept]
        self.starts = ends - self.sizes
        self.parts = self.parts.take(pa.array(kept))

    def cut(self, texts: pa.Array) -> pa.Array:
        texts = pc.binary_join_element_wise(NO_BLANK, texts, "")
        gap = f" {NO_BLANK}"
        texts = pc.replace_substring_regex(texts, f"([{PLAIN}])([{MARKS}])", rf"\1{gap}\2")
        around = rf"\1{gap}\n{gap}\2".replace(r"\n", "\n")
        texts = pc.replace_substring_regex(texts, f"([{PLAIN}{MARKS}])\n([{PLAIN}])", around)
        return pc.split_pattern(texts, " ")

    def cut_odd(self, texts: pa.Array) -> pa.Array:
        """Cuts before a blank only where none of any kind goes before it."""
        out = []
        for text in texts.to_pylist():
            head, *rest = text.split(" ")
            whole = [NO_BLANK + head]
            for part in rest:
                if whole[-1] == NO_BLANK or not whole[-1] or whole[-1][-1].isspace():
                    whole[-1] = f"{whole[-1]} {part}"
                else:
                    whole.append(part)
            out.append(whole)
        return pa.array(out, pa.list_(pa.string()))

    def joined(self, cut: pa.Array) -> list[bytes]:
        begins = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        at = self.known(coded.dictionary)[coded.indices.to_numpy()]
        flat, ends = self.gathered(at)
        limits = np.concatenate([[0], ends])[begins].tolist()
        return [flat[a:b].tobytes() for a, b in zip(limits, limits[1:], strict=False)]

    def batch(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text; a null is an empty text.

        Arrow cuts the texts, numbers the distinct parts of the batch and finds those remembered,
        so Python looks at new parts only; numpy then puts ids in the order of the texts. Texts in
        which a blank follows white space are cut by :meth:`cut_odd` instead.
        """
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = texts.fill_null("")
        if not self.cuts:
            return self.ids(texts.to_pylist())
        self.forget()
        whole = pc.match_substring(texts, NO_BLANK)
        odd = pc.and_not(pc.match_substring_regex(texts, ODD), whole)
        even = pc.invert(pc.or_(odd, whole))
        out = [b""] * len(texts)
        ways = (
            (even, lambda some: self.joined(self.cut(some))),
            (odd, lambda some: self.joined(self.cut_odd(some))),
            (whole, lambda some: self.ids(some.to_pylist())),
        )
        for chosen, encode in ways:
            at = np.flatnonzero(chosen.to_numpy(zero_copy_only=False)).tolist()
            if at:
                for i, ids in zip(at, encode(texts.filter(chosen)), strict=True):
                    out[i] = ids
        return out


def encoder(path: str, width: int = 4) -> WordEncoder:
    return worker_state(("encoder", path, width), lambda: WordEncoder(path, width))
