"""The encoder's cuts, its bound memory and tokenizers it does not cut for."""

import json
import random

import pytest

from fleetlens.llm import encoding
from fleetlens.llm.encoding import WordEncoder, cut_by_pattern
from fleetlens.llm.queries import tokenizer_path

FILES = [("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 4)]


def odd_texts(n):
    rng = random.Random(5)
    letters = " \n\t ab'1.,|\xe9\xa0\x1c\x85Σś,\xdf<>\x01é̸"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("kept", [encoding.KEPT_BYTES, 2000])
@pytest.mark.parametrize("name,width", FILES)
def test_cut_texts_give_the_ids_of_whole_texts(monkeypatch, name, width, kept):
    monkeypatch.setattr(encoding, "KEPT_BYTES", kept)
    encoder = WordEncoder(tokenizer_path(name), width)
    texts = ["", None, "\x01a", "a \x01b", "a\x01,", "it's, a\nB.\nC;d", "<|endoftext|>, a", *odd_texts(1500)]
    for start in range(0, len(texts), 400):
        some = texts[start : start + 400]
        assert encoder.batch(some) == encoder.ids([x or "" for x in some])


def test_memory_stays_below_its_bound(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_BYTES", 20_000)
    encoder = WordEncoder(tokenizer_path("byte_bpe_50k.json"), 2)
    rng = random.Random(1)
    for _ in range(20):
        text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000))
        assert encoder.batch([text]) == encoder.ids([text])
    encoder.forget()
    assert encoder.parts.nbytes + encoder.pool.nbytes <= 20_000


def test_another_pattern_is_not_cut(tmp_path):
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        model = json.load(file)
    assert cut_by_pattern(model["pre_tokenizer"])
    model["pre_tokenizer"]["use_regex"] = False
    assert not cut_by_pattern(model["pre_tokenizer"])
    path = tmp_path / "other.json"
    path.write_text(json.dumps(model), encoding="utf-8")
    encoder = WordEncoder(str(path))
    texts = ["the cat, the dog\nThe", None, "a  b"]
    assert encoder.batch(texts) == encoder.ids([x or "" for x in texts])
