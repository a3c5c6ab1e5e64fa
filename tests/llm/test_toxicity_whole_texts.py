"""Toxicity looks at every word of a text, wherever it stands."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fleetlens.llm import toxicity


def terms_of(text):
    return Counter(t for w in (text or "").split() for t in toxicity.word_terms(w))


def test_terms_of_a_batch_are_those_of_each_whole_text():
    rng = random.Random(5)
    words = ["Idiot!", "idiocy", "(the)", "the", "-", "straße", "İstanbul", "x1", "unknownword", "ab", "_" + "Long" * 40, "é" * 70]
    texts = [None, "", "  \n", *(" \t".join(rng.choices(words, k=n)) for n in (1, 3, 900)), " the the\x1cthe "]
    held = {toxicity.term_hash(t): t for w in words if w != "unknownword" for t in toxicity.word_terms(w)}
    hashes = np.array(sorted(held))
    finder = toxicity.TermFinder(hashes, names=pa.array([toxicity.term_name(held[h]) for h in hashes.tolist()]))
    terms, times, sizes, n_words = finder.batch(pa.array(texts))
    ends = np.cumsum(sizes)
    for i, text in enumerate(texts):
        own = slice(ends[i] - sizes[i], ends[i])
        known = {toxicity.term_hash(t): n for t, n in terms_of(text).items()}
        expected = {int(np.searchsorted(hashes, t)): n for t, n in known.items() if t in set(hashes.tolist())}
        assert dict(zip(terms[own].tolist(), times[own].tolist(), strict=True)) == expected
        assert terms[own].tolist() == sorted(expected) and n_words[i] == len((text or "").split())
    assert [len(x) for x in finder.batch(pa.array([], pa.string()))] == [0, 0, 0, 0]


def test_similarity_is_that_of_all_words(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(90, 250)))) for i in range(300)]
    bad = {i: rng.sample(["vilest", "foulish", "grimmer"], 2) for i in range(0, 300, 3)}
    rows = [(i, f"{text} {' '.join(bad.get(i, []))}") for i, text in rows]  # far from the beginning
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.learn(table, marks, F.col("doc_id") < 200)
    counts = {i: terms_of(text) for i, text in rows}
    df = Counter(t for c in counts.values() for t in c)
    examples = {t for i in range(200) for t in counts[i]}
    assert {"vilest", "foulish", "grimmer"} <= set(model.telling)
    vectors = {}
    for i, c in counts.items():
        gain = 0.5 * (np.sqrt(len(rows[i][1].split()) / 16) - 1)
        v = {t: (np.log(301 / (1 + df[t])) + 1) * (1 + np.log(n)) * (1 + gain * model.telling.get(t, 0))
             for t, n in c.items() if t in examples}
        norm = np.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / norm for t, x in v.items()}
    cosine = [[sum(x * vectors[j].get(t, 0) for t, x in v.items()) for j in range(200)] for v in vectors.values()]
    for head, block in ((256, 256), (3, 8), (0, 4)):
        monkeypatch.setattr(toxicity, "HEAD", head)
        monkeypatch.setattr(toxicity, "BLOCK", block)
        fresh = toxicity.Model(**{f: getattr(model, f) for f in toxicity.Model.__dataclass_fields__ if f != "unit"})
        finder = toxicity.TermFinder(model.terms, model.telling, model.names)
        terms, times, sizes, words = finder.batch(pa.array([text for _, text in rows]))
        found = fresh.nearest_of_each(terms, fresh.weights(terms, times, sizes, words), sizes)
        for (i, _), near in zip(rows, found, strict=True):
            assert np.allclose([s for s, _ in near], np.sort(cosine[i])[:-26:-1])
            assert np.allclose([cosine[i][model.ids[at]] for _, at in near], [s for s, _ in near])
    for r in toxicity.score(table.filter("doc_id >= 200"), model).collect():
        assert (r["score"] >= 0.5) == (r["doc_id"] % 3 == 0)
        shown = " ".join(r["passages"]).split()
        assert set(bad.get(r["doc_id"], [])) <= set(shown) and (shown or r["score"] < 0.5)
