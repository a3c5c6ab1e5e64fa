"""The lists of a text's terms are added in one pass, and closed blocks hold none of its neighbours."""

import numpy as np
import pyarrow as pa

from fleetlens.llm import toxicity


def small_model(rng, n_terms=60, n_examples=120):
    counts = rng.integers(1, 4, (n_terms, n_examples)) * (rng.random((n_terms, n_examples)) < 0.2)
    counts[0, :10] = 3  # no example is empty, and a few share a term
    counts[1, 10:] = 1
    term, at = np.nonzero(counts)
    begins = np.searchsorted(term, np.arange(n_terms + 1))
    none = np.zeros(n_terms)
    return toxicity.Model(
        np.arange(n_terms), pa.array([], pa.string()), 1 + 3 * rng.random(n_terms), 0.5, 0.5,
        np.ones((n_examples, 2)), list(range(n_examples)), begins, at, counts[term, at], {}, none,
        np.ones(n_examples, np.int64),
    )


def test_one_pass(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(toxicity, "BLOCK", 10)
    monkeypatch.setattr(toxicity, "HEAD", 2)
    model, plain, read = small_model(rng).prepare(), toxicity.spans, []

    def spans(begins, ends):
        read.append(int((ends - begins).sum()))
        return plain(begins, ends)

    monkeypatch.setattr(toxicity, "spans", spans)
    dense = np.zeros((60, 120))
    for t, (at, weight) in enumerate(model.postings):
        dense[t, at] = weight
    for _ in range(300):
        terms = np.unique(np.append(rng.integers(0, 60, 8), 0))
        weights = model.weights(terms, np.ones(len(terms)), np.array([len(terms)]), np.array([9]))
        read.clear()
        found = model.nearest(terms, weights, 5)
        cosine = weights @ dense[terms]
        assert np.allclose([s for s, _ in found], np.sort(cosine[cosine > 0])[::-1][:5])
        assert np.allclose([cosine[i] for _, i in found], [s for s, _ in found])
        assert len(read) == 1 and read[0] <= np.diff(model.begins)[terms].sum()
