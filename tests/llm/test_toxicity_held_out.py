"""Toxicity on rows that were not learned from, and the windows it looks up."""

import os

import numpy as np
import pytest

from fleetlens.llm import toxicity
from fleetlens.llm.queries import op1_toxicity

TABLES = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables are not here")
def test_held_out_toxic_documents_are_found(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", "toxic")
    found = op1_toxicity(spark, TABLES)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.filter("held_out").join(labels.filter("toxic is not null"), "doc_id").collect()
    toxic = sum(r["toxic"] for r in rows)
    right = sum(r["predicted"] and r["toxic"] for r in rows)
    assert toxic > 100 and right >= 0.75 * toxic
    assert right >= 0.9 * sum(r["predicted"] for r in rows)
    order = np.argsort(np.argsort([r["score"] for r in rows]))
    marks = np.array([r["toxic"] for r in rows]) == 1
    ahead = order[marks].sum() - toxic * (toxic - 1) / 2
    print("right", right, "of", toxic, "predicted", sum(r["predicted"] for r in rows),
          "auc", ahead / toxic / (len(rows) - toxic))
    assert ahead >= 0.9 * toxic * (len(rows) - toxic)
    assert all((r["score"] >= 0.7) == r["predicted"] and 0 <= r["score"] <= 1 for r in rows)


def test_windows_are_the_heaviest_of_the_whole_text():
    rng = np.random.default_rng(3)
    finder = toxicity.TermFinder(np.empty(0, np.int64), {"vile": 1.0, "foul-": 2.0, "mean": 4.0})
    for n in (0, 1, 15, 16, 17, 40, 700):
        words = [f"{w}{'.' * rng.integers(2)}" for w in rng.choice(["a", "bc", "ab", "x1", "vile", "foul", "Mean"], n)]
        finder.windows(" ".join(words))
        left = list(range(max(1, n - toxicity.WINDOW + 1)))
        expected = []
        while left and len(expected) < toxicity.WINDOWS:
            weight = {i: sum(finder.marks.get(w, 0) for w in words[i : i + toxicity.WINDOW]) for i in left}
            best = max(left, key=lambda i: (weight[i], -i))
            told = weight[best] >= 1000 or not expected
            expected.append((words[best : best + toxicity.WINDOW], told))
            left = [i for i in left if abs(i - best) >= toxicity.WINDOW]
        assert finder.windows("  ".join(words)) == expected


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity.TermFinder, "MOST_BYTES", 10_000)
    finder = toxicity.TermFinder(np.empty(0, np.int64), {})
    for i in range(50):
        words = [f"w{i}x{j}" for j in range(30)] + ["y" * 500]
        finder.windows(" ".join(words))
        finder.counts(words)
        assert finder.held <= 10_000 + 2 * 31 * 1000 + 2000
