"""Sifted near duplicates meet in the lists of their rarest elements, not by any passage in common."""

import random
from collections import Counter

import pytest
from test_operators import brute_components, words
from test_pipeline_duplicates import near_copies

from fleetlens.llm import jaccard


def changed(rng, text, times):
    text = text.split()
    for _ in range(times):
        text[rng.randrange(len(text))] = f"new{rng.randrange(9)}"
    return " ".join(text)


def mosaics(rng, docs=180, passages=6, used=3):
    """Texts of passages that each are in a few of them, so that hardly an element is in one only."""
    pool = [words(rng, 20, 10**6) for _ in range(docs * passages // used)] * used
    rng.shuffle(pool)
    texts = [" ".join(pool[i * passages : (i + 1) * passages]) for i in range(docs)]
    texts += [changed(rng, t, 1) for t in texts[:20]]
    return list(enumerate(texts))


def components(spark, rows, n=5, percent=80):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.near_components(docs, n=n, percent=percent, sift=True).collect()
    return sorted(map(tuple, found), key=repr)


def test_passages_in_common_make_no_large_family(spark, monkeypatch):
    rows, largest, before = mosaics(random.Random(5), 500, 12), [], jaccard._family_links

    def spy(rows, families, *more):
        largest.append(max(Counter(r["root"] for r in families.collect()).values()))
        return before(rows, families, *more)

    monkeypatch.setattr(jaccard, "_family_links", spy)
    assert components(spark, rows) == brute_components(rows, 80, 5)
    assert 2 <= largest[0] <= 12


@pytest.mark.parametrize("paired, share", [(8, 16), (1, 16), (8, 3), (2, 1000)])
@pytest.mark.parametrize("n, percent", [(5, 80), (3, 60)])
def test_rare_lists_equal_brute_force(spark, monkeypatch, paired, share, n, percent):
    monkeypatch.setattr(jaccard, "PAIRED_SETS", paired)
    monkeypatch.setattr(jaccard, "RARE_SHARE", share)
    monkeypatch.setattr(jaccard, "SENT_IDS", share)  # ids are sent, or texts shuffled
    rng = random.Random(paired + share + n)
    rows, base = near_copies(rng) + [(1000 + i, t) for i, t in mosaics(rng, 30)], words(rng, 60, 10**6)
    rows += [(2000 + i, changed(rng, base, rng.randrange(4))) for i in range(25)]
    rows += [(i, t.upper()) for i, t in rows[:60:2]] + rows[-10:]  # sets that an id has twice
    assert components(spark, rows, n, percent) == brute_components(rows, percent, n)
