"""Near duplicates by five words and 0.8, in the operator and in the pipeline's stage."""

import random

import pytest
from test_operators import brute_components, words

import corpus_pipeline
from fleetlens.llm import jaccard


def near_copies(rng):
    rows = []
    for group in range(25):
        base = words(rng, rng.choice([3, 6, 9, 14, 40, 120]), 500).split()
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = f"new{rng.randrange(9)}"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("n, percent", [(5, 80), (3, 80), (5, 50)])
def test_components_at_lower_similarity(spark, n, percent):
    rows = near_copies(random.Random(n * percent))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_components(docs, n=n, percent=percent).collect()), key=repr)
    wanted = brute_components(rows, percent, n)
    sifted = jaccard.near_components(docs, n=n, percent=percent, sift=True).collect()
    assert sorted(map(tuple, sifted), key=repr) == wanted
    assert got == wanted and any(i != c for i, _, c in wanted)


def test_boundaries_follow_the_similarity():
    assert jaccard.boundaries(90) == jaccard.BOUNDARIES
    assert jaccard.boundaries(80) == (0, 9)
    assert all(len(jaccard.boundaries(p)) >= 1 for p in (30, 50, 99, 100))


def test_only_the_copy_goes(spark):
    rng = random.Random(2)
    text, other = words(rng, 60, 300), words(rng, 60, 300)
    rows = [(1, text, "a"), (2, text, "b"), (2, other, "c"), (3, None, "d"), (3, None, "d"), (4, "", "e"), (None, text, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").selectExpr(
        "*", "'en' as lang", "'s' as source", "1L as n_chars", "2 as text_hash", "3 as component_id"
    )
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["score"]) for r in kept.collect()) == [(0, "f"), (1, "a"), (2, "c"), (3, "d"), (4, "e")]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_language_keeps_columns_of_the_same_names(spark):
    sounds = {"aa": "the of and ing tion".split(), "bb": "der und sch ein keit".split()}
    rng = random.Random(4)
    rows = [
        (i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(2)) for _ in range(60)), lang, f"s{i}", f"m{i}")
        for i, lang in enumerate(list(sounds) * 40)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, margin string")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    found = kept.collect()
    assert len(found) > 70 and all((r["score"], r["margin"]) == (f"s{r['doc_id']}", f"m{r['doc_id']}") for r in found)
