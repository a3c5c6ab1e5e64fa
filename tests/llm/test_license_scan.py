"""License notices: the index against every alignment, hand cases, and the query against its SQL."""

import random
from collections import Counter

from compare import difference, oracle
from fleetlens.llm import license_scan as ls, queries

SF = "/root/testdata/sf0.001"


def brute(rows, notices, share):
    """Every notice at every place of every text."""
    templates = [ls.template(*n) for n in notices]
    words = [ls.words_of(t) for _, t in rows]
    df = Counter(w for some in words for w in set(some))
    out = []
    for some in words:
        found = []
        for n, t in enumerate(templates):
            weight = [ls.weight_of(len(rows), df[w]) for w in t.words]
            for begin in range(-len(t.words) + 1, len(some)):
                stand = {q for q, w in enumerate(t.words) if 0 <= begin + q < len(some) and some[begin + q] == w}
                got = sum(weight[q] for q in stand)
                if 100 * got >= share * sum(weight) and t.must <= stand:
                    found.append((n, begin, got / sum(weight)))
        out.append(found)
    return templates, out


def test_every_alignment_is_found(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    notices = [
        (f"l{n}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))), ()) for n in range(25)
    ]
    notices = [(label, text, (text.split()[-1],)) for label, text, _ in notices]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (50, 75, 100):
        templates, wanted = brute(rows, notices, share)
        got = {r["doc_id"]: r for r in ls.scan(docs, notices, (("x", "w1 w2"),), share).collect()}
        assert any(wanted)
        for (i, _), found in zip(rows, wanted):
            ours = [(m["label"], m["start"], m["share"]) for m in got[i]["matches"]]
            assert ours == [(templates[n].label, p, s) for n, p, s in found]


def test_phrases_nulls_repeats_and_clashing_names(spark):
    rows = [
        (1, "The MIT  License, the Apache\nLicense; GNU GENERAL PUBLIC LICENSE. MIT License"), (2, None), (3, ""),
        (4, "mit licenseé"), (4, "Licensed under CC BY-NC 4.0."), (None, "All rights reserved"),
        (5, "x " * 30_000 + "permission\nto use, copy, modify and / or DISTRIBUTE some software for any purpose "
            "with or without fee is hereby granted"),
        (6, "ÀMIT license mit-license"), (6, "ÀMIT license mit-license"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 as labels", "'a' as matches", "2 as n_words", "'b' as word"
    )
    got = sorted((tuple(r)[:8] for r in ls.scan(docs).collect()), key=repr)
    first = (1, 12, 4, 1, 10, "apache,gpl,mit", "apache,gpl,mit", 1.0)
    assert first in got
    assert (2, 0, 0, None, None, "", "", 0.0) in got and (3, 0, 0, None, None, "", "", 0.0) in got
    assert (4, 2, 0, None, None, "", "", 0.0) in got
    assert (4, 7, 0, None, None, "", "cc-by-nc", 1.0) in got
    assert (None, 3, 0, None, None, "", "all-rights-reserved", 1.0) in got
    # One word of the notice is another, so a little of its weight is missing.
    assert [(r[6], 0.75 < r[7] < 1) for r in got if r[0] == 5] == [("isc", True)]
    assert got.count((6, 4, 1, 2, 2, "mit", "mit", 1.0)) == 2
    assert ls.scan(docs.limit(0)).collect() == []


def test_query_equals_sql(spark):
    found, n = difference(spark, SF, oracle(SF), queries.op11_license_scan, queries.SQL["op11_license_scan"])
    assert found is None and n == 200
