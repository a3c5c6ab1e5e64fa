"""Each operator on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from conftest import plan
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import (
    chat, components, decontamination, jaccard, language_id, packing, quality, queries, secrets,
    substring_dedup, token_files, toxicity,
)
from fleetlens.llm.encoding import WordEncoder

SF = "/root/testdata/sf0.001"
BYTES, WORDS = (queries.tokenizer_path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside; as extra columns they must not matter.
EXTRA = "length long, _row long, _hash long, seed long, role string, score double, label int"


def words(rng, n, size=30):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = words(rng, 300, 400)
    near = base.split()
    near[150] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r "),
        (7, "One"), (8, "one"), (9, "two words"), (10, "A B c"), (11, "a b C"),
        (12, words(rng, 60) + "\n" + base + " " + words(rng, 30)), (13, words(rng, 5000, 900)),
        (14, "x" * 50_000), (15, ("same line of words here\n") * 40), (15, "another text of id 15"),
        (7, "One"), (None, base), (None, None), (16, "ünï ß ÀÉ 中文 🙂 \x00 nul"), (17, "a\xa0b\x85c d"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for field in EXTRA.split(", "):
        name, kind = field.split()
        table = table.withColumn(name, F.lit(1).cast(kind))
    return table


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def empty(docs):
    return docs.filter(F.lit(False))


def test_encoder_joins_parts_exactly():
    rng = random.Random(0)
    some = ["", " a", "a  b", "a \n b", "a\n\n b c", "x\x1c y", "a\xa0 b", "  ", "it's 'S ß Σας, Σ b.\nThe"]
    some += ["".join(rng.choice(" \n\t ab'1.é\xa0\x1c\x85Σś,ß") for _ in range(rng.randint(1, 25)))
             for _ in range(1500)]
    for path, width in ((BYTES, 2), (WORDS, 4)):
        encoder = WordEncoder(path, width)
        for _ in range(2):
            assert encoder.batch(some) == encoder.ids(some)


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    out = f"file://{tmp_path}/a"
    encoder = WordEncoder(BYTES)
    manifest = token_files.write_token_files(docs, out, BYTES, 2, shard_bytes=4000)
    assert manifest.count() > 3
    named = [(i, t or "") for i, t in texts if i is not None]
    ids = {t: encoder.ids([t])[0] + struct.pack("<I", 2) for _, t in named}
    found = sorted(token_files.read_token_files(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted(i for i, _ in named)
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in found) == sorted((i, ids[t]) for i, t in named)
    assert [r["start"] for r in found] == [sum(len(x["ids"]) // 4 for x in found[:k]) for k in range(len(found))]
    asked = spark.createDataFrame([(14,), (3,), (99,)], "doc_id long")
    picked = {r["doc_id"]: bytes(r["ids"]) for r in token_files.read_documents(spark, out, asked).collect()}
    by_id = dict(named)
    assert picked == {i: ids[by_id[i]] for i in (14, 3)}
    none = f"file://{tmp_path}/b"
    token_files.write_token_files(empty(docs), none, BYTES, 2)
    assert token_files.read_token_files(spark, none).count() == 0


def test_token_files_notice_damage(spark, docs, tmp_path):
    token_files.write_token_files(docs.filter("doc_id = 13"), f"file://{tmp_path}/a", BYTES, 2)
    (file,) = (tmp_path / "a").glob("*.records")
    raw = bytearray(file.read_bytes())
    raw[100] ^= 1
    file.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="DamagedFile"):
        token_files.read_token_files(spark, f"file://{tmp_path}/a").collect()


def test_masked_checksum():
    crc = zlib.crc32(b"abc")
    assert token_files.masked(b"abc") == ((crc >> 15 | crc << 17) + 0xA282EAD8) % 2**32


def test_best_fit_and_bound():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 13, rng.integers(1, 9))
        bins, at = packing.best_fit_decreasing(sizes, 12)
        for b in range(bins.max() + 1):
            mine = sorted(zip(at[bins == b].tolist(), sizes[bins == b].tolist(), strict=True))
            assert [a for a, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))]
            assert sum(n for _, n in mine) <= 12
        least = fewest(sorted(sizes.tolist(), reverse=True), 12)
        assert packing.lower_bound(sizes, 12) <= least <= bins.max() + 1
    assert packing.lower_bound(np.array([7, 7, 7]), 12) == 3
    assert packing.lower_bound(np.array([5, 5, 5, 5, 5]), 12) == 3


def fewest(sizes, capacity):
    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacity and bins[b] not in bins[:b]:
                go(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    best = len(sizes) + 1
    go(0, [])
    return best


@pytest.mark.parametrize("per_partition", [40, 5000])
def test_packing_is_gapless_and_tight(spark, per_partition):
    rng = random.Random(3)
    sizes = [rng.randint(1, 100) for _ in range(1500)] + [100] * 50 + [51] * 60
    pieces = spark.createDataFrame([(7, n) for n in sizes], "doc_id long, length long")
    found = packing.pack(pieces, 100, partition_pieces=per_partition, fan_in=4).collect()
    assert sorted(r["length"] for r in found) == sorted(sizes)
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for some in bins.values():
        some.sort()
        assert [a for a, _ in some] == [sum(n for _, n in some[:k]) for k in range(len(some))]
        assert sum(n for _, n in some) <= 100
    least = packing.lower_bound(np.array(sizes), 100)
    # Partitions of 40 pieces hand over 10 at most.
    assert len(bins) <= least * (1.07 if per_partition == 40 else 1.005) + 1


def test_token_packing(docs, texts):
    found = packing.token_packing(docs, WORDS, 1, 64).collect()
    encoder = WordEncoder(WORDS)
    expected = []
    for i, t in texts:
        ids = encoder.ids([t or ""])[0] + struct.pack("<I", 1)
        for piece, a in enumerate(range(0, len(ids), 256)):
            part = ids[a : a + 256]
            expected.append((i, piece, a // 4, len(part) // 4, zlib.crc32(part)))
    got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert packing.token_packing(empty(docs), WORDS, 1, 64).count() == 0


def brute_measures(text):
    w = WORD.findall(text or "")
    runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    counts = {}
    for r in runs:
        counts[r] = counts.get(r, 0) + 1
    covered = {p for k, r in enumerate(runs) if counts[r] > 1 for p in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_native_plan(docs, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.judge(docs)
    got = sorted(((r["doc_id"], *(r[n] for n in names)) for r in judged.collect()), key=repr)
    assert got == sorted(((i, *brute_measures(t)) for i, t in texts), key=repr)
    for r in judged.collect():
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    for df in (quality.measures(docs), judged):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)
    assert quality.judge(empty(docs)).count() == 0


def test_label_model_finds_accuracies():
    rng = random.Random(2)
    patterns = {}
    for _ in range(20_000):
        good = rng.random() < 0.85
        vote = []
        for right_good, right_bad in ((0.98, 0.7), (0.95, 0.6), (0.99, 0.5)):
            right = rng.random() < (right_good if good else right_bad)
            v = (1 if good else -1) * (1 if right else -1)
            vote.append(v if rng.random() < 0.9 else 0)
        patterns[tuple(vote)] = patterns.get(tuple(vote), 0) + 1
    model = quality.fit(patterns, 3)
    assert abs(model.prior - 0.85) < 0.05
    assert np.allclose(model.right_good, (0.98, 0.95, 0.99), atol=0.04)
    assert np.allclose(model.right_bad, (0.7, 0.6, 0.5), atol=0.12)
    assert model.log_odds((0, 0, 0)) == pytest.approx(np.log(model.prior / (1 - model.prior)))


def brute_components(rows, percent=90, n=3):
    sets = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        runs = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else []
        sets.append((i, frozenset(runs)))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if None not in (sets[a][0], sets[b][0]) and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, x) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(x), None if i is None else least[root(k)]) for k, (i, x) in enumerate(sets)), key=repr)


def near_rows(rng):
    """Texts around the threshold, of sizes on both sides of every boundary."""
    rows, number = [], 0
    for size in (3, 8, 10, 11, 12, 19, 20, 21, 22, 29, 30, 31, 40, 60, 61, 100, 200):
        for _ in range(3):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for _ in range(6):
                own = list(base)
                for _ in range(rng.randint(0, max(1, size // 40 + 1))):
                    at = rng.randrange(len(own) + 1)
                    own[at : at + rng.randint(0, 1)] = [f"x{rng.randrange(9)}"] * rng.randint(0, 1)
                rows.append((number, " ".join(own).upper() if rng.random() < 0.3 else " ".join(own)))
                number += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("boundary", [0, 9, 18, 28, None])
def test_jaccard_equals_brute_force(spark, monkeypatch, boundary):
    rows = near_rows(random.Random(11))
    if boundary is not None:
        monkeypatch.setattr(jaccard, "choose_boundary", lambda *a: boundary)
    if boundary == 18:
        monkeypatch.setattr(jaccard, "FAMILY_SHINGLES", 60)  # families go block by block
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_components(table).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_components(rows)


def test_jaccard_edges(docs, texts):
    rows = [x for x in texts if x[0] not in (7, 15)]
    got = jaccard.near_components(docs.filter("doc_id is null or doc_id not in (7, 15)")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_components(rows)
    assert jaccard.near_components(empty(docs)).count() == 0
    seven = jaccard.near_components(docs.filter("doc_id in (7, 8)")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in seven} == {(7, 7), (8, 7)}


def test_list_keys_meet_for_all_linked_sizes():
    rng = np.random.default_rng(4)
    for percent, boundary, size in product((90, 80), (0, 18), (1, 5, 9, 10, 19, 20, 27, 33, 64)):
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        for _ in range(6):
            y = np.delete(x, rng.permutation(len(x))[: rng.integers(0, 3)])
            y = np.unique(np.concatenate([y, rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64)]))
            shared = len(np.intersect1d(x, y))
            if len(y) and 100 * shared >= percent * (len(x) + len(y) - shared):
                a, b = (jaccard.list_keys(s, boundary, percent) for s in (x, y))
                assert set(a) & set(b)


def test_components_of_paths_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 199)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(
        [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 130)] + [(199, 199), (200, 199)]
    )


def brute_dedup(rows):
    first = {}
    named = sorted((x for x in rows if x[0] is not None), key=lambda x: x[0])
    for i, t in named:
        w = WORD.findall(t or "")
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 19):
            if i is not None and first[tuple(w[k : k + 20])] < (i, k):
                gone.update(range(k, k + 20))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup_equals_brute_force(spark, docs, texts):
    rng = random.Random(9)
    rows = [x for x in texts if x[0] != 15]
    shared = [words(rng, n, 10**6) for n in (19, 20, 21, 50, 120)]
    for i in range(100, 160):
        parts = [words(rng, rng.randint(0, 30), 10**6), rng.choice(shared), words(rng, 5, 50)]
        rows.append((i, " \n".join(parts) + " " + (rng.choice(shared) if i % 3 else "")))
    rows += [(200, "a " * 500), (201, "a b " * 100)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    found = substring_dedup.dedup(table).collect()
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in found]
    assert sorted(got, key=repr) == brute_dedup(rows)
    whole = {r["doc_id"]: r["paths"] for r in found}
    assert [(p["start"], p["n_words"], p["from_id"], p["from_start"]) for p in whole[2]] == [(0, 300, 1, 0)]
    assert substring_dedup.dedup(empty(docs)).count() == 0


def test_substring_dedup_of_one_id_with_two_texts(spark):
    rng = random.Random(1)
    a = words(rng, 30, 10**6)
    rows = [(5, a), (5, f"{words(rng, 9)} {a}"), (5, a)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted((r["n_words"], r["n_removed"]) for r in got)
    assert removed in ([(30, 0), (30, 0), (39, 30)], [(30, 30), (30, 30), (39, 0)])


def test_very_long_texts_are_cut_with_overlap(monkeypatch):
    rng = random.Random(6)
    text = words(rng, 700, 50)
    whole = dict(edges_of(text))
    monkeypatch.setattr(substring_dedup, "WORDS_AT_ONCE", 100)
    assert dict(edges_of(text)) == whole and len(whole) == 681


def edges_of(text):
    for _, start, n, _, content, _ in substring_dedup._document_runs([text], substring_dedup.WordHashes()):
        for s, m in zip(start.tolist(), n.tolist(), strict=True):
            yield from ((s + k, True) for k in range(m))


def test_language_id(spark, docs):
    rng = random.Random(4)
    sounds = {"aa": "the of and ing tion".split(), "bb": "der und sch ein keit".split(), "cc": "que les ment eau".split()}

    def text(lang, n):
        return " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(list(sounds) * 60)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, text("bb", 40).upper() + " !!! 123", None), (503, "12 34", "aa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(9))
    kept = language_id.learn_dictionaries(table, F.col("doc_id") < 90)
    found = {r["doc_id"]: r for r in language_id.identify(table, kept).collect()}
    right = [found[i]["lang_pred"] == lang for i, _, lang in rows[90:180]]
    assert np.mean(right) > 0.97
    assert found[502]["lang_pred"] == "bb" and not found[502]["rejected"]
    for i in (500, 501, 503):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 and (r["score"] < 0.5) == r["rejected"] for r in found.values())
    assert language_id.learn_dictionaries(table, F.lit(False)) == {}
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.identify(empty(table), kept).count() == 0


def test_toxicity(spark, docs):
    rng = random.Random(8)
    bad = ["vilean", "vileor", "grumer", "gruming", "nastox"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [f"w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", ",", "."])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic) if i % 97 else None))
    rows += [(900, None), (901, ""), (902, "vilething grumoth nastox"), (903, "w1 w2 w3"), (903, "w1 w2 w3")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(1))
    marks = spark.createDataFrame(labels + [(None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.learn(table, marks, F.col("doc_id") < 400)
    found = toxicity.score(table, model).collect()
    scores = {r["doc_id"]: r["score"] for r in found}
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    held = range(400, 600)
    assert np.mean([(scores[i] >= 0.7) == (i % 5 == 0) for i in held]) > 0.97
    assert scores[902] > 0.7 > 0.3 > scores[903] and scores[900] == scores[901] < 0.3
    assert toxicity.learn(table, marks.filter("toxic = 0"), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(empty(table), model).count() == 0
    nearest_is_exact(model, rng)


def nearest_is_exact(model, rng):
    dense = np.zeros((len(model.ids), len(model.postings)))
    for t, (at, w) in enumerate(model.postings):
        dense[at, t] = w
    for _ in range(50):
        counts = {rng.randrange(len(model.postings)): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        terms, weights = model.vector(counts)
        cosine = dense[:, terms] @ weights
        order = sorted(np.flatnonzero(cosine > 0).tolist(), key=lambda i: (-round(cosine[i], 12), i))[:5]
        assert [i for _, i in model.nearest(terms, weights, 5)] == order


def test_toxicity_vectors_hold_all_terms(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"u{rng.randrange(60)}" for _ in range(12)) + (" vilest" if i % 4 == 0 else ""))
            for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.learn(table, marks, F.col("doc_id") < 60)
    counts = {i: Counter(t for w in text.split() for t in toxicity.word_terms(w)) for i, text in rows}
    examples = {t for i in range(60) for t in counts[i]}
    assert set(model.terms.tolist()) == set(map(toxicity.term_hash, examples))  # clean words too
    df = Counter(t for c in counts.values() for t in c)
    vectors = {}
    for i, c in counts.items():
        v = {t: (np.log(81 / (1 + df[t])) + 1) * (1 + np.log(n)) for t, n in c.items() if t in examples}
        norm = np.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / norm for t, x in v.items()}
    for r in toxicity.score(table, model).collect():
        mine = vectors[r["doc_id"]]
        cosine = sorted((sum(x * vectors[i].get(t, 0) for t, x in mine.items()) for i in range(60)), reverse=True)
        assert np.allclose([e["similarity"] for e in r["evidence"]], cosine[:3])


def test_decontamination(spark, docs):
    item = "A train leaves Rome at 45 miles per hour and covers 90 km while Anna walks 45 steps to Rome"
    other = "Which of these four colours is made when blue paint is mixed with yellow paint in equal parts"
    bench = [(1, item), (2, other), (3, None), (4, ""), (5, "too short item")]
    free = " ".join(f"w{i}" for i in range(30))
    rows = [
        (1, f"{free}. {item}. {free}"), (2, f"{free} {other.upper()} {free}"),
        (3, item.replace("45", "77").replace("90", "12").replace("Anna", "Bert").replace("Rome", "Oslo").replace("km", "ft")),
        (4, item.replace("45 miles", "77 miles").replace("Anna", "Bert")),  # 45 is 77 once and 45 once
        (5, free), (6, None), (7, ""), (8, " ".join(other.split()[:9])), (9, "x too short item y"), (None, item),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(3))
    marks = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for at_once in (1_000_000, 20):
        found = decontamination.contaminated(table, marks, windows_at_once=at_once).collect()
        got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in found}
        assert {k for k in got} == {(1, 1), (2, 2), (3, 1), (9, 5), (None, 1)}
        assert got[3, 1] and not got[1, 1] and not got[2, 2]
        left = decontamination.clean(table, marks, windows_at_once=at_once)
        assert left.columns == table.columns
        assert sorted(r["doc_id"] for r in left.collect()) == [4, 5, 6, 7, 8]
    assert decontamination.contaminated(table, empty(marks)).count() == 0
    assert decontamination.contaminated(empty(docs), marks).count() == 0


def test_secrets(spark, docs):
    rng = random.Random(7)

    def made(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    key = "AKIA" + made("ABCDEFGH234567", 16)
    rows, real = [], {}
    for i in range(60):
        hexes = made("0123456789abcdef", 24)
        rows.append((i, f"{words(rng, 20)} password={hexes} {words(rng, 5)}", "src"))
        real[i] = hexes
        rows.append((100 + i, f"{words(rng, 9)} number {made('0123456789', 16)} token: somethings there", "src"))
    rows += [(300, None, "a"), (301, "", None), (302, f"é {key}, then secret = 'a1b2c3d4e5f6' end", None),
             (303, f"{key}\n{key}", "x"), (303, f"{key}\n{key}", "x"), (304, "password=changeme123456", "t")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("length", F.lit(1))
    scanned = secrets.scan(table)
    found = {}
    for r in scanned.collect():
        found.setdefault(r["doc_id"], []).append(r)
    by_id = {i: t for i, t, _ in rows}
    for i, hexes in real.items():
        (r,) = found[i]
        assert by_id[i][r["start"] : r["start"] + r["n_chars"]] == hexes and r["is_secret"]
        assert r["secret_sha256"] == hashlib.sha256(hexes.encode()).hexdigest()
        assert not any(x["is_secret"] for x in found.get(100 + i, []))
    clean = secrets.redact(table, scanned)
    texts = sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr)
    assert clean.columns == table.columns and len(texts) == len(rows)
    by_id = dict(texts)
    assert by_id[302] == "é [SECRET], then secret = '[SECRET]' end" and by_id[303] == "[SECRET]\n[SECRET]"
    assert by_id[300] is None and by_id[301] == "" and "changeme" in by_id[304]
    for df in (secrets.findings(table, []), scanned, clean):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)
    assert secrets.scan(empty(table)).count() == 0
    assert secrets.scan(docs).columns == scanned.columns


def best_cost(roles):
    """Least cost by trying all moves."""
    best = {chat.START: 0.0}
    for role in roles:
        new = {}
        for state, cost in best.items():
            for a, b, c, _, _ in chat.MOVES[role]:
                if a == state:
                    new[b] = min(new.get(b, 1e18), cost + c)
        best = new
    return min(best.values())


def legal(text):
    roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
    rest = roles[1:] if roles[0] == "system" else roles
    assert rest == [("user", "assistant")[k % 2] for k in range(len(rest))]
    assert text.count("<|im_end|>\n") == len(roles) and text.endswith("<|im_end|>\n")


@pytest.mark.parametrize("block", [3, 4096])
def test_chat_repair(spark, docs, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_ROWS", block)
    rng = random.Random(3)
    rows = []
    for conv in range(25):
        for turn in range(rng.randint(1, 14)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "User ", None, "bot"]), f"t{conv}.{turn}"))
    rows += [(50, k, ("user", "assistant")[k % 2], f"m{k}") for k in range(200)]
    rows += [(51, 0, "assistant", None), (51, 0, "assistant", None), (None, 0, "user", "x"), (52, None, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit(1))
    found = {}
    for r in chat.repair(table).collect():
        found.setdefault(r["conv_id"], []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    for conv, some in found.items():
        some.sort(key=lambda r: r["position"])
        assert [r["position"] for r in some] == list(range(len(some)))
        legal("".join(r["rendered"] for r in some))
        assert sum(r["cost"] for r in some) == best_cost([chat.role_number(r["old_role"]) for r in some])
    assert {r["action"] for r in found[50]} == {"keep"}
    assert "".join(r["rendered"] for r in found[None]) == "<|im_start|>user\nx<|im_end|>\n"
    assert chat.repair(empty(table)).count() == 0


def test_min_plus_blocks_equal_one_pass():
    rng = random.Random(1)
    roles = [rng.randint(-1, 2) for _ in range(30)]
    total = chat.COSTS[roles[0]]
    for role in roles[1:]:
        total = chat.min_plus(total, chat.COSTS[role])
    assert total[chat.START].min() == best_cost(roles)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r["doc_id"], r["text"]) for r in kept.collect()}
        kept = corpus_pipeline.stored(stage(spark, kept, SF), name)
        after = {(r["doc_id"], r["text"]) for r in kept.collect()}
        assert kept.columns == names and {i for i, _ in after} <= {i for i, _ in before}
        if name == "jaccard_join":
            groups = brute_components(sorted(before), 80, 5)
            assert {i for i, _ in after} == {i for i, _, c in groups if i == c}
        if name == "language_id":
            assert len(after) >= 0.95 * len(before)
        if name == "secret_scan":
            assert {i for i, _ in after} == {i for i, _ in before}
            assert not any(re.search(r"AKIA[A-Z2-7]{16}|password=[0-9a-f]{10}", t) for _, t in after)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in kept.collect()}
    assert corpus_pipeline.ORACLE_SQL is None
