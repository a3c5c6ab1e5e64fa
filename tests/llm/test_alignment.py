"""Alignment of two tokenizers against one made from whole texts, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fleetlens.llm import alignment, queries
from fleetlens.llm.common import stored

PATHS = [queries.tokenizer_path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
SF = "/root/testdata/sf0.001"


def spans(tokens):
    out, at = [], 0
    for x in tokens:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def brute(rows):
    side_a = Tokenizer.from_file(PATHS[0])
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters, known, each, counts = alignment.byte_of_letter(), [], [], Counter()
    for i, text in rows:
        a = side_a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = side_b.encode(text) if text else []
        names = [side_b.id_to_piece(x) for x in b]
        bytes_a = [bytes(letters[c] for c in side_a.id_to_token(x)) for x in a]
        bytes_b = [
            bytes([int(n[3:-1], 16)]) if side_b.is_byte(x) else n.replace("▁", " ").encode()
            for x, n in zip(b, names)
        ]
        whole = f" {text}".encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            known.append((i, 0, 0, 0, 0, ""))
            each.append([])
            continue
        places_a, places_b = spans(bytes_a), spans(bytes_b)
        links, first = [], 0
        for x, (begin, end) in zip(a, places_a):
            while places_b[first][1] <= begin:
                first += 1
            n = first
            while n < len(b) and places_b[n][0] < end:
                links.append((x, b[n]))
                n += 1
        groups, m, n = [], 0, 0
        for end in sorted({e for _, e in places_a} & {e for _, e in places_b}):
            from_m, from_n = m, n
            while m < len(a) and places_a[m][1] <= end:
                m += 1
            while n < len(b) and places_b[n][1] <= end:
                n += 1
            groups.append(f"{','.join(map(str, a[from_m:m]))}|{','.join(map(str, b[from_n:n]))}")
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        known.append((i, len(a), len(b), len(groups), len(links), digest))
        each.append(links)
        counts.update(links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    rows = [
        (*k[:5], sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), k[5])
        for k, links in zip(known, each)
    ]
    return rows, counts


def columns(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    alphabet = " \n\t ab'1.é\xa0\x1c\x85Σś,ßtheing▁中🙂\x00"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [
        (None, None), (None, "of the"), (5, ""), (6, None), (7, " "), (7, " "), (8, "x" * 20_000),
        (9, " " * 3000 + "a"), (9, "<|endoftext|> <s> </s> <unk>"), (10, "the the " * 9000), (11, "\n"),
    ]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.selectExpr("doc_id", "text", "1 as chunk", "'x' as pair", "2 as place", "3 as count")


def test_alignment_equals_brute_force(docs):
    wanted, _ = brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])
    assert columns(alignment.alignment(docs, *PATHS)) == sorted(wanted, key=repr)
    assert alignment.alignment(docs.limit(0), *PATHS).collect() == []


def test_counts_over_many_chunks(docs, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 300)
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    wanted, counts = brute(rows)
    table = stored(alignment.align(docs, *PATHS), "chunks")
    assert table.select("chunk").distinct().count() > 5
    assert columns(alignment.scored(table)) == sorted(wanted, key=repr)
    low = (1 << alignment.ID_BITS) - 1
    found = {r["pair"]: r for r in alignment.pair_counts(table).collect()}
    assert {(p >> alignment.ID_BITS, p & low): r["n_links"] for p, r in found.items()} == counts
    listed = alignment.pair_documents(table).groupBy("a", "b").agg({"n": "sum", "*": "count"}).collect()
    for r in listed:
        pair = found[r["a"] << alignment.ID_BITS | r["b"]]
        assert (r["sum(n)"], r["count(1)"]) == (pair["n_links"], pair["n_docs"])


def test_containers_are_lists_or_bitsets():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(65536, n, replace=False)) for n in (0, 1, 4095, 4096, 65536, 0, 9)]
    ends = np.cumsum([len(x) for x in sets])
    kept = alignment.containers(np.concatenate(sets), ends)
    assert [len(x.as_py()) for x in kept] == [0, 2, 8190, 8192, 8192, 0, 18]
    for x, wanted in zip(kept, sets):
        assert alignment.opened(x.as_py()).tolist() == wanted.tolist()


def test_dense_pairs(spark):
    rows = [(i, "of the" if i % 2 else "the the the") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    wanted, _ = brute(rows[:2])
    got = alignment.alignment(docs, *PATHS).groupBy("n_links", "n_best", "groups_sha256").count().collect()
    assert sorted(r["count"] for r in got) == [6000, 6000]
    assert {r["groups_sha256"] for r in got} == {r[-1] for r in wanted}


def test_query_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    wanted, _ = brute([tuple(r) for r in docs])
    assert columns(queries.op12_tokenizer_alignment(spark, SF)) == sorted(wanted, key=repr)
