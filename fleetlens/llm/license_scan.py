"""License scan: notices found by their rarest words and the places these stand at."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.common import record_batch, text_slices

#: Words of a text whose letters A-Z are small: digits, small letters, all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Percent of a notice's weight that has to stand at its place.
SHARE = 75
ROWS_AT_ONCE = 512

# Phrases that name a licence by themselves.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)

# Label, words of the public notice, phrases in it that must stand.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("in compliance with the license",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("free of charge", "associated documentation files")),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", ("free software", "general public license")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License", ("affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text in order; ``bytes.lower`` changes A-Z only."""
    return WORD.findall((text or "").encode().lower())


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    #: Places of the words of key phrases.
    must: frozenset[int]


def template(label: str, text: str, phrases: Sequence[str]) -> Template:
    words, must = words_of(text), set()
    for phrase in phrases:
        wanted = words_of(phrase)
        starts = [i for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
        if not starts:
            raise ValueError(f"{phrase!r} is not in the notice {text!r}")
        must.update(range(starts[0], starts[0] + len(wanted)))
    return Template(label, tuple(words), frozenset(must))


class Index:
    """Templates with a weight per word, and the places of their rarest words.

    An alignment puts a template's first word at some place of a text. It matches if the words
    that stand at their places hold ``share`` percent of the template's weight. Of each template
    only the heaviest words are in the index, just so many that the others alone cannot reach that
    share; so every match has one of them at its place, and none is lost.
    """

    def __init__(self, templates: Sequence[Template], weights: dict[bytes, int], share: int = SHARE):
        self.templates, self.share = list(templates), share
        self.weights = [[weights[w] for w in t.words] for t in self.templates]
        self.totals = [sum(w) for w in self.weights]
        self.rest: list[int] = []
        self.postings: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        for n, (t, weight) in enumerate(zip(self.templates, self.weights, strict=True)):
            rest = self.totals[n]
            for q in sorted(range(len(weight)), key=lambda q: (-weight[q], q)):
                if 100 * rest < share * self.totals[n]:
                    break
                self.postings[t.words[q]].append((n, q, weight[q]))
                rest -= weight[q]
            self.rest.append(rest)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, place of its first word, share of its weight) of each match in a text."""
        if self.postings.keys().isdisjoint(words):
            return []
        found: dict[tuple[int, int], int] = defaultdict(int)
        for p, word in enumerate(words):
            if word in self.postings:
                for n, q, weight in self.postings[word]:
                    found[n, p - q] += weight
        out = []
        for (n, begin), got in found.items():
            if 100 * (got + self.rest[n]) < self.share * self.totals[n]:
                continue
            wanted, weight = self.templates[n].words, self.weights[n]
            stand = {
                q for q, w in enumerate(wanted) if 0 <= begin + q < len(words) and words[begin + q] == w
            }
            got = sum(weight[q] for q in stand)
            if 100 * got >= self.share * self.totals[n] and self.templates[n].must <= stand:
                out.append((n, begin, got / self.totals[n]))
        return sorted(out)


def weight_of(documents: int, with_word: int) -> int:
    """Thousandths of the inverse document frequency, as a whole number so that sums are exact."""
    return round(1000 * math.log(1 + documents / (1 + with_word)))


def word_weights(docs: DataFrame, templates: Sequence[Template]) -> dict[bytes, int]:
    """Weights of all words of the templates, from the number of texts that have them.

    Every text is read. A task sends one row per word of the templates, whatever it has read.
    """
    vocabulary = frozenset(w for t in templates for w in t.words)
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for some in text_slices(batches, 0, ROWS_AT_ONCE):
            for text in some.column(0).to_pylist():
                counts.update(vocabulary.intersection(words_of(text)))
            counts[None] += some.num_rows
        yield record_batch(schema, [list(counts), list(counts.values())])

    rows = docs.select("text").mapInArrow(counted, "word binary, n long")
    found = {r["word"] and bytes(r["word"]): r["n"] for r in rows.groupBy("word").sum("n").toDF("word", "n").collect()}
    documents = found.get(None, 0)
    return {w: weight_of(documents, found.get(w, 0)) for w in vocabulary}


def phrase_places(words: list[bytes], phrases: dict[bytes, list[tuple[tuple[bytes, ...], str]]]) -> list[tuple[int, str]]:
    """(place, label) of each phrase in a text; ``phrases`` are kept by their last word."""
    out = []
    if not phrases.keys().isdisjoint(words):
        for p, word in enumerate(words):
            for wanted, label in phrases.get(word, ()):
                begin = p + 1 - len(wanted)
                if begin >= 0 and tuple(words[begin : p + 1]) == wanted:
                    out.append((begin, label))
    return out


_SCAN = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
     ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
     ("labels", pa.string()), ("score", pa.float64()),
     ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())])))]
)
_KINDS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, "
    "matches array<struct<label: string, start: long, n_words: long, share: double>>"
)


def scan(
    docs: DataFrame,
    notices: Sequence[tuple[str, str, Sequence[str]]] = NOTICES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    share: int = SHARE,
) -> DataFrame:
    """One row per document: phrases and notices of licences in its whole text.

    ``docs`` has doc_id and text; other columns are not read. A null text is empty. Columns: doc_id,
    n_words, n_base (places where a phrase stands), first_word and last_word (least and
    greatest start of these, null if there is none), base_labels and labels (theirs; with those of
    matched notices too; distinct, sorted, comma-joined), score (1 with a phrase, else the greatest
    share of a matched notice's weight, else 0), matches (label, start, n_words, share).

    A notice matches where words that hold ``share`` percent of its weight stand at their places and all of
    its key phrases do. A word's weight is its inverse document frequency over all documents, so
    the corpus is read twice; only the counts of the notices' own words reach the driver. The index
    is as large as the notices. Each text is scanned by itself, so hot groups do not matter; repeated
    rows are scanned each, an empty table gives an empty result.
    """
    templates = [template(*n) for n in notices]
    index = Index(templates, word_weights(docs, templates), share)
    by_end: dict[bytes, list] = defaultdict(list)
    for label, phrase in phrases:
        wanted = tuple(words_of(phrase))
        by_end[wanted[-1]].append((wanted, label))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in text_slices(batches, 1, ROWS_AT_ONCE):
            out = []
            for doc_id, text in zip(*[c.to_pylist() for c in some.columns], strict=True):
                words = words_of(text)
                places, found = phrase_places(words, by_end), index.matches(words)
                base = {label for _, label in places}
                labels = base | {templates[n].label for n, _, _ in found}
                starts = [p for p, _ in places]
                score = 1.0 if places else max((s for _, _, s in found), default=0.0)
                matches = [
                    {"label": templates[n].label, "start": p, "n_words": len(templates[n].words), "share": s}
                    for n, p, s in found
                ]
                out.append(
                    (doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None),
                     ",".join(sorted(base)), ",".join(sorted(labels)), score, matches)
                )
            yield record_batch(_SCAN, list(zip(*out, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scanned, _KINDS)


def sql(
    notices: Sequence[tuple[str, str, Sequence[str]]] = NOTICES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    share: int = SHARE,
) -> str:
    """The same result (without matches) in DuckDB, by joining every word with every notice."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = ", ".join(
        f"({n}, '{t.label}', {q}, '{w.decode()}', {int(q in t.must)})"
        for n, t in enumerate(template(*x) for x in notices)
        for q, w in enumerate(t.words)
    )
    ahead = max(len(words_of(p)) for _, p in phrases)
    leads = "".join(f", lead(word, {k}) OVER o AS w{k}" for k in range(1, ahead))
    cases = " UNION ALL ".join(
        f"SELECT r, p, '{label}' AS label FROM ahead WHERE "
        + " AND ".join(f"{'word' if k == 0 else f'w{k}'} = '{w.decode()}'" for k, w in enumerate(words_of(phrase)))
        for label, phrase in phrases
    )
    return rf"""
        WITH words AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        placed AS (SELECT r, k - 1 AS p, w[k] AS word FROM words, unnest(range(1, len(w) + 1)) t(k)),
        template(t, label, q, word, must) AS (VALUES {rows}),
        vocabulary AS (SELECT DISTINCT word FROM template),
        df AS (SELECT word, count(DISTINCT r) AS n FROM placed SEMI JOIN vocabulary USING (word) GROUP BY word),
        weights AS (
          SELECT t.*, CAST(round(1000 * ln(1 + (SELECT count(*) FROM documents) / (1 + coalesce(n, 0)))) AS BIGINT) AS weight
          FROM template t LEFT JOIN df USING (word)),
        totals AS (SELECT t, label, sum(weight) AS total, sum(must) AS must FROM weights GROUP BY t, label),
        hits AS (
          SELECT r, t, p - q AS d, sum(weight) AS got, sum(must) AS must
          FROM placed JOIN weights USING (word) GROUP BY ALL),
        found AS (
          SELECT r, label, CAST(got AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM hits h JOIN totals USING (t)
          WHERE 100 * got >= {share} * total AND h.must = totals.must),
        ahead AS (SELECT r, p, word{leads} FROM placed WINDOW o AS (PARTITION BY r ORDER BY p)),
        base AS ({cases}),
        bases AS (
          SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
        labels AS (
          SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM (SELECT r, label FROM base UNION SELECT r, label FROM found) GROUP BY r),
        best AS (SELECT r, max(share) AS share FROM found GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
          coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
          CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
        FROM words LEFT JOIN bases USING (r) LEFT JOIN labels USING (r) LEFT JOIN best USING (r)"""
