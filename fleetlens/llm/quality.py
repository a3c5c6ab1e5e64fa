"""Quality by weak supervision: rules vote or abstain, and a posterior replaces must-pass filters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.common import stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACE = "[\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rule:
    """Votes good or bad where one of its SQL conditions on the measures holds, else abstains."""

    name: str
    good: str
    bad: str


#: Default rules over the columns of :func:`measures`.
RULES = (
    Rule("symbols", "n_symbols <= 0.02 * n_words", "n_symbols > 0.1 * n_words"),
    Rule("symbol_words", "n_symbol_words <= 0.02 * n_words", "n_symbol_words > 0.1 * n_words"),
    Rule("lines", "n_lines >= 3 and n_dup_lines <= 0.1 * n_lines", "n_dup_lines > 0.3 * n_lines"),
    Rule("repeats", "n_repeat_words <= 0.05 * n_words", "n_repeat_words > 0.2 * n_words"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words",
         "word_chars < 2.5 * n_words or word_chars > 12 * n_words"),
    Rule("capitals", "n_capitals <= 0.1 * word_chars", "n_capitals > 0.3 * word_chars"),
    Rule("marks", "n_mark_runs <= 0.01 * n_words", "n_mark_runs > 0.1 * n_words"),
    Rule("sentences", "n_sentences >= 0.02 * n_words", "n_sentences < 0.005 * n_words"),
)
ROUNDS = 100
#: Start values. Any one flaw makes a document bad, so a rule sees only some of the bad ones.
START_PRIOR, START_GOOD, START_BAD = 0.9, 0.97, 0.4
#: Documents' worth of belief in the start values, so that a class without rows keeps its sense.
BELIEF = 10.0


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _pairs(values: Column, step: int, join) -> Column:
    """``join`` of each element and the one ``step`` later."""
    n = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + step), n), join)


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the window hashes in order.

    Windows are sorted by hash; those equal to a neighbour are repeats. Their places in order
    tell how many words they cover together.
    """

    def repeats(rows: Column) -> Column:
        same = _pairs(rows, 1, lambda a, b: a["h"] == b["h"])
        no = F.array(F.lit(False))
        return _let(
            same,
            lambda s: F.zip_with(
                rows,
                F.zip_with(F.concat(no, s), F.concat(s, no), lambda a, b: a | b),
                lambda row, twice: F.when(twice, row["i"]),
            ),
        )

    def span(places: Column) -> Column:
        gaps = _pairs(places, 1, lambda a, b: F.least(F.lit(WINDOW), b - a))
        total = F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)
        return total + F.lit(WINDOW)

    rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.sort_array(F.filter(_let(rows, repeats), lambda i: i.isNotNull()))
    return _let(places, span)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules read, of each whole text (null: no words, all 0).

    n_words, word_chars (code points in words), n_symbols (characters of ``#*$%&|<>``), n_lines
    (lines with a word), n_dup_lines (equal to an earlier one), n_repeat_words (words in 8-word
    windows found twice or more, the first included), n_capitals (upper-case letters),
    n_sentences (words that end with a point, question or exclamation mark), n_mark_runs (words that
    end with two or more such marks), n_symbol_words (words that end with one of the symbols). Everything is worked out within the row, by sorting where
    windows are compared, so nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"))
    rows = rows.withColumn(
        "_words", F.filter(F.split("_text", f"{SPACE}+"), lambda w: w != "")
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
    rows = rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", f"[{SYMBOLS}]+", "")))
        .cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "\\p{Lu}+", "")))
        .cast("long").alias("n_capitals"),
        F.size(F.filter("_words", lambda w: F.substring(w, -1, 1).isin(".", "!", "?")))
        .cast("long").alias("n_sentences"),
        F.size(F.filter("_words", lambda w: F.substring(w, -2, 2).isin("!!", "??", "!?")))
        .cast("long").alias("n_mark_runs"),
        F.size(F.filter("_words", lambda w: F.substring(w, -1, 1).isin(*SYMBOLS)))
        .cast("long").alias("n_symbol_words"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"),
    )

    def mix(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b)

    rows = rows.withColumns(
        {
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h2": _pairs(F.col("_h1"), 1, mix),
        }
    ).drop("_lines", "_h1")
    rows = rows.withColumn("_h4", _pairs(F.col("_h2"), 2, mix)).drop("_h2")
    rows = rows.withColumn("_h8", _pairs(F.col("_h4"), 4, mix)).drop("_h4")
    repeated = F.size(F.array_distinct("_h8")) < F.size("_h8")
    covered = F.when(repeated, _covered(F.col("_h8"))).otherwise(0).cast("long")
    return rows.withColumn("n_repeat_words", covered).drop("_h8")


def votes(rules: Sequence[Rule]) -> list[Column]:
    """1 good, -1 bad, 0 abstains, per rule; a null condition does not hold."""
    return [
        F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(f"vote_{r.name}")
        for r in rules
    ]


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and how often each rule's vote is right on either class."""

    prior: float
    right_good: tuple[float, ...]
    right_bad: tuple[float, ...]

    def log_odds(self, pattern: Sequence[int]) -> float:
        total = math.log(self.prior / (1 - self.prior))
        for vote, g, b in zip(pattern, self.right_good, self.right_bad, strict=True):
            if vote > 0:
                total += math.log(g / (1 - b))
            elif vote < 0:
                total += math.log((1 - g) / b)
        return total


def fit(patterns: dict[tuple[int, ...], int], n_rules: int) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    Rules are taken as independent given the class, and abstaining as telling nothing. Start
    values are the ``START_`` constants, with the weight of ``BELIEF`` documents, which also keeps
    every probability inside (0, 1).
    """
    model = LabelModel(START_PRIOR, (START_GOOD,) * n_rules, (START_BAD,) * n_rules)
    for _ in range(ROUNDS):
        good_sum = total = 0.0
        right_good, seen_good = [START_GOOD * BELIEF] * n_rules, [BELIEF] * n_rules
        right_bad, seen_bad = [START_BAD * BELIEF] * n_rules, [BELIEF] * n_rules
        for pattern, n in patterns.items():
            p = n / (1 + math.exp(-max(-500.0, min(500.0, model.log_odds(pattern)))))
            good_sum, total = good_sum + p, total + n
            for j, vote in enumerate(pattern):
                if vote:
                    seen_good[j] += p
                    seen_bad[j] += n - p
                    right_good[j] += p * (vote > 0)
                    right_bad[j] += (n - p) * (vote < 0)
        new = LabelModel(
            (good_sum + START_PRIOR * BELIEF) / (total + BELIEF),
            tuple(a / b for a, b in zip(right_good, seen_good, strict=True)),
            tuple(a / b for a, b in zip(right_bad, seen_bad, strict=True)),
        )
        if abs(new.prior - model.prior) < 1e-9:
            return new
        model = new
    return model


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, least: float = 0.5) -> DataFrame:
    """Measures, votes, posterior (probability of good), base_failed and kept of each row.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated windows. ``kept``:
    not base_failed and posterior at least ``least``. Rows are measured once and kept as a table
    of numbers; the driver gets counts of vote patterns, at most 3 ** len(rules) rows. Null and
    empty texts have no words and fail; ties in posterior are equal by construction; repeated
    rows are judged each; an empty table gives an empty result. Extra columns are not read.
    """
    names = [f"vote_{r.name}" for r in rules]
    rows = stored(measures(docs).select("*", *votes(rules)), "measures")
    counts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    model = fit({tuple(r[x] for x in names): r["n"] for r in counts}, len(rules))
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, g, b in zip(names, model.right_good, model.right_bad, strict=True):
        odds = odds + F.when(F.col(name) > 0, math.log(g / (1 - b))).when(
            F.col(name) < 0, math.log((1 - g) / b)
        ).otherwise(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumns(
        {"base_failed": failed, "posterior": 1 / (1 + F.exp(-odds))}
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
