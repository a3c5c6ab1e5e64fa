"""Secret scan: patterns propose findings, a random forest takes false positives out."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier, RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.common import stored
from fleetlens.operators.ranking import top_per_group

#: Bound of the findings of each label that the model is fitted on.
SAMPLE_FINDINGS = 10_000
#: A dictionary word is in at least this share of the distinct texts, and in two of them.
LEAST_SHARE = 0.001
TREES, DEPTH, SEED = 40, 8, 7
LEAST = 0.5
REDACTED = "[SECRET]"

# Key words that name a secret, and its forms.
KEYS = (
    "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth"
)
KEYED = (
    rf"(?i:(?:{KEYS})\w{{0,20}})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?"
    r"[A-Za-z0-9+/=_.~-]{5,}[A-Za-z0-9+/=_~-]"
)
BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[\s\S]*?-----END [A-Z ]{0,40}PRIVATE KEY-----"
WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
RUN = (
    r"(?<![\p{L}\p{N}+/_-])(?=[A-Za-z+/_-]*[0-9]|[A-Z]{16})[A-Za-z0-9+/_-]{16,}+={0,2}"
    r"(?![\p{L}\p{N}])"
)
PATTERN = f"{BLOCK}|{KEYED}|{WEB_TOKEN}|{RUN}"
VALUE = rf"^(?i:(?:{KEYS})\w{{0,20}})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?"
FORM = r"^(AKIA[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$"
PLACEHOLDER = r"(?i)example|changeme|change_me|placeholder|your[_-]|dummy|xxxx|sample|<|test"

FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "transitions", "distinct_share",
    "dictionary_share", "after_key", "quoted", "known_form", "placeholder", "test_path",
    "word_before_known", "word_after_known", "line_share",
)


@dataclass
class Model:
    """A fitted forest (None where there was only one label to learn from) and the dictionary."""

    forest: RandomForestClassificationModel | None
    dictionary: list[str]


def learn_dictionary(docs: DataFrame, least_share: float = LEAST_SHARE) -> list[str]:
    """Words of three letters or more in at least ``least_share`` of all distinct texts, sorted.

    Each kept word takes its characters from so many texts that all of them together have at
    most the mean length of a text divided by ``least_share``, however large the table is.
    """
    some = docs.filter(F.col("text").isNotNull())
    # The empty word, once in each text, counts the texts. Copies of a text count once, by its hash.
    words = F.array_append(F.split(F.lower("text"), r"[^\p{L}]+"), "")
    counts = some.select(F.explode(F.array_distinct(words)).alias("word"), F.xxhash64("text").alias("_hash"))
    counts = counts.filter("length(word) >= 3 or word = ''").groupBy("word")
    counts = counts.agg(F.count_distinct("_hash").alias("count"))
    counts = stored(counts.filter("count >= 2 or word = ''"), "words")
    total = counts.filter("word = ''").first()
    if total is None:
        return []
    least = max(2, math.ceil(least_share * total["count"]))
    kept = counts.filter((F.col("count") >= least) & (F.col("word") != "")).select("word")
    return sorted(kept.toArrow().column("word").to_pylist())


def _share(value: Column, pattern: str) -> Column:
    left = F.length(F.regexp_replace(value, pattern, ""))
    return 1 - left / F.greatest(F.length(value), F.lit(1))


def _known(word: Column, dictionary: list[str]) -> Column:
    """The words go to the plan as one text, which Spark turns into one array."""
    words = F.split(F.lit("\n".join(dictionary)), "\n")
    return F.array_contains(words, F.lower(word)) & (word != "")


def findings(docs: DataFrame, dictionary: list[str], path: str = "source") -> DataFrame:
    """Every candidate in the texts with its place and features, and without its text.

    Columns: doc_id, text_hash, start (characters before it), length, secret_sha256, one column
    per feature. A candidate is what follows a key word and ``:`` or ``=``, a private key block,
    a web token, or a run of 16 or more characters with a digit or of capitals. Its features are
    length, kinds of characters and changes between kinds, share of distinct characters, share
    that dictionary words cover, key word, quotes and known forms, the document's path, the words
    before and after, and its share of its line. ``path`` may be missing or null.
    """
    has_path = path in docs.columns
    rows = docs.filter(F.col("text").isNotNull()).select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        (F.coalesce(F.col(path).cast("string"), F.lit("")) if has_path else F.lit("")).alias("_path"),
        F.col("text").alias("_text"),
    )
    rows = rows.withColumn("_found", F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0)))
    rows = rows.filter(F.size("_found") > 0)
    # Splitting by the same pattern gives what lies between, and so each candidate's place.
    rows = rows.withColumn("_between", F.split("_text", PATTERN, -1)).drop("_text")
    step = F.transform("_found", lambda m, i: F.length(F.col("_between")[i]) + F.length(m))
    rows = rows.withColumn("_steps", step)
    ends = F.aggregate(
        "_steps",
        F.array().cast("array<long>"),
        lambda done, x: F.concat(
            done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("long")) + x)
        ),
    )
    rows = rows.withColumn("_ends", ends)
    each = F.transform(
        "_found",
        lambda m, i: F.struct(
            m.alias("match"),
            F.col("_ends")[i].alias("end"),
            F.regexp_extract(F.col("_between")[i], r"([^\n]{0,200})$", 1).alias("before"),
            F.regexp_extract(F.col("_between")[i + 1], r"^([^\n]{0,200})", 1).alias("after"),
        ),
    )
    rows = rows.select("doc_id", "text_hash", "_path", F.explode(each).alias("_one"))
    rows = rows.select("doc_id", "text_hash", "_path", "_one.*")
    rows = rows.withColumn("value", F.regexp_replace("match", VALUE, ""))
    value, size = F.col("value"), F.length("value")
    kinds = F.regexp_replace(F.regexp_replace("value", "[a-z]+", "a"), "[A-Z]+", "A")
    kinds = F.regexp_replace(F.regexp_replace(kinds, "[0-9]+", "0"), "[^A-Za-z0-9]+", "-")
    runs = F.regexp_extract_all("value", F.lit("[A-Za-z]{3,}"), F.lit(0))
    covered = F.aggregate(
        F.filter(runs, lambda w: _known(w, dictionary)), F.lit(0), lambda n, w: n + F.length(w)
    )
    line = F.length("before") + F.length("match") + F.length("after")
    number = {
        "length": F.least(size, F.lit(10_000)),
        "digit_share": _share(value, "[0-9]+"),
        "upper_share": _share(value, "[A-Z]+"),
        "lower_share": _share(value, "[a-z]+"),
        "transitions": (F.length(kinds) - 1) / F.greatest(size - 1, F.lit(1)),
        "distinct_share": F.size(F.array_distinct(F.split("value", ""))) / F.greatest(size, F.lit(1)),
        "dictionary_share": covered / F.greatest(size, F.lit(1)),
        "after_key": F.length("match") > size,
        "quoted": F.col("after").rlike("^[\"']"),
        "known_form": value.rlike(FORM) | F.col("match").startswith("-----BEGIN"),
        "placeholder": value.rlike(PLACEHOLDER),
        "test_path": F.col("_path").rlike("(?i)test|example|sample|fixture|mock|doc"),
        "word_before_known": _known(F.regexp_extract("before", r"(\p{L}+)\P{L}*$", 1), dictionary),
        "word_after_known": _known(F.regexp_extract("after", r"^\P{L}*(\p{L}+)", 1), dictionary),
        "line_share": size / F.greatest(line, F.lit(1)),
    }
    return rows.select(
        "doc_id",
        "text_hash",
        (F.col("end") - size).alias("start"),
        size.cast("long").alias("n_chars"),
        F.sha2("value", 256).alias("secret_sha256"),
        *[number[name].cast("double").alias(name) for name in FEATURES],
    )


def rule_labels() -> Column:
    """Labels for findings that nobody has reviewed: 1, 0, or null where the rules cannot tell.

    Known forms, and values after a key word that mix letters and digits without placeholder or
    dictionary words, are secrets; digits alone, letters alone and placeholders are not.
    """
    mixed = (F.col("digit_share") >= 0.1) & (F.col("digit_share") <= 0.9)
    plain = (F.col("digit_share") >= 0.999) | (F.col("digit_share") == 0)
    fake = (F.col("placeholder") > 0) | (F.col("dictionary_share") >= 0.5)
    return (
        F.when((F.col("known_form") > 0) & (F.col("placeholder") == 0), 1)
        .when(fake, 0)
        .when((F.col("after_key") > 0) & mixed & (F.col("length") >= 10), 1)
        .when(plain, 0)
    )


def fit(labelled: DataFrame, dictionary: list[str], sample: int = SAMPLE_FINDINGS) -> Model:
    """Forest from findings with a column ``label`` (1 secret, 0 not, null unknown).

    A bounded sample: of each label the ``sample`` findings first by their hash. They go to the
    forest sorted and in one partition, so that the same findings always give the same trees.
    """
    rows = labelled.filter(F.col("label").isin(0, 1)).select("label", "secret_sha256", *FEATURES)
    some = top_per_group(
        rows, ["label"], [F.col(c) for c in ("secret_sha256", *FEATURES)], sample
    )
    some = stored(some.orderBy("label", "secret_sha256", *FEATURES).coalesce(1), "labelled")
    if some.select("label").distinct().count() < 2:
        return Model(None, dictionary)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED
    )
    return Model(forest.fit(assemble.transform(some).coalesce(1)), dictionary)


def classify(found: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """Adds probability and is_secret. Without a forest the rules decide; what they leave open counts."""
    if model.forest is None:
        score = F.coalesce(rule_labels(), F.lit(1)).cast("double")
        scored = found.withColumn("probability", score)
    else:
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
        forest = model.forest.copy()
        forest.setFeaturesCol("_features").setPredictionCol("").setRawPredictionCol("")
        forest.setProbabilityCol("_probability")
        scored = forest.transform(assemble.transform(found))
        scored = scored.withColumn("probability", vector_to_array("_probability")[1])
        scored = scored.drop("_features", "_probability")
    return scored.withColumn("is_secret", F.col("probability") >= least)


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """Findings of all documents with probability and is_secret.

    ``labelled``: reviewed findings (the columns of :func:`findings` and label). Without them the
    findings are labelled by :func:`rule_labels`, which leaves some open, and the forest
    generalises to those. Findings are kept as a table of numbers and hashes, without the
    secrets. Null and empty texts have no findings; repeated rows have theirs each; equal
    findings get equal answers; other columns are not read.
    """
    rows = docs.select("doc_id", "text", *([path] if path in docs.columns else []))
    dictionary = learn_dictionary(rows)
    found = stored(findings(rows, dictionary, path), "findings")
    known = found.withColumn("label", rule_labels()) if labelled is None else labelled
    return classify(found, fit(known, dictionary))


def redact(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """``docs`` with every secret of ``scanned`` replaced; all rows and columns stay.

    A document's secrets are put together per text, so rows that share an id keep their own.
    """
    hit = scanned.filter("is_secret").select(
        "doc_id", "text_hash", F.struct("start", "n_chars").alias("_span")
    )
    hit = hit.distinct().groupBy("doc_id", "text_hash")
    spans = hit.agg(F.sort_array(F.collect_list("_span")).alias("_spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_spans")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    joined = docs.join(spans, same, "left")
    empty = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate(
        "_spans",
        empty,
        lambda acc, span: F.struct(
            F.concat(
                acc["done"],
                F.substring(F.col("text"), acc["at"] + 1, span["start"] - acc["at"]),
                F.lit(REDACTED),
            ).alias("done"),
            (span["start"] + span["n_chars"]).alias("at"),
        ),
        lambda acc: F.concat(
            acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))
        ),
    )
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut)
    return joined.withColumn("text", text).drop("_id", "_hash", "_spans")
