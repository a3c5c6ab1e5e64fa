from pyspark.sql import functions as F

from fleetlens.llm import language_id


def test_sample_counts_copies_once_and_looks_all_over(spark):
    rows = [(f"same words {k}", "aa") for k in "bcdefghij" for _ in range(400)]
    rows += [(f"other text {a}{b}", "aa") for a in "abcd" for b in "efgh"]
    rows += [("heading " * 200 + "middle " * 200 + "ending " * 200, "bb")] * 3
    table = spark.createDataFrame(rows, "text string, lang string").withColumn("doc_id", F.lit(1))
    kept = language_id.learn_dictionaries(table, F.lit(True), sample_docs=25)
    texts = kept["aa"].decode()
    assert texts.count("same words") == 9 and texts.count("other text") == 16
    long = kept["bb"].decode()
    assert "heading" in long and "middle" in long and "ending" in long and len(long) < 1_100
    assert long.count("heading") < 60
