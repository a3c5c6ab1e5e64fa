from fleetlens.llm import secrets


def test_dictionary_counts_all_texts(spark):
    """More texts than the 2,000 that were looked at, and more words than the 5,000 that were kept."""
    rows = [(i, f"common t{i} " + " ".join(f"{'abcdefghij'[d]}word" for d in {i % 10, i // 10 % 10})
             + (" " + " ".join(spelled(n) for n in range(i % 8 * 800, i % 8 * 800 + 800))))
            for i in range(3000)]
    rows += [(9000 + i, f"copied alone {'x' * 20}") for i in range(500)]  # one text
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("count", spark_one())
    kept = set(secrets.learn_dictionary(table))
    assert {"common"} | {spelled(n) for n in range(6400)} <= kept
    assert "copied" not in kept and "alone" not in kept
    assert secrets.learn_dictionary(table.limit(0)) == []


def spelled(n):
    return "w" + "".join("abcdefghij"[int(d)] for d in f"{n:04d}")


def spark_one():
    from pyspark.sql import functions as F

    return F.lit(1)
