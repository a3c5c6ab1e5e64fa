from fleetlens.llm import decontamination


def found(spark, item, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    (left,) = [decontamination.clean(docs, bench).count()]
    pairs = decontamination.contaminated(docs, bench).collect()
    assert len(pairs) == 1 - left
    return pairs


def test_long_items_and_changed_slots(spark):
    item = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59))
    around = " ".join(f"x{chr(97 + i)}" for i in range(20))
    part = item.split()
    (pair,) = found(spark, item, f"{around} {' '.join(part[10:42])} {around}")  # 25 of 52 windows
    assert (pair["n_windows"], pair["n_item_windows"], pair["reparameterised"]) == (25, 52, False)
    assert found(spark, item, f"{around} {' '.join(part[10:23])} {around}")
    assert not found(spark, item, f"{around} {' '.join(part[10:22])} {around}")
    # One of two equal numbers edited: the windows without it are verbatim.
    twice = " ".join([*part[:4], "45", *part[4:20], "45", *part[20:24]])
    (pair,) = found(spark, twice, twice.replace("45", "46", 1))
    assert pair["n_windows"] == 14 and pair["n_item_windows"] == 19
    two = " ".join([*part[:4], "45", *part[4:20], "46", *part[20:24]])
    assert found(spark, two, two.replace("46", "45"))
