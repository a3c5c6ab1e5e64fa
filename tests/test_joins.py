import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from fleetlens.operators import joins, users


@pytest.mark.parametrize("parts", [1, 6, 40, None])
def test_all_pairs(frame, parts, monkeypatch):
    monkeypatch.setattr(joins, "COPIES_AT_ONCE", 2)
    left, right = frame("a int", *[(i % 7,) for i in range(20)]), frame("b int", *[(i,) for i in [*range(9), None]])
    expected = rows(left.crossJoin(right))
    got = joins.all_pairs(left, right, parts)
    assert rows(got, "a", "b") == expected
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert rows(joins.all_pairs(left, right.filter(F.lit(False))), "a", "b") == []


def test_repeated_hosts_spread_over_parts(spark, frame):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    left, right = frame("a string", *[("same",)] * 5000), frame("b int", *[(i,) for i in range(8)])
    pairs = joins.all_pairs(left, right, 64)
    assert pairs.count() == 40_000
    assert pairs.groupBy(F.spark_partition_id()).count().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_lookup_of_unknown_size_is_not_broadcast_unseen(spark, frame):
    keys = frame("user_id bigint", *[(i % 3,) for i in range(50)])
    state = frame("user_id bigint, username string, password string", (1, "u", "p"), (9, "v", "q"))
    assert "Broadcast" not in plan(users.user_lookup(state, keys))
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    split = rows(users.user_lookup(state, keys))
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert split == rows(users.user_lookup(state, keys)) and len(split) == 50


def test_a_million_equal_requests_are_one_row_in_the_join(spark):
    keys = spark.range(1_000_000).selectExpr("bigint(7) as user_id")
    state = spark.sql("select bigint(7) as user_id, 'u' as username, 'p' as password")
    assert users.user_lookup(state, keys).filter("username = 'u' and error is null").count() == 1_000_000
    assert joins.repeated(keys).count() == 1
