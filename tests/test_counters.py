import random
from datetime import datetime, timedelta

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from fleetlens.functions import fixed
from fleetlens.operators import counters

PERF = "ts timestamp_ntz, machine string, counter string, value double"
APPS = "ts timestamp_ntz, machine string, cores string"
C = fixed.CPU_COUNTERS


def t(clock):
    return f"2024-01-01 {clock}"


def cpu_rows(machine="M1"):
    first = [("checkmate_windows", 40), ("checkmate_linux", 2), ("nodejs", 8), ("total", 50), ("postgres", 3)]
    return [(t("00:00:30"), machine, C[c], v) for c, v in first] + [
        (t("00:05:29"), machine, C["total"], 70),
        (t("00:05:30"), machine, C["total"], 10),
    ]


def test_cpu_buckets_by_hand(frame):
    performance = frame(PERF, *cpu_rows())
    apps = frame(APPS, (t("00:00:00"), "M1", "4"))
    got = rows(
        counters.cpu_usage_buckets(performance, apps).orderBy("bucket"),
        "machine", "bucket", "checkmate", "maintenance", "nodejs", "total", "postgres",
    )
    assert got == [
        ("m1", datetime(2024, 1, 1, 0, 0, 30), 6.0, 0.0, 1.0, 60.0, 1.5),
        ("m1", datetime(2024, 1, 1, 0, 5, 30), 0.0, 0.0, 0.0, 10.0, 0.0),
    ]


def test_without_cores_only_scaled_columns_are_null(frame):
    got = rows(counters.cpu_usage_buckets(frame(PERF, *cpu_rows()), frame(APPS)), "checkmate", "nodejs", "total", "postgres")
    assert sorted(got, key=repr) == [(None, None, 10.0, 0.0), (None, None, 60.0, 1.5)]


def test_two_core_counts_repeat_each_sample_and_spellings_share_a_grid(frame):
    performance = frame(PERF, *cpu_rows("M1"), (t("00:00:10"), "m1", C["total"], 30))
    apps = frame(APPS, (t("00:00:00"), "M1", "4"), (t("00:00:01"), "M1", "8"), (t("00:00:02"), "m1", "2"))
    pivot = counters.counter_pivot(performance, counters.latest_cores(apps))
    assert rows(pivot.filter("total = 50"), "cores", "checkmate") == [(4.0, 12.0), (8.0, 7.0)]
    # The same count in two spellings belongs to the newest one only.
    both = frame(APPS, ("2024-01-01 00:00:00", "M1", "4"), ("2024-01-02 00:00:00", "m1", "4"))
    one = t("00:00:30")
    samples = frame(PERF, (one, "M1", C["checkmate_windows"], 40), (one, "m1", C["checkmate_windows"], 80))
    assert rows(counters.cpu_usage_buckets(samples, both), "checkmate") == [(20.0,)]
    means = counters.cpu_usage_buckets(performance, apps)
    # The grid starts at 00:00:10 for both spellings: 30, 50 and 50 | 70, 70, 10 and 10.
    assert rows(means, "bucket", "total") == [
        (datetime(2024, 1, 1, 0, 0, 10), pytest.approx(130 / 3)),
        (datetime(2024, 1, 1, 0, 5, 10), 40.0),
    ]


def test_equal_core_counts_in_unlike_text_count_twice(frame):
    apps = frame(APPS, (t("00:00:00"), "M1", "4"), (t("00:00:01"), "M1", "4.0"))
    pivot = counters.counter_pivot(frame(PERF, *cpu_rows()), counters.latest_cores(apps))
    assert rows(pivot.filter("postgres > 0"), "cores", "checkmate", "postgres") == [(4.0, 24.0, 6.0)]


def test_zero_cores_give_null(frame):
    pivot = counters.counter_pivot(
        frame(PERF, *cpu_rows()), counters.latest_cores(frame(APPS, (t("00:00:00"), "M1", "0")))
    )
    assert rows(pivot, "nodejs") == [(None,)] * 3


def test_latest_cores(frame):
    day = "2024-01-0{} 00:00:00".format
    apps = frame(APPS, (day(1), "M", "4"), (day(2), "M", "4"), (day(3), "M", "8"))
    assert rows(counters.latest_cores(apps), "cores", "ts") == [
        (4.0, datetime(2024, 1, 2)), (8.0, datetime(2024, 1, 3)),
    ]


def test_memory_by_hand(frame):
    performance = frame(
        PERF,
        (t("00:00:00"), "M", "Memory___Available_MBytes", 2048),
        (t("00:00:00"), "m", "Process_CheckmateServer__Working_Set", 1073741824),
        (t("00:00:00"), "M", "Memory___Used_MBytes_mygeotab", 1024),
        (t("00:00:09"), "M", "unknown", 5),
    )
    got = rows(counters.memory_usage(performance), "machine", "available", "checkmate", "allocated", "postgres")
    assert got == [("m", 0.0, 0.0, 0.0, 0.0), ("m", 2.0, 2.0, 0.0, 0.0)]


def random_samples(frame, n, seed):
    rng = random.Random(seed)
    start = datetime(2024, 3, 9, 23, 17, 5, 123456)
    data = []
    for _ in range(n):
        machine = rng.choice("abc")
        ts = start + timedelta(microseconds=rng.randrange(10**9, 4 * 10**9))
        data.append((ts.isoformat(sep=" "), machine, rng.randrange(1000)))
    return frame("ts timestamp_ntz, machine string, value double", *data)


@pytest.mark.parametrize("minutes", [1, 5, 7])
def test_buckets_equal_the_range_join(frame, minutes):
    samples = random_samples(frame, 300, minutes)
    ours = counters.bucket_avg(samples, ["value"], minutes=minutes)
    span = samples.groupBy("machine").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    step = F.expr(f"interval {minutes} minutes")
    grid = span.select("machine", F.explode(F.sequence("lo", F.col("hi") + step, step)).alias("bucket"))
    inside = (F.col("ts") >= F.col("bucket")) & (F.col("ts") < F.col("bucket") + step)
    literal = samples.join(grid, "machine").filter(inside).groupBy("machine", "bucket").agg(F.avg("value").alias("value"))
    assert rows(ours, "machine", "bucket", "value") == rows(literal, "machine", "bucket", "value")


def test_buckets_survive_without_broadcast(frame, no_broadcast):
    hot = [(f"2024-01-01 {h:02d}:{m:02d}:00", "hot", h * m) for h in range(24) for m in range(60)]
    cold = [(f"2024-01-01 {h:02d}:30:00", f"c{h}", h) for h in range(24)]
    samples = frame("ts timestamp_ntz, machine string, value double", *hot, *cold)
    df = counters.bucket_avg(samples, ["value"])
    assert "NestedLoop" not in plan(df) and "SortMergeJoin" in plan(df)
    assert df.count() == 24 * 12 + 24
    first = df.filter("machine = 'hot'").orderBy("bucket").first()
    assert first["value"] == 0.0
    assert df.filter("machine = 'hot'").agg(F.sum(F.col("value") * 5)).first()[0] == sum(v for *_, v in hot)
