from datetime import datetime

from conftest import final_plan, plan, rows

from fleetlens.operators import lag, profiles, ranking, series, servers, usage
from fleetlens.functions.columns import host_name, none_like
from pyspark.sql import functions as F

DAY = "2024-01-0{} 00:00:00".format


def test_versions_and_marker(frame):
    info = frame(
        "server string, version string, ts timestamp_ntz",
        ("s", "v1", DAY(1)), ("s", "v2", DAY(3)), ("s", "v1", DAY(5)), ("u", "b", DAY(2)), ("u", "a", DAY(2)),
    )
    first = servers.first_seen_versions(info)
    listed = frame("server string", ("s",), ("t",), ("u",))
    assert rows(servers.latest_version_marker(listed, first), "server", "version", "last_upgrade") == [
        ("s", "v2", datetime(2024, 1, 3)), ("t", "X.X.XXXX.XXX", None), ("u", "a", datetime(2024, 1, 2)),
    ]


def test_biggest_database(frame):
    info = frame(
        "server string, name string, ts timestamp_ntz, devices bigint",
        ("s", "X", DAY(1), 99), ("s", "X", DAY(2), 5), ("s", "X", DAY(2), 7), ("s", "Y", DAY(2), 6),
        ("t", "B", DAY(1), 3), ("t", "A", DAY(1), 3), ("t", "Z", DAY(1), None),
    )
    df = servers.biggest_database(info)
    assert rows(df, "server", "database") == [("s", "x"), ("t", "a")]
    assert "WindowGroupLimit" in plan(df)


def test_bad_files(frame):
    info = frame(
        "server string, ts timestamp_ntz, bad_files bigint",
        ("s", DAY(1), 2), ("s", DAY(1), 3), ("s", DAY(2), None), ("t", DAY(1), 1),
    )
    assert rows(servers.bad_file_count(info), "server", "total_bad_files") == [("s", 5), ("s", None), ("t", 1)]


def test_host_names(frame):
    machines = frame(
        "machine string", ("CLOUDHOSTP468",), ("CLOUDHATT12",), ("CLOUDHMIRT7",), ("CLOUDHOSTT5",),
        ("CLOUDHOSTB6",), ("CLOUDHGOV33",), ("other",), ("cloudhostp1",),
    )
    assert rows(machines.select("machine", host_name(F.col("machine")).alias("h"))) == [
        ("CLOUDHATT12", "afmfe2.example.net"), ("CLOUDHGOV33", "gov3.example.com"),
        ("CLOUDHMIRT7", "mirror7.example.com"), ("CLOUDHOSTB6", "preview6.example.com"),
        ("CLOUDHOSTP468", "my468.example.com"), ("CLOUDHOSTT5", "support5.example.com"),
        ("cloudhostp1", None), ("other", None),
    ]


def test_names(frame):
    today = frame("machine string", ("my12_alias",), ("my12xalias",), ("MY12_alias",), ("my12_alias",))
    assert rows(usage.active_name_map(today)) == [
        ("MY12_alias", "MY12_alias"), ("my12_alias", "CLOUDHOSTP12"), ("my12xalias", "CLOUDHOSTP12"),
    ]


NAMES = ("machine string, entry string", ("my1_alias", "CLOUDHOSTP1"), ("CLOUDHOSTP1", "CLOUDHOSTP1"), ("q", "q"))


def test_performance_seconds(frame):
    time = frame(
        "machine string, ts timestamp_ntz, source string, action string, cpu_seconds double, seconds double",
        ("my1_alias", DAY(1), "a", "x", 1, -1), ("cloudhostp1", DAY(1), "a", "x", 1, -0.5),
        ("my1_alias", DAY(1), "a", None, 50, 50), ("my1_alias", DAY(1), "a", "", 50, 50),
        ("Q", DAY(1), "b", "x", None, 2), ("silent", DAY(1), "a", "x", 9, 9),
    )
    got = rows(usage.performance_seconds(time, frame(*NAMES)), "machine", "source", "cpu_seconds", "actual_seconds")
    assert got == [("cloudhostp1", "a", 2.0, 0.0), ("q", "b", None, 2.0)]


def test_top_calls(frame):
    calls = ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + ["Authenticate"] * 9 + [None]
    api = frame(
        "machine string, ts timestamp_ntz, call string, size_kb double, seconds double",
        *[("q", f"2024-01-01 00:0{i % 2}:3{i % 10}", c, 1, 2) for i, c in enumerate(calls)],
        *[("my1_alias", DAY(1), "z", 1, 2), ("nobody", DAY(1), "z", 1, 2)],
    )
    df = usage.api_usage_top_calls(api, frame(*NAMES), k=2)
    got = rows(df.groupBy("machine", "call").agg(F.sum("calls"), F.sum("total_size"), F.sum("total_secs")))
    assert got == [("cloudhostp1", "z", 1, 1.0, 2.0), ("q", "a", 5, 5.0, 10.0), ("q", "b", 3, 3.0, 6.0)]
    assert rows(df.filter("call = 'a'"), "minute", "calls") == [
        (datetime(2024, 1, 1, 0, 0), 3), (datetime(2024, 1, 1, 0, 1), 2),
    ]
    text = final_plan(df)
    assert "ReusedExchange" in text and "WindowGroupLimit" in text


STATS = "machine string, ts timestamp_ntz, user_name string, query string, time_ms double, calls bigint"


def test_profile_repeats_rows_and_dedup_does_not(frame):
    stats = frame(
        STATS,
        ("M", "2024-01-01 01:10:00", "gu_x", "A", 60, 1), ("m", "2024-01-01 01:20:00", "gu_x", "a", 40, 1),
        ("M", "2024-01-01 02:00:00", "gu_y", "a", 90, 2), ("M", "2024-01-01 01:00:00", "gu_x", "b", 5, 1),
        ("M", "2024-01-01 01:00:00", "gu", "a", 1000, 9), ("M", "2024-01-01 01:00:00", "gu_x", "x COMMIT", 9, 9),
        ("M", "2024-01-01 01:00:00", "gu_x", None, 9, 9), (None, "2024-01-01 01:00:00", "gu_x", "a", 9, 9),
    )
    one, two = datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2)
    expected = [(one, "a", 100.0, 2, 0.05), (two, "a", 90.0, 2, 0.045)]
    columns = ("hour", "short_query", "total_time_ms", "total_calls", "sec_per_call")
    df = profiles.query_profile(stats)
    assert rows(df, *columns) == sorted(expected * 2, key=repr)
    assert "ReusedExchange" in final_plan(df)
    assert rows(profiles.query_profile_dedup(stats), *columns) == expected
    assert rows(profiles.query_profile(stats, k=1), *columns) == expected


def test_long_queries_meet_in_key_and_label(frame):
    same, other = "s" * 200, "s" * 60 + "t" * 140
    stats = frame(
        STATS,
        ("M", DAY(1), "gu_x", same + "1", 10, 1), ("M", DAY(1), "gu_x", same + "2", 20, 1),
        ("M", DAY(1), "gu_x", other, 5, 2),
    )
    got = rows(profiles.query_profile(stats), "short_query", "total_time_ms", "total_calls")
    assert got == [("s" * 50, 30.0, 2), ("s" * 50, 5.0, 2)]


VALUES = "ts timestamp_ntz, database string, action string, average_value double"


def test_lag(frame):
    names = ["UploaderLagTime", "DDIS.LagTime.A", "UploaderFileCount", "Other", "DDIS.LagTimeDDIS.B", None]
    values = frame(VALUES, *[(DAY(1), "Db1", a, 1) for a in names], (DAY(2), "db2", "UploaderLagTime", 4))
    assert rows(lag.lag_by_action(values), "database", "action") == [
        ("Db1", "LagTime.A"), ("Db1", "LagTimeB"), ("Db1", "Processing Time"), ("Db1", "UploaderFileCount"),
        ("db2", "Processing Time"),
    ]
    biggest = frame("server string, database string", ("s", "db2"), ("t", "db2"), ("u", "none"))
    got = lag.lag_of_biggest_database(values, biggest)
    assert rows(got, "server", "action", "average_value") == [
        ("s", "Processing Time", 4.0), ("t", "Processing Time", 4.0),
    ]
    own = lag.lag_by_action(values, ["Other"], "none", {"Other": "Shown"})
    assert rows(own, "action") == [("Shown",)]


def test_stage_one(frame):
    hit = "{u'ReleaseChannel', u'Value': u'StageOne2104.3'}"
    instances = frame(
        "name string, project string, metadata string",
        ("my12-a-b", "Example-Fleet1", hit), ("my13-a", "other", hit), ("my14-a", "example-fleet", "u'stageone2104"),
        ("my15-a", "example-fleet", hit.replace("2104", "2105")),
    )
    assert rows(servers.stage_one_servers(instances, "2104")) == [("CLOUDHOSTP12",)]


def test_pivot(frame):
    points = frame(
        "x string, series string, y double", ("a", "s", 1), ("a", None, 2), ("b", "s", None), (None, "s", 3), ("a", "t", 4),
        ("a", "t", 5),
    )
    assert rows(series.series_pivot(points, "x", "series", "y", ["s", "t"])) == [("a", 1.0, 9.0), ("b", 0.0, None)]
    assert series.series_pivot(points, "x", "series", "y").columns == ["x", "s", "t"]


def test_marker_bounds(frame):
    schema = "machine string, panel_no int, series string, y double"
    data = [("m", p, s, y) for p in (1, 2, 3, 11) for s, y in (("a", 3), ("a", 1), ("b", 8), ("AllocatedMemoryMean", 5))]
    assert rows(series.marker_bounds(frame(schema, *data))) == [
        ("m", 1, 0.0, 100.0), ("m", 11, 0.0, 8.0), ("m", 2, 0.0, 5.0), ("m", 3, 3.0, 8.0),
    ]


def test_consecutive_numbers(spark):
    big = 1 << ranking.BLOCK_BITS
    values = [5, 6, big - 1, big, big + 3, 3 * big * big + 7, -4, big * big, -big * big * 2]
    df = spark.createDataFrame([(v,) for v in values], "seq bigint")
    got = rows(ranking.consecutive(df, "seq", "n"), "n", "seq")
    assert [v for _, v in sorted(got)] == sorted(values)
    assert sorted(n for n, _ in got) == list(range(1, len(values) + 1))


def test_excluded_patterns_follow_like(frame):
    patterns = ["%ab_d%", "x%", "%.z", "q"]
    texts = ["1abcd", "ab\nd2", "abd", "x", "ax", "a.z", "az", "a.zz", "q", "qq", "", None]
    df = frame("t string", *[(t,) for t in texts])
    likes = F.lit(True)
    for pattern in patterns:
        likes = likes & ~F.col("t").like(pattern)
    for chosen, expected in ((patterns, likes), (patterns[:1], ~F.col("t").like(patterns[0]))):
        assert df.filter(~none_like(F.col("t"), chosen).eqNullSafe(expected)).count() == 0
