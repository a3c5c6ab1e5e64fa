from datetime import datetime

from conftest import final_plan, plan, rows
from pyspark.sql import functions as F

from fleetlens.functions import fixed
from fleetlens.operators.servers import stage_one_servers
from fleetlens.plans import bindings, health_check as hc
from fleetlens.sources import shards

AS_OF = datetime(2024, 1, 20, 12, 0)
SF = "/root/testdata/sf0.001"


def day(n, clock="10:00:00"):
    return f"2024-01-{n:02d} {clock}"


def sources(frame):
    def dated(schema, *data):
        return frame(schema, *data).withColumn("dt", shards.day_of(F.col("ts")))

    return hc.Sources(
        performance=dated(
            "ts timestamp_ntz, machine string, counter string, value double",
            (day(19), "CLOUDHOSTP1", fixed.CPU_COUNTERS["total"], 50),
            (day(19), "cloudhostp1", "Memory___Available_MBytes_mygeotab", 4096),
            (day(5), "CLOUDHOSTP1", fixed.CPU_COUNTERS["total"], 99),
            (day(19), "CLOUDHOSTP77", fixed.CPU_COUNTERS["total"], 99),
        ),
        installed_applications=dated("ts timestamp_ntz, machine string, cores string"),
        server_info=dated(
            "ts timestamp_ntz, server string, version string",
            (day(18), "my1.example.com", "v1"), (day(19), "my1.example.com", "v2"),
        ),
        performance_time=dated(
            "machine string, ts timestamp_ntz, source string, action string, cpu_seconds double, seconds double",
            ("my1_alias", day(20), "s", "x", None, 3), ("my1_alias", day(20), "t", "x", 4, 5),
            ("my1_alias", day(13), "t", "x", 7, 7), ("my1_alias", day(12), "t", "x", 9, 9),
            ("my1_alias", day(20), None, "x", 1, 1),
        ),
        api_usage=dated("machine string, ts timestamp_ntz, call string, size_kb double, seconds double"),
        query_statistics=dated(
            "machine string, ts timestamp_ntz, user_name string, query string, time_ms double, calls bigint",
            ("CLOUDHOSTP1", day(19, "01:05:00"), "gu_a", "q" * 60, 100, 2),
            ("CLOUDHOSTP1", day(19, "02:05:00"), "gu_a", "q" * 60, 50, 2),
        ),
        database_info=dated(
            "server string, name string, ts timestamp_ntz, devices bigint, bad_files bigint",
            ("my1.example.com", "Big", day(20), 9, 2), ("my1.example.com", "Small", day(20), 1, 3),
            ("my1.example.com", "Huge", day(19), 99, 1),
        ),
        performance_value=dated(
            "ts timestamp_ntz, database string, action string, average_value double",
            (day(19), "BIG", "UploaderLagTime", 1), (day(19), "big", "UploaderLagTime", 2), (day(19), "huge", "UploaderLagTime", 9),
            (day(18), "big", "UploaderFileCount", None),
        ),
    )


def check(frame, spark, listed):
    return hc.health_check_panels(sources(frame), hc.machine_list(spark, listed), AS_OF)


def expected():
    at = lambda text: datetime.fromisoformat(text)
    bucket, up = at(day(19)), at(day(19))
    q = "q" * 50
    found = {
        (1, "series", "TotalCPUMean", bucket, 25.0), (1, "series", "CheckmateCPUMean", bucket, None),
        (1, "series", "PostgresLinuxCPUMean", bucket, 0.0), (1, "series", "NodeJsCPUMean", bucket, None),
        (2, "series", "TotalMemoryMean", bucket, 0.0), (2, "series", "CheckmateMemoryMean", bucket, 0.0),
        (2, "series", "PostgresMemoryMean", bucket, 0.0), (2, "series", "AllocatedMemoryMean", bucket, 4.0),
        (3, "series", "s", at(day(20)), 0.0), (3, "series", "t", at(day(20)), 4.0), (3, "series", "t", at(day(13)), 7.0),
        (4, "series", "s", at(day(20)), 3.0), (4, "series", "t", at(day(20)), 5.0), (4, "series", "t", at(day(13)), 7.0),
        # Two top rows share a key, so each hour counts twice.
        (8, "series", q, at(day(19, "01:00:00")), 4.0), (8, "series", q, at(day(19, "02:00:00")), 4.0),
        (9, "series", q, at(day(19, "01:00:00")), 0.1), (9, "series", q, at(day(19, "02:00:00")), 0.05),
        (10, "series", q, at(day(19, "01:00:00")), 200.0), (10, "series", q, at(day(19, "02:00:00")), 100.0),
        (11, "series", "Total Bad Files", at(day(20)), 5.0), (11, "series", "Total Bad Files", at(day(19)), 1.0),
        (12, "series", "Processing Time", at(day(19)), 3.0), (12, "series", "UploaderFileCount", at(day(18)), 0.0),
    }
    ends = {1: (0, 100), 2: (0, 4), 3: (0, 7), 4: (3, 7), 8: (4, 4), 9: (0.1, 0.1), 10: (200, 200), 11: (0, 5), 12: (0, 3)}
    markers = [(p, "marker", "v2", up, float(y)) for p, pair in ends.items() for y in pair]
    return sorted([*found, *markers], key=repr)


def test_panels_by_hand(frame, spark):
    df = check(frame, spark, ["CLOUDHOSTP1", "CLOUDHOSTP5"])
    assert {r.machine for r in df.collect()} == {"CLOUDHOSTP1"}
    assert rows(df, "panel_no", "kind", "series", "x", "y") == expected()
    titles = {r.panel_no: r.panel for r in df.collect()}
    assert titles[12] == "Lag Time Plot - big" and titles[1] == "CPU Plot"


def test_panels_without_any_broadcast(frame, spark, no_broadcast):
    df = check(frame, spark, ["CLOUDHOSTP1", "CLOUDHOSTP5"])
    assert "BroadcastHashJoin" not in plan(df)
    assert rows(df, "panel_no", "kind", "series", "x", "y") == expected()


def test_machines_found_by_release_stage(frame, spark):
    metadata = "{u'releaseChannel', u'value': u'stageOne7.1'}"
    instances = frame("name string, project string, metadata string", ("my1-a", "example-fleet", metadata))
    machines = hc.with_keys(stage_one_servers(instances, "7"))
    df = hc.health_check_panels(sources(frame), machines, AS_OF)
    assert rows(df, "panel_no", "kind", "series", "x", "y") == expected()


def test_a_machine_without_version_and_lower_case_entry(frame, spark):
    df = check(frame, spark, ["cloudhostp1"]).filter("kind = 'marker' and panel_no = 1")
    assert rows(df, "machine", "series", "x", "y") == [
        ("cloudhostp1", "X.X.XXXX.XXX", None, 0.0), ("cloudhostp1", "X.X.XXXX.XXX", None, 100.0),
    ]


def test_report(frame, spark, tmp_path):
    listed = ["CLOUDHOSTP1", "CLOUDHOSTP5"]
    panels, root = check(frame, spark, listed), str(tmp_path)
    links = hc.panel_report_write(panels, hc.machine_list(spark, listed), root, AS_OF, "https://x.example/")
    report = "20240120-1200-ServerPerformance"
    assert rows(links) == [
        (m, f"{report}/machine={m}", f"https://x.example/{report}/machine={m}", n)
        for m, n in zip(listed, (panels.count(), 0))
    ]
    opened = spark.read.parquet(f"{root}/{links.filter('n_rows > 0').first().folder}")
    assert opened.count() == panels.count()


def test_the_plan_shares_its_shuffles(spark):
    text = final_plan(bindings.health_check_panels(spark, SF))
    for word in ("NestedLoop", "Cartesian", "Python", "Pandas"):
        assert word not in text
    assert text.count("FileScan") <= 16
    assert text.count("ReusedExchange") >= 15


def test_shards(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    dated = events.withColumn("dt", shards.day_of(F.col("ts")))
    path = str(tmp_path / "events")
    shards.write_shards(dated, path)
    assert len(list(tmp_path.glob("events/dt=*/*.parquet"))) == 30
    table = shards.read_shards(spark, path, dated.schema)
    assert dict(table.dtypes)["dt"] == "string"
    trailing = shards.trailing_shards(table, AS_OF)
    days = [r.dt for r in trailing.select("dt").distinct().orderBy("dt").collect()]
    assert days == [f"202401{d:02d}" for d in range(6, 21)]
    text = trailing._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in text and "20240106" in text
    by_time = shards.trailing_shards(events, AS_OF)
    assert by_time.count() == trailing.count()
    assert "GreaterThanOrEqual(ts,2024-01-06" in by_time._jdf.queryExecution().executedPlan().toString()
    assert shards.single_shard(table, AS_OF).select("dt").distinct().count() == 1
    assert shards.trailing_shards(table, AS_OF, 13, "HOUR").select("dt").distinct().count() == 2


def test_warehouse_names(frame):
    df = frame("CollectedDateTimeUTC timestamp_ntz, MachineName string, Counter string, Value double, dt string, more int")
    assert shards.warehouse_table(df, "Performance").columns == ["ts", "machine", "counter", "value", "dt"]
