"""The jobs bound to the test tables: one callable (spark, folder) per job.

The tables hold no operations data, so columns of the right kind are derived from them by
expression (``oracles.py`` states the same expressions for DuckDB). No row is left out. Money
and measures are cast to decimals, so that sums do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fleetlens.operators import counters, lag, probes, profiles, records, series, servers, usage, users
from fleetlens.plans import health_check as hc
from fleetlens.session import shared_folder
from fleetlens.sources import records_io, shards

AS_OF = datetime(2024, 1, 30, 18, 30)
DAYS = 29  # the whole month the derived times lie in
PORTS = " 22  80\t443 "
TOKEN = "demo-token"
BASE_URL = "https://reports.example.com/health-checks"
EXPECTED_ITEMS = (("id", "S"), ("kind", "S"), ("k", "S"), ("value", "N"), ("name", "S"), ("email", "S"))
EXPECTED_CUSTOMER = (("c_name", "S"), ("c_phone", "S"), ("c_rank", "N"), ("c_active", "BOOL"))

MACHINES = (
    "CLOUDHOSTP10", "CLOUDHOSTP11", "CLOUDHATT12", "CLOUDHMIRT13",
    "CLOUDHOSTT14", "CLOUDHOSTB15", "CLOUDHGOV16", "CLOUDHOSTP17",
)
HOSTS = (
    "my10.example.com", "my11.example.com", "afmfe2.example.net", "mirror13.example.com",
    "support14.example.com", "preview15.example.com", "gov6.example.com", "my17.example.com",
)
REPORTED = (
    "my10_alias", "my11_alias", "cloudhatt12", "CLOUDHMIRT13",
    "CLOUDHOSTT14", "CLOUDHOSTB15", "CLOUDHGOV16", "my17xalias",
)
COUNTERS = (
    "Process_CheckmateServer____Processor_Time",
    "Process__Total____Processor_Time_mygeotab",
    "Process__Total____Processor_Time_postgres_maintenance",
    "Process__node____Processor_Time",
    "Processor__Total____Processor_Time",
    "Process__Total____Processor_Time_postgres",
    "Memory___Available_MBytes",
    "Process_CheckmateServer__Working_Set",
    "Memory___Used_MBytes_mygeotab",
    "Process_CheckmateServer__Private_Bytes",
    "Memory___Available_MBytes_mygeotab",
    "Memory___Used_MBytes_postgres",
    "Some_Other_Counter",
)


def _pick(values: tuple[str, ...], index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast(1 + ({index}) % {len(values)} as int))"


# The day of the line's ship date, folded into January 2024, with an hour and a minute.
LINE_TIME = (
    "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval("
    "datediff(cast(l_shipdate as date), date'1995-01-01') % 30, cast(l_orderkey % 24 as int), l_linenumber, 0)"
)
ORDER_TIME = (
    "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval("
    "datediff(cast(o_orderdate as date), date'1995-01-01') % 30, cast(o_orderkey % 24 as int), 0, 0)"
)


_SCHEMAS: dict[str, StructType] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once per process."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def performance(spark: SparkSession, folder: str) -> DataFrame:
    machine = _pick(MACHINES, "user_id")
    return _table(spark, folder, "events").selectExpr(
        "cast(date_trunc('hour', ts) as timestamp_ntz) as ts",
        f"case when event_id % 5 = 0 then lower({machine}) else {machine} end as machine",
        f"{_pick(COUNTERS, 'event_id + user_id')} as counter",
        "cast(value as decimal(18,4)) as value",
    )


def installed_applications(spark: SparkSession, folder: str) -> DataFrame:
    # A name unknown elsewhere stands in for the first machine, which so has no cores; the
    # second machine changes its count.
    return _table(spark, folder, "events").selectExpr(
        "ts",
        f"case when user_id % 8 = 0 then 'CLOUDHOSTP98' when event_id % 3 = 0 then lower({_pick(MACHINES, 'user_id')}) "
        f"else {_pick(MACHINES, 'user_id')} end as machine",
        "cast(case when user_id % 8 = 1 then 2 * (1 + event_id % 2) else 1 + user_id % 8 end as string) as cores",
    )


def server_info(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "orders").selectExpr(
        f"{_pick(HOSTS, 'o_custkey')} as server",
        "concat(o_orderpriority, '.', o_orderstatus) as version",
        f"{ORDER_TIME} as ts",
    )


def performance_time(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "lineitem").selectExpr(
        f"case when l_orderkey % 2 = 0 then {_pick(REPORTED, 'l_suppkey')} else {_pick(MACHINES, 'l_suppkey')} end as machine",
        f"{LINE_TIME} as ts",
        "l_returnflag as source",
        "case when l_linenumber = 1 then null when l_linenumber = 2 then '' else l_linestatus end as action",
        "cast(l_extendedprice as decimal(14,2)) * (cast(l_discount as decimal(4,2)) - 0.05) as cpu_seconds",
        "cast(l_quantity as decimal(14,2)) * (cast(l_tax as decimal(4,2)) - 0.04) as seconds",
    )


def api_usage(spark: SparkSession, folder: str) -> DataFrame:
    part = _table(spark, folder, "part").select("p_partkey", "p_brand")
    lines = _table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.selectExpr(
        f"{_pick(REPORTED, 'l_suppkey')} as machine",
        f"{LINE_TIME} as ts",
        "case p_brand when 'Brand#1' then 'Authenticate' when 'Brand#2' then 'GetVersion' "
        "when 'Brand#3' then 'Get<SystemSettings>' else p_brand end as call",
        "cast(l_quantity as decimal(18,4)) as size_kb",
        "cast(l_extendedprice as decimal(18,4)) as seconds",
    )


def query_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").selectExpr(
        "ts",
        f"{_pick(MACHINES, 'user_id')} as machine",
        "case event_id % 5 when 0 then 'gu' when 1 then 'pg_user' else concat('gu_', user_id) end as user_name",
        "concat(case event_id % 13 when 0 then 'COMMIT ' when 1 then 'Vacuum ' else 'SELECT ' end, "
        "event_type, ' FROM ', props, repeat(' x', 120), event_id) as query",
        "cast(value as decimal(18,4)) as time_ms",
        "1 + event_id % 7 as calls",
    )


def database_info(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "lineitem").selectExpr(
        f"{_pick(HOSTS, 'l_suppkey')} as server",
        "concat('DB', l_partkey % 50) as name",
        f"{LINE_TIME} as ts",
        "cast(l_quantity as bigint) as devices",
        "cast(l_linenumber as bigint) as bad_files",
    )


def performance_value(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").selectExpr(
        "ts",
        "concat('dB', user_id % 50) as database",
        "case event_type when 'click' then 'UploaderLagTime' when 'view' then 'UploaderFileLengthKB' "
        "when 'purchase' then 'UploaderFileCount' when 'signup' then concat('DDIS.LagTime.DDIS.', event_id % 3) "
        "else 'Other' end as action",
        "cast(value as decimal(18,4)) as average_value",
    )


def instances(spark: SparkSession, folder: str) -> DataFrame:
    stage = "case s_suppkey % 3 when 0 then 'StageOne2104' when 1 then 'stageone2105' else 'final' end"
    return _table(spark, folder, "supplier").selectExpr(
        "concat('my', s_suppkey, '-', s_nationkey, '-z') as name",
        "concat('Example-', case s_suppkey % 4 when 0 then 'other' else 'Fleet' end, s_nationkey) as project",
        f"concat('{{u\\'key\\': u\\'ReleaseChannel\\', u\\'value\\': u\\'', {stage}, '.1\\'}}') as metadata",
        "case when s_suppkey % 5 = 4 then '20240129' else '20240130' end as dt",
    )


def sheet(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "orders").selectExpr(
        "o_orderkey as seq",
        "case when o_orderkey % 101 = 0 then null else o_custkey * 2 end as course_id",
        "o_orderpriority as Firstname",
        "case when o_orderkey % 7 = 0 then null else o_orderstatus end as Lastname",
        "case when o_orderkey % 11 = 0 then null else concat('s', o_orderkey % 3) end as Sex",
    )


def item_table(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "customer").selectExpr(
        "c_custkey as course_id", "c_name as Firstname", "c_mktsegment as Lastname", "'x' as Sex"
    )


def quality_items(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "part").selectExpr(
        "cast(p_partkey as string) as id",
        "case p_brand when 'Brand#3' then null when 'Brand#4' then '' when 'Brand#5' then ' ' else p_name end as name",
    )


def commands(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").selectExpr(
        "event_id as seq",
        f"case when event_id % 17 = 0 then 'wrong' when event_id % 19 = 0 then null else '{TOKEN}' end as token",
        "case when event_id % 997 = 0 then 'rename' else case event_type when 'signup' then 'create' "
        "when 'error' then 'delete' else 'update' end end as op",
        "case when event_type = 'signup' or event_id % 31 = 0 then null else user_id * 13 + event_id % 13 end as user_id",
        "case when event_id % 23 = 0 then null else concat('user', event_id) end as username",
        "case when event_id % 29 = 0 then null else concat('pw', event_id % 100) end as password",
    )


def probe_outputs(spark: SparkSession, folder: str) -> DataFrame:
    n, err = "(s_suppkey * 7 + n_nationkey * 3 + port_order)", "(s_suppkey + n_nationkey * 5 + port_order * 11)"
    supplier = _table(spark, folder, "supplier").selectExpr("s_name as src")
    nation = _table(spark, folder, "nation").selectExpr("n_name as dst")
    matrix = probes.probe_matrix(supplier, nation, PORTS)
    return matrix.selectExpr(
        "*",
        "cast(substr(src, 10) as bigint) as s_suppkey",
        "cast(substr(dst, 8) as bigint) as n_nationkey",
    ).selectExpr(
        "src", "dst", "port_order", "port",
        f"case {n} % 5 when 0 then 'bash: connect: Connection refused\\n1' "
        f"when 1 then 'bash: Name or service not known\\n1' when 2 then ' slow \\n 124 \\n' "
        f"when 3 then '  0 ' else 'up\\n0\\n' end as output",
        f"case {err} % 13 when 0 then 'name' when 1 then 'auth' end as error",
    )


def health_sources(spark: SparkSession, folder: str) -> hc.Sources:
    return hc.Sources(
        performance(spark, folder),
        installed_applications(spark, folder),
        server_info(spark, folder),
        performance_time(spark, folder),
        api_usage(spark, folder),
        query_statistics(spark, folder),
        database_info(spark, folder),
        performance_value(spark, folder),
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Averages and sums of ratios to nine digits, since they depend on the order of addition."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _names_today(spark: SparkSession, folder: str) -> DataFrame:
    return usage.active_name_map(shards.single_shard(performance_time(spark, folder), AS_OF))


def _today_databases(spark: SparkSession, folder: str) -> DataFrame:
    return servers.biggest_database(shards.single_shard(database_info(spark, folder), AS_OF))


def cpu_usage_buckets(spark, folder):
    job = counters.cpu_usage_buckets(performance(spark, folder), installed_applications(spark, folder))
    return _rounded(job, *counters.CPU_MEASURES)


def counter_pivot(spark, folder):
    cores = counters.latest_cores(installed_applications(spark, folder))
    return _rounded(counters.counter_pivot(performance(spark, folder), cores), *counters.CPU_MEASURES)


def latest_cores(spark, folder):
    return counters.latest_cores(installed_applications(spark, folder))


def bucket_avg(spark, folder):
    samples = _table(spark, folder, "events").selectExpr(
        f"{_pick(MACHINES, 'user_id')} as machine", "ts", "value"
    )
    return _rounded(counters.bucket_avg(samples, ["value"]), "value")


def memory_usage(spark, folder):
    return counters.memory_usage(performance(spark, folder))


def first_seen_versions(spark, folder):
    return servers.first_seen_versions(server_info(spark, folder))


def latest_version_marker(spark, folder):
    # The hosts of the machine list and one that never reports.
    listed = hc.machine_list(spark, [*MACHINES, "CLOUDHOSTP99"]).selectExpr("host as server")
    return servers.latest_version_marker(listed, servers.first_seen_versions(server_info(spark, folder)))


def active_name_map(spark, folder):
    return _names_today(spark, folder)


def performance_seconds(spark, folder):
    return usage.performance_seconds(performance_time(spark, folder), _names_today(spark, folder))


def api_usage_top_calls(spark, folder):
    return usage.api_usage_top_calls(api_usage(spark, folder), _names_today(spark, folder))


def query_profile(spark, folder):
    return profiles.query_profile(query_statistics(spark, folder))


def query_profile_dedup(spark, folder):
    return profiles.query_profile_dedup(query_statistics(spark, folder))


def bad_file_count(spark, folder):
    return servers.bad_file_count(database_info(spark, folder))


def biggest_database(spark, folder):
    return _today_databases(spark, folder)


def lag_by_action(spark, folder):
    job = lag.lag_by_action(performance_value(spark, folder))
    return job.withColumn("average_value", F.col("average_value").cast("double"))


def lag_of_biggest_database(spark, folder):
    job = lag.lag_of_biggest_database(performance_value(spark, folder), _today_databases(spark, folder))
    return job.withColumn("average_value", F.col("average_value").cast("double"))


def stage_one_servers(spark, folder):
    return servers.stage_one_servers(shards.single_shard(instances(spark, folder), AS_OF), "2104")


def series_pivot(spark, folder):
    points = _table(spark, folder, "events").selectExpr(
        "cast(date_trunc('hour', ts) as timestamp_ntz) as x",
        "case when event_id % 41 = 0 then null else event_type end as series",
        "case when event_id % 3 = 0 then null else cast(value as decimal(18,4)) end as y",
    )
    names = ["click", "error", "purchase", "signup", "view"]
    return series.series_pivot(points, "x", "series", "y", names)


def marker_bounds(spark, folder):
    points = _table(spark, folder, "events").selectExpr(
        f"{_pick(MACHINES, 'user_id')} as machine",
        "cast(1 + event_id % 12 as int) as panel_no",
        "case when event_type = 'view' then 'AllocatedMemoryMean' else event_type end as series",
        "value as y",
    )
    return series.marker_bounds(points)


def _machines(spark: SparkSession) -> DataFrame:
    listed = [m.lower() if m == "CLOUDHMIRT13" else m for m in MACHINES] + ["CLOUDHOSTP99"]
    return hc.machine_list(spark, listed)


def _panels(spark: SparkSession, folder: str) -> DataFrame:
    return hc.health_check_panels(
        health_sources(spark, folder), _machines(spark), AS_OF, days=DAYS, performance_days=DAYS
    )


def health_check_panels(spark, folder):
    # Panels 1 and 9 hold averages and sums of ratios; the others are exact.
    inexact = F.col("panel_no").isin(1, 9)
    return _panels(spark, folder).withColumn("y", F.when(inexact, F.round("y", 9)).otherwise(F.col("y")))


def panel_report_write(spark, folder):
    path = shared_folder(spark, "panel-report")
    return hc.panel_report_write(_panels(spark, folder), _machines(spark), path, AS_OF, BASE_URL)


def trailing_shards(spark, folder):
    kept = shards.trailing_shards(_table(spark, folder, "events"), AS_OF, 14)
    return kept.select("event_id", "ts", shards.day_of(F.col("ts")).alias("dt"), "value")


def records_to_csv(spark, folder):
    users_json = _table(spark, folder, "customer").selectExpr(
        "c_custkey as account_id",
        "case when c_custkey % 9 = 0 then null else array(c_mktsegment, 'read') end as permissions",
        "case c_custkey % 5 when 0 then concat(c_name, ',b') when 1 then concat('q\"', c_name) "
        "when 2 then concat(' ', c_name, ' \\n z') when 3 then '' else c_name end as user_name",
    )
    source, target = shared_folder(spark, "records-json"), shared_folder(spark, "records-csv")
    users_json.write.json(source)
    return records_io.records_to_csv(spark, source, target)


def typed_items(spark, folder):
    items = records.typed_items(sheet(spark, folder))
    return items.selectExpr(
        "item.course_id.S as course_id", "item.Firstname.S as Firstname",
        "item.Lastname.S as Lastname", "item.Sex.S as Sex",
    )


def keyed_upsert(spark, folder):
    puts = records.load_outcomes(sheet(spark, folder)).filter("status = 'accepted'")
    return records.keyed_upsert(item_table(spark, folder), puts)


def load_outcomes(spark, folder):
    return records.load_outcomes(sheet(spark, folder)).select("seq", "course_id", "status", "reason", "message")


def _json_items(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").selectExpr(
        "case event_id % 50 when 7 then '{\"id\": ' when 8 then '[1, 2]' when 9 then null when 10 then '{}' when 11 then '5' else "
        "concat('{\"id\": \"', event_id, '\", \"value\": ', user_id, '.5, \"kind\": ', "
        "case event_id % 3 when 0 then 'true' when 1 then 'null' else '[1]' end, "
        "case when event_id % 10 = 0 then concat(', \"name\": \"', event_type, '\"') else ', \"extra\": {}' end, "
        "', ', substr(props, 2)) end as item"
    )


def schema_diff(spark, folder):
    actual = records.scanned_schema(_json_items(spark, folder), "item")
    return records.schema_diff(EXPECTED_ITEMS, actual)


def scanned_schema(spark, folder):
    return records.scanned_schema(_json_items(spark, folder), "item")


def schema_evolve(spark, folder):
    return records.schema_evolve(_table(spark, folder, "customer"), EXPECTED_CUSTOMER)


def quality_gate(spark, folder):
    return records.quality_gate(quality_items(spark, folder), ["id", "name"])


def quality_quarantine(spark, folder):
    return records.quality_quarantine(quality_items(spark, folder))


def user_state(spark, folder):
    return users.user_state(commands(spark, folder), TOKEN)


def user_lookup(spark, folder):
    keys = _table(spark, folder, "customer").selectExpr("c_custkey as user_id")
    return users.user_lookup(users.user_state(commands(spark, folder), TOKEN), keys)


def command_responses(spark, folder):
    return users.command_responses(commands(spark, folder), TOKEN)


def probe_matrix(spark, folder):
    supplier = _table(spark, folder, "supplier").selectExpr("s_name as src")
    nation = _table(spark, folder, "nation").selectExpr("n_name as dst")
    return probes.probe_matrix(supplier, nation, PORTS)


def probe_status(spark, folder):
    return probes.probe_status(probe_outputs(spark, folder))


def probe_report(spark, folder):
    return probes.probe_report(probes.probe_status(probe_outputs(spark, folder)))


JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    job.__name__: job
    for job in (
        cpu_usage_buckets, counter_pivot, latest_cores, bucket_avg, first_seen_versions,
        latest_version_marker, memory_usage, active_name_map, performance_seconds,
        api_usage_top_calls, query_profile, query_profile_dedup, bad_file_count, biggest_database,
        lag_by_action, lag_of_biggest_database, stage_one_servers, series_pivot, marker_bounds,
        health_check_panels, panel_report_write, trailing_shards, records_to_csv, typed_items,
        keyed_upsert, load_outcomes, schema_diff, scanned_schema, schema_evolve, quality_gate,
        quality_quarantine, user_state, user_lookup, command_responses, probe_matrix, probe_status,
        probe_report,
    )
}
