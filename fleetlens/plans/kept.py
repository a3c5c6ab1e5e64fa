"""Jobs that keep their work in files, bound to the test tables, and their SQL.

Each callable writes what a user of the job would have written (exports, tables, shards, streams of
files) from the whole test table, runs the job on it, and returns what was made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.operators import probes, ranking, records
from fleetlens.plans import bindings, oracles
from fleetlens.session import shared_folder
from fleetlens.sources import hosts, keyed_table, records_io, shards
from fleetlens.streaming import commands as streams

RECORDS_PER_ARRAY = 1_000
BUCKETS = 16
BATCHES = 3


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of accounts: texts with braces, quotes, commas and line feeds, lists, and missing keys."""
    return bindings._table(spark, folder, "customer").selectExpr(
        "c_custkey as account_id",
        "case when c_custkey % 9 = 0 then null else array(c_mktsegment, 'read') end as permissions",
        "case c_custkey % 6 when 0 then concat(c_name, ',}]b') when 1 then concat('q\"{', c_name, '\\\\\\\\') "
        "when 2 then concat(' ', c_name, ' \\n z') when 3 then '' when 4 then '\"}\"' else c_name end as user_name",
    )


def array_records_to_csv(spark, folder):
    rows = _records(spark, folder)
    record = F.to_json(F.struct(*rows.columns))
    some = F.expr(f"account_id div {RECORDS_PER_ARRAY}")
    arrays = rows.groupBy(some).agg(F.collect_list(record).alias("all"))
    text = F.concat(F.lit("[\n"), F.array_join("all", ",\n "), F.lit("\n]"))
    source, target = shared_folder(spark, "records-arrays"), shared_folder(spark, "records-csv")
    arrays.select(text).write.option("maxRecordsPerFile", 1).text(source)
    return records_io.records_to_csv(spark, source, target, array_per_file=True)


def kept_table_puts(spark, folder):
    """The sheet put into a kept table in two parts, the second of them twice."""
    puts = records.load_outcomes(bindings.sheet(spark, folder)).filter("status = 'accepted'")
    half = puts.agg(F.max("seq")).head()[0] // 2
    table = keyed_table.KeyedTable.create(
        bindings.item_table(spark, folder), shared_folder(spark, "items"), "course_id", BUCKETS
    )
    table.put(puts.filter(F.col("seq") <= half), "seq", put_id=1)
    for _ in range(2):
        table.put(puts.filter(F.col("seq") > half), "seq", put_id=2)
    return table.read()


def kept_user_state(spark, folder):
    """The log of commands as files that arrive one after another, applied to a kept table of users."""
    log = bindings.commands(spark, folder)
    arrivals, state = shared_folder(spark, "arrivals"), shared_folder(spark, "users")
    checkpoint = shared_folder(spark, "users-checkpoint")
    first, last = log.agg(F.min("seq"), F.max("seq")).head()
    table = streams.create_users(spark, state, BUCKETS)
    size = (last - first) // BATCHES + 1
    for n in range(BATCHES):
        begin = first + n * size
        log.filter(F.col("seq").between(begin, begin + size - 1)).write.mode("append").json(arrivals)
        commands = streams.read_command_files(spark, arrivals)
        streams.keep_users(commands, table, bindings.TOKEN, checkpoint).awaitTermination()
    return table.read()


def ordered_samples(spark, folder):
    """All samples of a machine in the order of time, counter and value, written in that order."""
    samples = bindings.performance(spark, folder).withColumn("machine", F.upper("machine"))
    order = [F.col("ts").asc(), F.col("counter").desc(), F.col("value").asc()]
    numbered = ranking.total_order(samples, ["machine"], order, "row_no")
    path = shared_folder(spark, "ordered-samples")
    ranking.write_in_order(numbered, "machine", "row_no", path)
    written = spark.read.schema(numbered.schema).parquet(path).select(*numbered.columns)
    return written.withColumn("value", F.col("value").cast("double"))


def quality_exists(spark, folder):
    return records.lacks_value(bindings.quality_items(spark, folder), ["id", "name"])


def day_folder_shards(spark, folder):
    events = bindings._table(spark, folder, "events").select("event_id", "ts", "value")
    path = shared_folder(spark, "events-by-day")
    shards.write_shards(events.withColumn(shards.DAY, shards.day_of(F.col("ts"))), path)
    return shards.trailing_shards(shards.read_shards(spark, path, events.schema), bindings.AS_OF, 14)


def filled_schema(spark, folder):
    return records.filled_schema(bindings._table(spark, folder, "customer"))


def host_list_matrix(spark, folder):
    """The probe matrix of host lists that are read from text files."""
    lists = {}
    for name, column, side in (("supplier", "s_name", "src"), ("nation", "n_name", "dst")):
        lists[side] = shared_folder(spark, f"hosts-{side}")
        rows = bindings._table(spark, folder, name)
        rows.select(F.concat(F.lit("  "), column, F.lit("\t"))).write.text(lists[side])
    return probes.probe_matrix(*[hosts.read_hosts(spark, p, s) for s, p in lists.items()], bindings.PORTS)


JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    job.__name__: job
    for job in (
        array_records_to_csv, kept_table_puts, kept_user_state, ordered_samples, quality_exists,
        day_folder_shards, filled_schema, host_list_matrix,
    )
}

SQL: dict[str, str] = {
    "array_records_to_csv": r"""
        SELECT CAST(c_custkey AS VARCHAR) AS account_id,
          CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '["' || c_mktsegment || '","read"]' END AS permissions,
          CASE c_custkey % 6 WHEN 0 THEN c_name || ',}]b' WHEN 1 THEN 'q"{' || c_name || '\\'
            WHEN 2 THEN ' ' || c_name || ' ' || chr(10) || ' z' WHEN 3 THEN '' WHEN 4 THEN '"}"' ELSE c_name END AS user_name
        FROM customer""",
    "kept_table_puts": oracles.SQL["keyed_upsert"],
    "kept_user_state": oracles.SQL["user_state"],
    "ordered_samples": oracles._with(
        ("performance",),
        """SELECT ts, machine, counter, CAST(value AS DOUBLE) AS value,
          row_number() OVER (PARTITION BY machine ORDER BY ts, counter DESC, value) AS row_no
        FROM (SELECT ts, upper(machine) AS machine, counter, value FROM performance)""",
    ),
    "quality_exists": oracles._with(
        ("quality_items",),
        """SELECT 'id' AS "column", bool_or(id IS NULL OR id = '') AS has_issue FROM quality_items
        UNION ALL SELECT 'name', bool_or(name IS NULL OR name = '') FROM quality_items""",
    ),
    "day_folder_shards": oracles.SQL["trailing_shards"],
    "filled_schema": " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{kind}' AS type, count({name}) AS n FROM customer"
        for name, kind in (
            ("c_custkey", "N"), ("c_name", "S"), ("c_nationkey", "N"), ("c_acctbal", "N"), ("c_mktsegment", "S")
        )
    ),
    "host_list_matrix": oracles.SQL["probe_matrix"],
}
