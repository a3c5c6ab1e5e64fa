"""User commands that keep arriving.

The scripts this replaces hold their user list in the memory of one process and lose it at
every restart. Here arriving commands go into a log, and the list of users at any time is
``user_state`` of that log; or they are applied batch by batch to a kept table of users, which then
is that list without the log being read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators import users
from fleetlens.session import written
from fleetlens.sources.keyed_table import KeyedTable

USERS = "user_id bigint, username string, password string"

COMMANDS = "seq bigint, token string, op string, user_id bigint, username string, password string"


def read_command_files(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the commands in JSON-lines files that appear in a folder."""
    return spark.readStream.schema(COMMANDS).json(folder)


def log_commands(commands: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append all commands that have arrived to the log, each once, also after a failure.

    ``checkpoint`` is a folder of the shared file system; keep it with the log.
    """
    return (
        commands.writeStream.format("parquet")
        .option("path", log)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(COMMANDS).parquet(log)


def create_users(spark: SparkSession, path: str, buckets: int) -> KeyedTable:
    """An empty table of users for :func:`apply_commands`."""
    return KeyedTable.create(
        spark.createDataFrame([], USERS), path, "user_id", buckets, {"n_created": 0, "last_seq": None}
    )


def apply_commands(table: KeyedTable, commands: DataFrame, token: str, batch_id: int) -> None:
    """Applies one batch to the users, once, also if it is given again after a failure.

    Only buckets of users that the batch creates, updates or deletes are read and written. The
    number of creates and the last ``seq`` are kept in the manifest, so they change together
    with the users. A command whose ``seq`` is not after those of earlier batches is an error: the log
    would not be what ``user_state`` of all commands takes it for.
    """
    now = table.manifest()
    if now.last_put is not None and batch_id <= now.last_put:
        return
    commands = written(commands, "commands")
    first, last = commands.agg(F.min("seq"), F.max("seq")).head()
    if last is None:
        return
    if now.values["last_seq"] is not None and first <= now.values["last_seq"]:
        raise ValueError(f"command {first} comes after command {now.values['last_seq']} was applied")
    known, n_created = table.rows_of(users.named_ids(commands)), now.values["n_created"]
    changes = written(users.state_changes(commands, known, token, n_created), "changes")
    values = {"n_created": n_created + users.applied_creates(commands, token), "last_seq": last}
    table.put(changes, "user_id", "deleted", batch_id, values)


def keep_users(commands: DataFrame, table: KeyedTable, token: str, checkpoint: str) -> StreamingQuery:
    """Applies all commands that have arrived to the table of users, and ends."""
    return (
        commands.writeStream.foreachBatch(lambda batch, n: apply_commands(table, batch, token, n))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
