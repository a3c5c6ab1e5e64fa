"""User records kept by a log of commands (seq, token, op, user_id, username, password).

``seq`` is a distinct integer that orders the log. The n-th applied ``create`` makes user n, so
an id is created once and, once deleted, never comes back. The life of a user is therefore two
numbers, the ``seq`` of its creation and of its first deletion after that, and a command finds
the user if it lies between them. That needs aggregates and joins, not one ordered pass over
all commands of a user, and a user with very many commands is split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import fixed
from fleetlens.operators.joins import copied, repeated
from fleetlens.operators.ranking import consecutive

OPS = ("create", "update", "delete")


def digest(username: Column, password: Column) -> Column:
    return F.sha1(F.concat(username, password))


def _authorized(token: str) -> Column:
    return F.coalesce(F.col("token") == token, F.lit(False))


def _named() -> Column:
    return F.col("username").isNotNull() & F.col("password").isNotNull()


def _creates(commands: DataFrame, token: str) -> DataFrame:
    """Creates that are applied, as commands."""
    return commands.filter(_authorized(token) & (F.col("op") == "create") & _named())


def _created(commands: DataFrame, token: str) -> DataFrame:
    """Numbers of the applied creates: user_id, created (their seq). Names are joined at the end."""
    numbered = consecutive(_creates(commands, token).select("seq"), "seq", "user_id")
    return numbered.select("user_id", F.col("seq").alias("created"))


def _names(commands: DataFrame, token: str) -> DataFrame:
    """Name and digest that each applied create gives: created, username, password."""
    return _creates(commands, token).select(
        F.col("seq").alias("created"),
        "username",
        digest(F.col("username"), F.col("password")).alias("password"),
    )


def _changes(
    commands: DataFrame, created: DataFrame, token: str, updates: bool = True
) -> DataFrame:
    """First deletion and last update of the users that have any: user_id, deleted, new.

    Only commands after the creation of the user count. An update after the deletion may be
    the last one, which does not matter since a deleted user has no values.
    """
    delete, update = F.col("op") == "delete", (F.col("op") == "update") & _named()
    later = commands.filter(_authorized(token) & ((delete | update) if updates else delete))
    later = later.filter(F.col("user_id").isNotNull())
    later = later.select("seq", "op", "user_id", "username", "password")
    return (
        later.join(created, "user_id")
        .filter(F.col("seq") > F.col("created"))
        .groupBy("user_id")
        .agg(
            F.min(F.when(delete, F.col("seq"))).alias("deleted"),
            F.max_by(F.struct("username", "password"), F.when(update, F.col("seq"))).alias("new"),
        )
    )


def user_state(commands: DataFrame, token: str) -> DataFrame:
    """Users alive after the whole log: user_id, username, password (the digest).

    Commands with a wrong token, without a needed value, or for an unknown id change nothing.
    """
    created = _created(commands, token)
    new_digest = digest(F.col("new.username"), F.col("new.password"))
    return (
        created.join(_changes(commands, created, token), "user_id", "left")
        .filter(F.col("deleted").isNull())
        .join(_names(commands, token), "created")
        .select(
            "user_id",
            F.coalesce("new.username", "username").alias("username"),
            F.coalesce(new_digest, "password").alias("password"),
        )
    )


def state_changes(commands: DataFrame, users: DataFrame, token: str, n_created: int) -> DataFrame:
    """What a batch of commands changes: user_id, username, password, deleted.

    ``users`` are those alive before it (user_id, username, password), at least the ones that the
    batch names; ``n_created`` is the number of creates applied so far. All commands of the batch come
    after all of the batches before it. Users that stay as they are have no row.
    """
    number = F.col("user_id") + F.lit(n_created)
    created = _created(commands, token).withColumn("user_id", number)
    always = F.lit(-(1 << 63)).cast("long").alias("created")
    changes = _changes(commands, created.unionByName(users.select("user_id", always)), token)
    first = created.join(_names(commands, token), "created").drop("created")
    known = first.withColumn("_is_new", F.lit(True)).unionByName(
        users.select("user_id", "username", "password", F.lit(False).alias("_is_new"))
    )
    changed = F.col("_is_new") | F.col("deleted").isNotNull() | F.col("new").isNotNull()
    new_digest = digest(F.col("new.username"), F.col("new.password"))
    return known.join(changes, "user_id", "left").filter(changed).select(
        "user_id",
        F.coalesce("new.username", "username").alias("username"),
        F.coalesce(new_digest, "password").alias("password"),
        F.col("deleted").isNotNull().alias("deleted"),
    )


def named_ids(commands: DataFrame) -> DataFrame:
    """Ids that updates and deletes of a batch name."""
    return commands.filter("user_id is not null").select("user_id").distinct()


def applied_creates(commands: DataFrame, token: str) -> int:
    return _creates(commands, token).count()


def user_lookup(users: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Users asked for by ``user_id``, with an error for ids nobody has; without keys all users.

    Other columns of ``keys``, such as a request number, are passed on. Users nobody asks for
    are dropped first. Equal requests are counted, looked up once and repeated afterwards, so
    an id that very many rows ask for is a short row in the join.
    """
    if keys is None:
        return users.withColumn("error", F.lit(None).cast("string"))
    asked = repeated(keys)
    wanted = keys.select("user_id").distinct()
    found = users.join(wanted, "user_id", "left_semi").withColumn("_found", F.lit(True))
    answers = copied(asked.join(found, "user_id", "left"), "_n")
    error = F.when(F.col("_found").isNull(), F.lit(fixed.USER_NOT_FOUND))
    return answers.withColumn("error", error).drop("_found")


def as_envelope(responses: DataFrame) -> DataFrame:
    """Rows with user_id, username, password and error as ``{users: [...], errors: [...]}``."""
    user = F.struct("user_id", "username", "password")
    users = F.when(F.col("username").isNotNull(), F.array(user))
    errors = F.when(F.col("error").isNotNull(), F.array("error"))
    nothing_found = F.array().cast("array<struct<user_id:bigint,username:string,password:string>>")
    return responses.withColumn(
        "response",
        F.struct(
            F.coalesce(users, nothing_found).alias("users"),
            F.coalesce(errors, F.array().cast("array<string>")).alias("errors"),
        ),
    )


def command_responses(commands: DataFrame, token: str) -> DataFrame:
    """What each command answers: seq, op, status, user_id, username, password, error.

    401 for a wrong token; 500 for a missing value and 405 for an unknown command, neither of
    which is applied; an update of an unknown id answers with an error; a delete always works.
    """
    created = _created(commands, token)
    answers = created.join(_names(commands, token), "created").select(
        F.col("created").alias("seq"),
        F.lit("create").alias("op"),
        F.lit(200).alias("status"),
        "user_id",
        "username",
        "password",
        F.lit(None).cast("string").alias("error"),
    )
    seq, op = F.col("seq"), F.col("op")
    applied = F.coalesce(_authorized(token) & (op == "create") & _named(), F.lit(False))
    deleted = _changes(commands, created, token, updates=False)
    deleted = deleted.select("user_id", "deleted")
    lives = created.join(deleted, "user_id", "left")
    rest = commands.filter(~applied)
    rest = rest.join(lives, "user_id", "left")
    known = (seq > F.col("created")) & (F.col("deleted").isNull() | (seq < F.col("deleted")))
    known = F.coalesce(known, F.lit(False))
    missing = (op != "create") & F.col("user_id").isNull()
    status, error = F.lit(200), F.lit(None).cast("string")
    for test, code, reason in reversed(
        [
            (~_authorized(token), 401, fixed.UNAUTHORIZED),
            (~F.coalesce(op.isin(*OPS), F.lit(False)), 405, "unknown command"),
            (missing, 500, "user_id is missing"),
            ((op == "update") & ~known, 200, fixed.USER_NOT_FOUND),
            ((op != "delete") & ~_named(), 500, "username or password is missing"),
        ]
    ):
        status = F.when(test, code).otherwise(status)
        error = F.when(test, reason).otherwise(error)
    updated = F.col("error").isNull() & (op == "update")
    return answers.unionByName(
        rest.withColumns({"error": error, "status": status}).select(
            "seq",
            "op",
            "status",
            F.when(updated, F.col("user_id")).alias("user_id"),
            F.when(updated, F.col("username")).alias("username"),
            F.when(updated, digest(F.col("username"), F.col("password"))).alias("password"),
            "error",
        )
    )
