import hashlib
import random
from types import SimpleNamespace

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from fleetlens.operators import probes, records, users
from fleetlens.session import shared_folder
from fleetlens.sources import hosts, records_io
from fleetlens.streaming import commands as command_stream

ITEM = "seq bigint, course_id bigint, Firstname string, Lastname string, Sex string"


def item(seq, key, name):
    return (seq, key, name, "l", "x")


def test_upsert_keeps_last_put_and_is_repeatable(frame):
    table = frame(ITEM, item(0, 1, "A"), item(0, 2, "B")).drop("seq")
    puts = frame(ITEM, item(1, 2, "C"), item(2, 3, "D"), item(3, 2, "E"))
    once = records.keyed_upsert(table, puts)
    assert rows(once, "course_id", "Firstname") == [(1, "A"), (2, "E"), (3, "D")]
    assert rows(records.keyed_upsert(once, puts)) == rows(once)
    assert "WindowGroupLimit" in plan(once)


def test_outcomes(frame):
    sheet = frame(ITEM, (1, 7, "a", None, "x"), (2, 8, "a", "b", ""), (3, None, "a", "b", "x"))
    assert rows(records.load_outcomes(sheet), "seq", "status", "reason", "message") == [
        (1, "rejected", "Lastname is missing", "Error uploading course 7: Lastname is missing"),
        (2, "accepted", None, "Course 8 uploaded successfully"),
        (3, "rejected", "course_id is missing", "Error uploading course : course_id is missing"),
    ]
    numbers = sheet.withColumn("Sex", sheet.seq)
    assert {r.reason for r in records.load_outcomes(numbers).filter("seq = 2").collect()} == {"Sex is not text"}


def test_items(frame):
    row = records.typed_items(frame(ITEM, (1, 7, "a", "b", "x"))).first()
    assert row.item.asDict(recursive=True) == {
        "course_id": {"S": "7"}, "Firstname": {"S": "a"}, "Lastname": {"S": "b"}, "Sex": {"S": "x"},
    }


def test_schema_checks(frame, spark):
    expected = [("id", "S"), ("name", "S")]
    actual = frame("name string, type string", ("id", "S"), ("extra", "S"))
    diff = records.schema_diff(expected, actual)
    assert rows(diff, "name", "actual_type", "status") == [("name", None, "missing")]
    assert records.schema_gate(diff).first().changed is True
    numbers = frame("name string, type string", ("id", "S"), ("name", "N"), ("name", "L"))
    assert rows(records.schema_diff(expected, numbers), "name", "expected_type", "actual_type", "status") == [
        ("name", "S", "L,N", "type_mismatch")
    ]
    both = frame("name string, type string", ("id", "S"), ("name", "N"), ("name", "S"))
    assert records.schema_gate(records.schema_diff(expected, both)).first().changed is False
    declared = records.declared_schema(frame("id string, n int, b boolean", ("1", 2, True)))
    assert rows(declared, "name", "type") == [("b", "BOOL"), ("id", "S"), ("n", "N")]
    evolved = records.schema_evolve(frame("id string, n int", ("1", 2)), [("id", "N"), ("name", "S"), ("k", "N")])
    assert evolved.dtypes == [("id", "string"), ("n", "int"), ("name", "string"), ("k", "double")]
    assert rows(evolved) == [("1", 2, None, None)]


def test_scan_of_objects(spark):
    texts = [None, "", '{"a": ', "[1, 2]", "7", "null", '{"a": "x", "b": 1, "c": null}', '{"a": 1.5, "d": [1, "x"], "e": {"f": 1}}', "{}", '{"a": 2e300, "b": false}']
    items = spark.createDataFrame([(x,) for x in texts], "item string")
    assert rows(records.scanned_schema(items, "item")) == [
        ("a", "N", 2), ("a", "S", 1), ("b", "BOOL", 1), ("b", "N", 1), ("c", "NULL", 1), ("d", "L", 1), ("e", "M", 1), (None, "rejected", 6),
    ]


def test_quality(frame, spark):
    items = frame("id string, name string", ("1", "Item 1"), ("2", None), ("3", "Item 3"), ("4", " "), ("5", ""))
    assert rows(records.quality_gate(items)) == [("name", True, 2)]
    assert rows(records.quality_quarantine(items), "id", "message") == [
        ("2", 'Item with missing name: {"id":"2","name":null}'),
        ("5", 'Item with missing name: {"id":"5","name":""}'),
    ]
    assert rows(records.quality_passed(items), "id") == [("1",), ("3",), ("4",)]
    mixed = spark.createDataFrame([(0, [1], True, ""), (1, [], False, "x")], "n int, l array<int>, b boolean, s string")
    assert rows(records.quality_gate(mixed, ["n", "l", "b", "s"]), "column", "n_missing") == [
        ("b", 1), ("l", 1), ("n", 1), ("s", 1),
    ]
    empty = items.filter("id = '9'")
    assert rows(records.quality_gate(empty)) == [("name", False, 0)]


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_json_to_csv(spark, tmp_path):
    array = '[{"account_id": 1, "permissions": ["r"], "user_name": "a,b"},\n {"account_id": 2, "user_name": "q\\"z"}]'
    source = write(tmp_path, "users.json", array)
    got = records_io.records_to_csv(spark, source, str(tmp_path / "out"), array_per_file=True)
    assert rows(got) == [("1", '["r"]', "a,b"), ("2", "", 'q"z')]
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.csv")))
    assert text == 'account_id,permissions,user_name\n1,"[""r""]","a,b"\n2,,"q""z"\n'


def test_records_with_other_keys_or_no_object_are_errors(spark, tmp_path):
    for n, text in enumerate(('{"account_id": 1, "other": 2}', '{"account_id": 1', "[1]")):
        source = write(tmp_path, f"{n}.json", '{"account_id": 0}\n' + text)
        with pytest.raises(Exception, match="fields not in the list: other|not a JSON object"):
            records_io.read_records(spark, source).collect()
    with pytest.raises(Exception):
        records_io.read_records(spark, write(tmp_path, "x.json", '[{"account_id": 1'), array_per_file=True).collect()


LOG = "seq bigint, token string, op string, user_id bigint, username string, password string"


def sha(text):
    return hashlib.sha1(text.encode()).hexdigest()


HAND_LOG = [
    (1, "t", "create", None, "u", "p"), (2, "t", "create", None, "v", "q"), (3, "t", "update", 1, "u", "r"),
    (4, "t", "delete", 2, None, None), (5, "t", "update", 2, "x", "y"), (6, "t", "delete", 9, None, None),
    (7, "wrong", "create", None, "w", "w"),
]


def test_user_log_by_hand(frame):
    log = frame(LOG, *HAND_LOG)
    assert rows(users.user_state(log, "t")) == [(1, "u", sha("ur"))]
    got = rows(users.command_responses(log, "t"), "seq", "status", "user_id", "username", "password", "error")
    assert got == [
        (1, 200, 1, "u", sha("up"), None), (2, 200, 2, "v", sha("vq"), None), (3, 200, 1, "u", sha("ur"), None),
        (4, 200, None, None, None, None), (5, 200, None, None, None, "User not found"),
        (6, 200, None, None, None, None), (7, 401, None, None, None, "Unauthorized"),
    ]
    state = users.user_state(log, "t")
    assert rows(users.user_lookup(state)) == [(1, "u", sha("ur"), None)]
    asked = users.as_envelope(users.user_lookup(state, frame("user_id bigint", (1,), (2,))))
    envelopes = {r.user_id: r.response.asDict(recursive=True) for r in asked.collect()}
    assert envelopes[1] == {"users": [{"user_id": 1, "username": "u", "password": sha("ur")}], "errors": []}
    assert envelopes[2] == {"users": [], "errors": ["User not found"]}


def replay(log, token):
    """The log applied command by command."""
    alive, created, answers = {}, 0, {}
    for seq, tok, op, uid, name, word in sorted(log):
        if tok != token:
            answers[seq] = (401, "Unauthorized")
        elif op not in ("create", "update", "delete"):
            answers[seq] = (405, "unknown command")
        elif op != "create" and uid is None:
            answers[seq] = (500, "user_id is missing")
        elif op == "delete":
            alive.pop(uid, None)
            answers[seq] = (200, None)
        elif op == "update" and uid not in alive:
            answers[seq] = (200, "User not found")
        elif name is None or word is None:
            answers[seq] = (500, "username or password is missing")
        else:
            if op == "create":
                created, uid = created + 1, created + 1
            alive[uid] = (uid, name, sha(name + word))
            answers[seq] = (200, None)
    return alive, answers


@pytest.mark.parametrize("seed", range(3))
def test_user_log_equals_a_replay(frame, no_broadcast, seed):
    rng = random.Random(seed)
    log = [
        (
            seq * 1_000_003, rng.choice(["t"] * 9 + ["f", None]),
            rng.choice(["create", "update", "update", "delete", "odd"]),
            rng.choice([None, 1, 1, 1, *range(2, 12)]), rng.choice(["a", "b", "c", None]), rng.choice(["d", "e", "f", None]),
        )
        for seq in range(150)
    ]
    alive, answers = replay(log, "t")
    df = frame(LOG, *log)
    assert rows(users.user_state(df, "t")) == sorted(alive.values(), key=repr)
    got = {r.seq: (r.status, r.error) for r in users.command_responses(df, "t").collect()}
    assert got == answers


def test_commands_arrive_as_files(spark, frame, tmp_path):
    inbox, log, checkpoint = (str(tmp_path / n) for n in ("inbox", "log", "checkpoint"))
    for part in (HAND_LOG[:3], HAND_LOG[3:]):
        frame(LOG, *part).write.mode("append").json(inbox)
        stream = command_stream.read_command_files(spark, inbox)
        command_stream.log_commands(stream, log, checkpoint).awaitTermination()
    logged = command_stream.read_log(spark, log)
    assert logged.count() == len(HAND_LOG)
    assert rows(users.user_state(logged, "t")) == [(1, "u", sha("ur"))]


def test_probe_matrix(spark, frame, tmp_path, no_broadcast):
    source = hosts.read_hosts(spark, write(tmp_path, "src", "a \n\tb\n\n"), "src")
    assert rows(source) == [("",), ("a",), ("b",)]
    matrix = probes.probe_matrix(source, frame("dst string", ("x",), ("x",), ("y",)), " 22  80\t443 ")
    assert matrix.count() == 27
    assert rows(matrix.filter("src = 'a' and dst = 'y'"), "port_order", "port") == [(0, "22"), (1, "80"), (2, "443")]
    text = plan(matrix)
    assert "Cartesian" not in text and "NestedLoop" not in text


OUT = "src string, dst string, port_order int, port string, output string, error string"


def test_probe_status(frame):
    outputs = frame(
        OUT,
        ("a", "x", 0, "22", "bash: Connection refused\n1", None), ("a", "x", 1, "80", " up \r\n 0 \n", None),
        ("b", "x", 0, "22", "one line", None), ("b", "x", 1, "80", None, "auth"), ("b", "x", 2, "443", None, "name"),
        ("c", "x", 0, "22", "Name or service not known", None), ("c", "x", 1, "80", None, "name"),
        ("d", "x", 0, "22", None, None),
    )
    status = probes.probe_status(outputs)
    assert rows(status, "src", "port", "status") == sorted(
        [
            ("a", "22", "REFUSED"), ("a", "80", "0"), ("b", "22", "Unknown Status"),
            ("b", "N/A", "Authentication Error. Please check username and password"),
            ("c", "22", "Does not resolve"), ("c", "N/A", "80 is not reachable"), ("d", "22", "Unknown Status"),
        ],
        key=repr,
    )
    assert rows(probes.probe_report(status).filter("src = 'a'"), "line") == [("a#x#22#REFUSED",), ("a#x#80#0",)]
    assert rows(probes.probe_report(status).filter("src = 'c'"), "sentence") == [
        ("Source host c Dest host x Port 22 - Does not resolve",),
        ("Source host c Dest host x Port N/A - 80 is not reachable",),
    ]


def test_probes_of_many_hosts_are_many_tasks(spark, tmp_path):
    spark.range(3000).selectExpr("concat('host', id) as src").write.parquet(str(tmp_path / "src"))
    spark.range(25).selectExpr("concat('to', id) as dst").write.parquet(str(tmp_path / "dst"))
    matrix = probes.probe_matrix(*(spark.read.parquet(str(tmp_path / n)) for n in ("src", "dst")), "22 80 443")
    outputs = matrix.selectExpr("*", "'up\n0' as output", "if(port = 80 and src like '%7', 'auth', null) as error")
    status = probes.probe_status(outputs)
    sizes = [r["count"] for r in status.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 * 25 * 3 - 300 * 25 and max(sizes) < sum(sizes) / 8


class ClusterSession:
    """The part of a session that tells where the shared folder is."""

    def __init__(self, master, **conf):
        self.sparkContext = SimpleNamespace(master=master)
        self.conf = conf


def test_shared_folder_follows_the_setting():
    named = ClusterSession("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert shared_folder(named, "x").startswith("hdfs:///shared/x-")
    other = ClusterSession("yarn", **{"spark.sql.warehouse.dir": "hdfs:///house"})
    assert shared_folder(other, "x").startswith("hdfs:///house/_steps/x-")
