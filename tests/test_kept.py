"""Jobs that keep files: arrays in splits, kept tables, state over batches, total orders, early ends."""

import json
import random
from pathlib import Path

import pytest
from compare import difference, oracle
from conftest import plan, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.operators import ranking, records, users
from fleetlens.plans import bindings, kept
from fleetlens.sources import json_arrays, shards
from fleetlens.sources.keyed_table import BUCKET, Conflict, KeyedTable
from fleetlens.streaming import commands as streams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(kept.JOBS))
def test_query_equals_sql(spark, name):
    assert entry.queries()[name] is kept.JOBS[name]
    found, n = difference(spark, SF, oracle(SF), kept.JOBS[name], entry.oracle_sql()[name])
    assert found is None and n > 0


@pytest.mark.parametrize("name", sorted(kept.JOBS))
def test_plans(spark, name):
    text = plan(kept.JOBS[name](spark, SF))
    for word in ("NestedLoop", "Cartesian", "Python", "Pandas"):
        assert word not in text


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def random_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choice('ab{}[]",:\\\n\t é中🙂/') for _ in range(rng.randrange(12)))
    if kind < 5:
        return rng.choice([None, True, 1, -2, 12345678901])
    if kind < 7:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {random_value(rng, 9) if rng.random() < 0.3 else f"k{i}": random_value(rng, depth + 1) for i in range(rng.randrange(4))}


def as_object(rng):
    value = {f"k{i}": random_value(rng) for i in range(rng.randrange(1, 4))}
    return json.loads(json.dumps(value))


def test_arrays_are_read_in_splits(spark, small_splits, tmp_path):
    rng = random.Random(7)
    wanted = []
    for n in range(6):
        items = [as_object(rng) for _ in range(rng.choice([0, 1, 30, 60]))]
        style = {"indent": rng.choice([None, 2]), "ensure_ascii": rng.random() < 0.5}
        (tmp_path / f"{n}.json").write_text(" " * rng.randrange(3) + json.dumps(items, **style) + "\n" * rng.randrange(3))
        wanted += items
    got = json_arrays.read_json_arrays(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 1
    assert json_arrays._pieces(spark, str(tmp_path)).select("file", "block").distinct().count() > 60
    assert sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in got.collect()) == sorted(
        json.dumps(x, sort_keys=True) for x in wanted
    )


def test_arrays_as_the_whole_file_form(spark, small_splits, tmp_path):
    """Elements of any kind, equal to what one task gets from the whole text."""
    rng = random.Random(8)
    items = [random_value(rng) if rng.random() < 0.3 else as_object(rng) for _ in range(80)]
    items = [x for x in items if x is not None]
    (tmp_path / "a.json").write_text(json.dumps(items))
    whole = spark.read.text(str(tmp_path), wholetext=True)
    whole = whole.select(F.explode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("value"))
    assert rows(json_arrays.read_json_arrays(spark, str(tmp_path))) == rows(whole)


@pytest.mark.parametrize(
    "text",
    ['[{"a": 1}', '[{"a": 1}, {"a": ', '{"a": 1}', '[{"a": 1}] x', '[{"a": 1}{"a": 2}]', " ", '[{"a": "}]', "[[]", '[{"a": 1}]]'],
)
def test_what_is_no_array_fails(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        json_arrays.read_json_arrays(spark, str(tmp_path)).collect()


def folders(path):
    return {p: sorted(f.name for f in p.iterdir()) for p in path.glob(f"version=*/{BUCKET}=*")}


def test_a_put_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = tmp_path / "t"
    start = spark.range(4000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    table = KeyedTable.create(start, str(path), "k", 8)
    with pytest.raises(Conflict):
        KeyedTable.create(start, str(path), "k", 8)
    first, before = table.manifest(), folders(path)
    assert len(first.folders) == 8
    one = start.filter(table.bucket(first, F.col("k")) == 3).limit(5).withColumn("v", F.lit("new"))
    puts = one.withColumn("seq", F.lit(1)).unionByName(one.withColumns({"seq": F.lit(0), "v": F.lit("late")}))
    second = table.put(puts, "seq", put_id=10)
    made = {p: f for p, f in folders(path).items() if p not in before}
    assert [p.name for p in made] == [f"{BUCKET}=3"]
    assert {b for b in first.folders if first.folders[b] != second.folders[b]} == {"3"}
    assert {p: f for p, f in folders(path).items() if p in before} == before
    changed = {r["k"] for r in one.collect()}
    now = {r["k"]: r["v"] for r in table.read().collect()}
    assert now == {k: "new" if k in changed else "old" for k in range(4000)}
    assert table.put(puts.withColumn("v", F.lit("again")), "seq", put_id=10) == second
    assert {r["k"]: r["v"] for r in table.read().collect()} == now
    assert {r["v"] for r in table.read(0).collect()} == {"old"}
    gone = puts.withColumn("gone", F.col("seq") == 1)
    table.put(gone, "seq", "gone", put_id=11)
    assert {r["k"] for r in table.read().collect()} == set(range(4000)) - changed
    assert table.vacuum(keep=1) == sorted({first.folders["3"], second.folders["3"]})
    assert table.read().count() == 4000 - len(changed)


def test_puts_of_nulls_new_keys_and_nothing(spark, tmp_path):
    start = spark.createDataFrame([], "k long, v string")
    table = KeyedTable.create(start, str(tmp_path / "t"), "k", 4)
    assert table.read().collect() == []
    puts = spark.createDataFrame([(None, "a", 1), (None, "b", 2), (1, None, 3), (2, "c", None)], "k long, v string, seq int")
    table.put(puts, "seq")
    assert rows(table.read()) == sorted([(None, "b"), (1, None), (2, "c")], key=repr)
    version = table.put(puts.limit(0), "seq").version
    assert version == 2 and table.read().count() == 3


def test_a_version_is_made_once(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([(1, "a")], "k long, v string"), str(tmp_path / "t"), "k", 2)
    now = table.manifest()
    table._commit(now, now.folders, None, {})
    with pytest.raises(Conflict):
        table._commit(now, now.folders, None, {})
    assert table.manifest().version == 1


def random_commands(rng, n):
    out = []
    for seq in range(n):
        op = rng.choice(["create", "create", "update", "update", "delete", "other", None])
        out.append((
            10 * seq + rng.randrange(10), rng.choice(["t"] * 9 + ["x", None]), op,
            rng.choice([None, *range(1, 25)]), rng.choice(["u", "v", None]), rng.choice([f"p{seq}", f"p{seq}", None]),
        ))
    return out


def test_users_after_every_batch(spark, tmp_path):
    rng = random.Random(5)
    log = random_commands(rng, 150)
    table = streams.create_users(spark, str(tmp_path / "users"), 4)
    for batch, (begin, end) in enumerate([(0, 40), (40, 41), (41, 41), (41, 110), (110, 150)]):
        some = spark.createDataFrame(log[begin:end], streams.COMMANDS)
        for _ in range(2):
            streams.apply_commands(table, some, "t", batch)
        whole = spark.createDataFrame(log[:end], streams.COMMANDS)
        assert rows(table.read()) == rows(users.user_state(whole, "t"))
    assert table.read().count() > 5
    with pytest.raises(ValueError, match="comes after"):
        streams.apply_commands(table, spark.createDataFrame(log[:1], streams.COMMANDS), "t", 9)


def test_users_of_a_stream_go_on(spark, tmp_path):
    log = random_commands(random.Random(6), 60)
    table = streams.create_users(spark, str(tmp_path / "users"), 4)
    for part in (log[:25], log[25:]):
        some = spark.createDataFrame(part, streams.COMMANDS)
        some.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        arriving = streams.read_command_files(spark, str(tmp_path / "in"))
        streams.keep_users(arriving, table, "t", str(tmp_path / "checkpoint")).awaitTermination()
    whole = spark.createDataFrame(log, streams.COMMANDS)
    assert rows(table.read()) == rows(users.user_state(whole, "t"))


@pytest.fixture
def many_parts(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_total_order_has_no_gaps(spark, many_parts, tmp_path):
    rng = random.Random(9)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3]), rng.randrange(50)) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, x int, y int")
    order = [F.col("x").desc_nulls_last(), F.col("y").asc()]
    numbered = ranking.total_order(df, ["g"], order, "n")
    for g in ("a", "b", None):
        mine = [(r["x"], r["y"]) for r in sorted(numbered.filter(F.col("g").eqNullSafe(F.lit(g))).collect(), key=lambda r: r["n"])]
        wanted = sorted([d[1:] for d in data if d[0] == g], key=lambda d: (-(d[0] or -1), d[1]))
        assert mine == wanted
        places = numbered.filter(F.col("g").eqNullSafe(F.lit(g))).select("n").collect()
        assert sorted(r["n"] for r in places) == list(range(1, len(wanted) + 1))
    whole = ranking.total_order(df, [], order, "n").collect()
    assert sorted(r["n"] for r in whole) == list(range(1, 3001))
    assert ranking.total_order(df.limit(0), ["g"], order, "n").collect() == []
    out = tmp_path / "out"
    ranking.write_in_order(numbered, "g", "n", str(out))
    files = sorted((out / "g=a").glob("*.parquet"))
    assert len(files) > 1
    read = [r["n"] for f in files for r in spark.read.parquet(f"file://{f}").collect()]
    assert read == list(range(1, len(read) + 1)) and len(read) > 1000


def test_a_fault_in_the_first_part_ends_the_search(spark, tmp_path):
    out = tmp_path / "items"
    items = spark.range(4000).selectExpr("cast(id as string) as id", "case when id = 0 then '' else 'n' end as name")
    items.repartitionByRange(8, F.col("id").cast("long")).write.parquet(str(out))
    files = sorted(out.glob("*.parquet"))
    good = spark.read.parquet(str(out))
    assert rows(records.lacks_value(good, ["id", "name"])) == [("id", False), ("name", True)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(f.stat().st_size for f in files)))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 20))
    try:
        sizes = {f: f.stat().st_size for f in files}
        bad = [f for f in files if spark.read.parquet(f"file://{f}").filter("name = ''").count() == 0]
        for f in bad:
            f.write_bytes(b"x" * (sizes[f] // 2))
        # The largest file, which is read first, is the only one that can be read.
        broken = spark.read.schema(good.schema).parquet(str(out))
        assert rows(records.lacks_value(broken, ["name"])) == [("name", True)]
        with pytest.raises(Exception):
            records.quality_gate(broken, ["name"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_day_folders_are_pruned(spark):
    df = kept.day_folder_shards(spark, SF)
    assert "PartitionFilters: [isnotnull(dt" in plan(df)
    wanted = rows(df)
    days = {r[-1] for r in df.select(shards.DAY).distinct().collect()}
    others = [f for f in df.inputFiles() if f.split(f"{shards.DAY}=")[1].split("/")[0] not in days]
    assert len(days) == 15 and len(others) > 5
    for f in others:
        Path(f.removeprefix("file:").replace("///", "/")).write_bytes(b"no parquet")
    assert rows(df) == wanted
