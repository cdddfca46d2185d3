"""Tables, readers, services and the rest of the engine that the registered queries don't reach, on small made-up data."""

import asyncio
import json
import os
import threading
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnlake import cli, services, sources
from tarnlake import functions as f
from tarnlake.errors import CatalogError, CommitConflict, MaintenanceError, SchemaError, TableNotFound, Unsupported, ValidationError
from tarnlake.functions import col
from tarnlake.operators import store
from tarnlake.operators.quality import Validator, describe, profile
from tarnlake.operators.store import OPEN_FILES, may_match
from tarnlake.session import AsyncLake, Federation, Lake, MergeOnRead
from tarnlake.streaming import StreamingWriter, append_stream, file_stream

ROWS = [(1, "a", 10), (2, "a", 20), (3, "b", 30), (4, "b", 40)]


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


@pytest.fixture
def four(lake, spark):
    lake.create_table("t", {"id": "long", "g": "string", "v": "long"})
    lake.append("t", spark.createDataFrame(ROWS, "id long, g string, v long").coalesce(1))
    return lake


def ids(df):
    return sorted(r[0] for r in df.collect())


# ---------------------------------------------------------------- names, schema


def test_names(lake):
    lake.create_namespace("ns", {"owner": "me"})
    assert lake.list_namespaces() == [("ns",)] and lake.namespace_properties("ns") == {"owner": "me"}
    assert lake.update_namespace_properties("ns", {"a": "1"}, ["owner"]) == {"a": "1"}
    lake.create_table("ns.t", "a int")
    assert lake.list_tables("ns") == ["ns.t"] and lake.table_exists("ns.t") and not lake.table_exists("ns.u")
    with pytest.raises(CatalogError):
        lake.create_table("ns.t", "a int")
    with pytest.raises(CatalogError):
        lake.drop_namespace("ns")
    with pytest.raises(TableNotFound):
        lake.open("ns.u")
    lake.drop_table("ns.t")
    lake.drop_namespace("ns")
    assert lake.list_tables("ns") == []
    with pytest.raises(CatalogError):
        lake.drop_namespace("ns")
    with pytest.raises(ValueError):
        lake.open("ns.")


def test_schemas(lake, spark):
    class Inner:
        x: int

    class Model:
        id: int
        name: str
        email: str | None
        tags: list[str]
        inner: Inner

    made = lake.create_table("m", Model).schema
    assert [(x.name, x.dataType.simpleString(), x.nullable) for x in made] == [("id", "bigint", False), ("name", "string", False), ("email", "string", True), ("tags", "array<string>", False), ("inner", "struct<x:bigint>", False)]
    made = lake.create_table("d", {"a": "int32", "b": "decimal(10,2)", "c": "binary", "e": {"type": "long", "required": True}}).schema
    assert made["a"].dataType.simpleString() == "int" and made["b"].dataType.simpleString() == "decimal(10,2)" and not made["e"].nullable
    assert lake.create_table("p", pd.DataFrame({"x": [1.5]})).schema["x"].dataType.simpleString() == "double"
    assert lake.create_table("q", pa.schema([("x", pa.int32())])).schema["x"].dataType.simpleString() == "int"
    with pytest.raises(SchemaError):
        lake.create_table("z", "a int", partition_spec=["nope"])
    with pytest.raises(SchemaError):
        lake.create_table("z", "a int", sort_order=["nope"])
    with pytest.raises(ValueError):
        lake.create_table("z", "a int", partition_spec=[("a", "sideways")])
    lake.append("d", [{"a": 1, "b": Decimal("1.25"), "e": 5}])
    assert lake.table("d").first()["b"] == Decimal("1.25")
    with pytest.raises(Exception, match="null in required"):
        lake.append("d", [{"a": 1, "e": None}])
    with pytest.raises(SchemaError):
        lake.append("d", [{"nope": 1}])


def test_schema_changes(four, spark):
    t = four.open("t")
    t.add_column("w", "int", "a width")
    t.update_column_type("w", "long")
    t.rename_column("g", "group")
    assert t.schema["w"].dataType.simpleString() == "bigint" and t.schema["w"].metadata == {"comment": "a width"}
    with pytest.raises(SchemaError):
        t.update_column_type("w", "string")
    with pytest.raises(SchemaError):
        t.add_column("w", "int")
    done = t.sync_schema(spark.createDataFrame([], "id long, v long, extra string, w int").schema, allow_drops=True)
    assert done == {"added": ["extra"], "dropped": ["group"], "widened": [], "skipped": ["w"]}
    assert sorted(four.table("t").columns) == ["extra", "id", "v", "w"] and four.table("t").where("v = 20").count() == 1
    t.add_partition("v", "bucket", 4)
    t.add_partition("v", "truncate", 10)
    with pytest.raises(ValueError):
        t.add_partition("v", "bucket")
    four.append("t", [{"id": 9, "v": 25}])
    assert ids(four.table("t").where("v > 20")) == [3, 4, 9]
    t.reload().remove_partition("v_bucket")
    with pytest.raises(ValueError):
        t.remove_partition("v_bucket")
    with pytest.raises(SchemaError):
        t.drop_column("v")


@pytest.mark.parametrize("kind", ["year", "month", "day", "hour", "identity", "void"])
def test_time_partitions(lake, spark, kind):
    rows = [(i, datetime(2020, 1, 1) + timedelta(hours=493 * i)) for i in range(30)] + [(999, None)]
    df = spark.createDataFrame(rows, "id int, at timestamp_ntz")
    lake.create_table("t", df, partition_spec=[("at", kind)]).append(df)
    late = col("at") >= datetime(2021, 1, 1)
    want = sorted(i for i, t in rows if t and t >= datetime(2021, 1, 1))
    assert ids(lake.query("t").filter(late).select("id").execute()) == want and lake.table("t").count() == 31
    t = lake.open("t")
    kept = t.matching(t.snapshot().files, late.bounds)
    assert all(len({x["part"]}) == 1 for x in t.snapshot().files)
    assert len(kept) < len(t.snapshot().files) or kind == "void"
    assert lake.delete("t", late) == len(want) and lake.table("t").count() == 31 - len(want)


# ---------------------------------------------------------------- file skipping


def test_statistics():
    day = 86_400_000_000
    stats = {"n": ["number", 10, 40], "d": ["time", 0, 10 * day], "s": ["text", "b", "d"], "z": ["instant", 0, day]}
    cases = [("n", ">", 40, False), ("n", ">=", 40.0, True), ("n", "<", 10, False), ("n", "=", 9.5, False), ("n", "=", Decimal("12.5"), True), ("d", ">", date(1970, 1, 11), False), ("d", "=", date(1970, 1, 5), True), ("d", "<", datetime(1969, 12, 31), False), ("s", "=", "a", False), ("s", "=", 5, True), ("z", ">", datetime(1970, 1, 3), True), ("z", ">", datetime(1970, 1, 3, tzinfo=timezone.utc), False), ("missing", "=", 1, True), ("n", "=", None, True), ("n", "=", float("nan"), True)]
    for name, op, value, want in cases:
        assert may_match(stats, ((name, op, value),)) == want, (name, op, value)
    skipper = services.DataSkipper()
    assert skipper.can_skip(stats, col("n") > 40) and not skipper.can_skip(stats, col("n") > 39)
    assert skipper.stats() == {"skipped": 1, "scanned": 1, "skip_rate": 0.5}


def test_skipping_loses_nothing(lake, spark):
    lake.create_table("t", "id int, x double, d decimal(12,3), day date, s string")
    for k in range(4):
        lake.append("t", spark.createDataFrame([(i, i / 7, Decimal(i) / 8, date(2020, 1, 1) + timedelta(days=i), f"{i:03d}") for i in range(10 * k, 10 * k + 10)], "id int, x double, d decimal(12,3), day date, s string").coalesce(1))
    lake.append("t", spark.createDataFrame([(100, float("nan"), None, None, None)], "id int, x double, d decimal(12,3), day date, s string"))
    t = lake.open("t")
    for condition, sql, most in ((col("id") < 10, "id < 10", 1), (col("x") > 5, "x > 5", 2), (col("d") >= Decimal("4.5"), "d >= 4.5", 1), (col("d") >= 2, "d >= 2", 3), (col("day") == date(2020, 1, 15), "day = DATE '2020-01-15'", 1), (col("s") < "005", "s < '005'", 1), (col("id").is_in([3, 5]), "id in (3, 5)", 1), ((col("id") > 12) & (col("x") < 3), "id > 12 and x < 3", 2)):
        assert len([x for x in t.matching(t.snapshot().files, condition.bounds) if x["rows"] > 1]) <= most, sql
        assert ids(lake.query("t").filter(condition).select("id").execute()) == ids(lake.table("t").where(sql).select("id"))
    assert lake.update("t", col("id").is_in([3, 5]), {"s": "hit"}) == 2 and ids(lake.table("t").where("s = 'hit'").select("id")) == [3, 5]


# ---------------------------------------------------------------- history


def test_time_travel_is_of_a_branch(four, spark):
    first = four.open("t").snapshot()
    four.create_branch("t", "audit")
    four.append("t", [{"id": 9, "g": "x", "v": 1}], branch="audit")
    assert ids(four.read_table("t", as_of_timestamp=2**53)) == [1, 2, 3, 4]
    assert ids(four.read_table("t", branch="audit")) == [1, 2, 3, 4, 9] and ids(four.read_table("t", branch="audit", as_of_timestamp=2**53)) == [1, 2, 3, 4, 9]
    with pytest.raises(ValidationError):
        four.read_table("t", as_of_timestamp=first.ts - 1)
    with pytest.raises(ValidationError):
        four.read_table("t", snapshot_id=first.id, as_of_timestamp=1)
    with four.transaction("t") as step:
        step.append(spark.createDataFrame([(7, "c", 7)], "id long, g string, v long"))
        assert ids(four.read_table("t", as_of_timestamp=2**53)) == [1, 2, 3, 4]
    assert ids(four.table("t")) == [1, 2, 3, 4, 7] and ids(four.read_incremental("t", first.id)) == [7]
    four.open("t").rollback(as_of=first.ts)
    assert ids(four.table("t")) == [1, 2, 3, 4]


def test_transactions_that_fail(four, spark):
    n = len(four.open("t").snapshots())
    with pytest.raises(RuntimeError), four.transaction("t") as step:
        step.delete(col("id") > 0)
        raise RuntimeError
    assert ids(four.table("t")) == [1, 2, 3, 4] and len(four.open("t").snapshots()) == n and set(four.open("t").refs()) == {"main"}
    with pytest.raises(ValidationError), four.transaction("t") as step:
        step.delete(col("id") == 1)
        four.append("t", [{"id": 5, "g": "c", "v": 50}])  # another writer
    assert ids(four.table("t")) == [1, 2, 3, 4, 5]
    with four.transaction("t") as step:
        step.update(col("id") == 1, {"v": 11})
        step.overwrite(spark.createDataFrame([(6, "d", 60)], "id long, g string, v long"), col("id") == 2)
        step.set_properties({"p": "1"})
    assert ids(four.table("t")) == [1, 3, 4, 5, 6] and four.open("t").meta["properties"]["p"] == "1"


def test_two_writers(four, spark):
    a, b = four.open("t"), four.open("t")
    a.append(spark.createDataFrame([(5, "x", 1)], "id long, g string, v long"))
    b.append(spark.createDataFrame([(6, "x", 1)], "id long, g string, v long"))  # starts again from the new version
    assert ids(four.table("t")) == [1, 2, 3, 4, 5, 6]
    c = four.open("t")
    a.reload().delete(col("id").column == 5)
    with pytest.raises(CommitConflict):
        c.delete(col("id").column == 6)
    failed = []

    def write(k):
        try:
            four.append("t", [{"id": 100 + k, "g": "y", "v": k}])
        except CommitConflict:
            failed.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert ids(four.table("t")) == sorted([1, 2, 3, 4, 6] + [100 + k for k in range(4) if k not in failed])


def test_half_written_version(four):
    folder = f"{four.open('t').root}/metadata"
    with open(f"{folder}/.half", "w") as x:  # what a writer that died leaves
        x.write("{")
    assert ids(four.table("t")) == [1, 2, 3, 4]
    four.append("t", [{"id": 5, "g": "x", "v": 1}])
    assert f"{folder}/.half" in four.open("t").orphans(2**53, dry_run=False) and ids(four.table("t")) == [1, 2, 3, 4, 5]


def test_refs_and_expiry(four):
    first = four.open("t").snapshot().id
    four.tag_snapshot("t", first, "v1")
    four.tag_snapshot("t", first, "brief", max_ref_age_ms=1)
    four.create_branch("t", "dev")
    assert four.list_tags("t") == ["brief", "v1"] and four.list_branches("t") == ["dev", "main"]
    for k in (5, 6, 7):
        four.append("t", [{"id": k, "g": "x", "v": k}])
    t = four.open("t")
    manifests = {s.manifest for s in t.snapshots()}
    gone = t.expire(retain_last=1)
    assert len(gone) == 2 and first in {s.id for s in t.snapshots()} and four.list_tags("t") == ["v1"]
    assert len(t.orphans(2**53)) >= 2 and all(os.path.exists(p) for p in t.orphans(2**53))
    assert four.remove_orphan_files("t") == [] and four.expire_snapshots("t", 30) == []
    t.orphans(2**53, dry_run=False)
    assert {x for x in os.listdir(f"{t.root}/metadata") if x.startswith("manifest")} == {s.manifest for s in t.snapshots()} < manifests
    assert ids(four.read_table("t", branch="v1")) == [1, 2, 3, 4] and ids(four.table("t")) == [1, 2, 3, 4, 5, 6, 7]
    t.drop_ref("dev")
    for bad in ("main", "nope"):
        with pytest.raises(ValidationError):
            t.drop_ref(bad)
    with pytest.raises(MaintenanceError):
        t.expire(retain_last=-1)
    with pytest.raises(ValueError):
        four.call_procedure("t", "vanish")


def test_metadata_tables(four):
    four.delete("t", col("id") == 4)
    t = four.open("t")
    assert t.inspect("snapshots").count() == 2 and t.inspect("history").where("is_current_ancestor").count() == 2
    assert t.inspect("files").agg(F.sum("record_count")).first()[0] == 3 == t.row_count() and t.inspect("delete_files").count() == 0
    assert t.inspect("refs").first()["name"] == "main" and t.inspect("entries").count() == 2 and t.inspect("manifests").count() == 2
    assert t.inspect("metadata_log_entries").count() >= 2 and t.inspect("partitions").first()["record_count"] == 3
    made = four.rewrite_manifests("t")
    assert made["versions_after"] <= made["versions_before"] and ids(four.table("t")) == [1, 2, 3]
    with pytest.raises(Unsupported):
        t.inspect("nope")
    s = four.stats("t")
    assert s["rows"] == 3 and s["snapshots"] == 2


def test_changes(four):
    first = four.open("t").snapshot().id
    four.update("t", col("id") == 2, {"v": 21})
    four.append("t", [{"id": 7, "g": "x", "v": 70}])
    four.delete("t", col("id") == 1)
    made = four.get_changes("t", first)
    assert ids(made["added"]) == [2, 7] and ids(made["deleted"]) == [1, 2]
    made = four.get_changes("t", first, key_cols=["id"])
    assert (ids(made["added"]), ids(made["deleted"]), ids(made["modified"])) == ([7], [1], [2])
    with pytest.raises(ValidationError):
        four.read_incremental("t")


# ---------------------------------------------------------------- writing


def test_merges(lake):
    lake.create_table("t", "id long, part string, v long")
    lake.append("t", {"id": [1, 2, 3], "part": ["a", "a", "b"], "v": [10, 20, 30]})
    assert lake.upsert("t", {"id": [2, 3, 4], "part": ["a", "x", "c"], "v": [99, 98, 97]}, ["id", "part"]) == {"rows_updated": 1, "rows_inserted": 2}
    assert sorted(map(tuple, lake.table("t").collect())) == [(1, "a", 10), (2, "a", 99), (3, "b", 30), (3, "x", 98), (4, "c", 97)]
    with pytest.raises(ValidationError):
        lake.merge("t", {"id": [1, 1], "part": ["a", "a"], "v": [0, 0]}, ["id", "part"], True, True)
    noisy = lake.spark.range(1, 6).select("id", F.lit("n").alias("part"), (F.rand() * 1000).cast("long").alias("v"))
    made = lake.merge("t", noisy, ["id", "part"], None, {"id": "id", "part": "part"})
    assert made["rows_inserted"] == 5 and lake.table("t").where("part = 'n' and v is null").count() == 5
    assert not [n for n in os.listdir(lake.open("t").root) if n.startswith("merge-")]
    empty = lake.spark.createDataFrame([], "id long, part string, v long")
    assert lake.merge("t", empty, "id", True, True) == {"rows_updated": 0, "rows_inserted": 0}


def test_add_files(lake, spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string").coalesce(1).write.parquet(f"{tmp_path}/in")
    lake.create_table("t", "name string, id long, more int")
    lake.append("t", [{"id": 0, "name": "own"}])
    lake.open("t").rename_column("name", "label")
    with pytest.raises(SchemaError):
        lake.add_files("t", [f"{tmp_path}/in"])  # its column is called otherwise now
    lake.open("t").rename_column("label", "name")
    lake.add_files("t", [f"file://{tmp_path}/in"])
    assert sorted(map(tuple, lake.table("t").collect())) == [("own", 0, None), ("x", 1, None), ("y", 2, None)]
    with pytest.raises(ValidationError):
        lake.add_files("t", [f"{tmp_path}/in"])
    lake.open("t").rename_column("name", "label")
    assert ids(lake.query("t").filter(col("label") == "y").select("id").execute()) == [2]
    assert lake.delete("t", col("label") == "x") == 1 and ids(lake.table("t").select("id")) == [0, 2]
    assert sorted(os.listdir(f"{tmp_path}/in"))  # taken in, never touched
    spark.createDataFrame([("1",)], "id string").write.parquet(f"{tmp_path}/wrong")
    with pytest.raises(SchemaError):
        lake.add_files("t", [f"{tmp_path}/wrong"])


def test_compaction(lake, spark):
    df = spark.range(60_000).select("id", (F.col("id") % 3).cast("string").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("s"), F.sha2((F.col("id") + 1).cast("string"), 256).alias("r"))
    lake.create_table("t", df, partition_spec=["g"], sort_order=["s"])
    for k in range(3):
        lake.append("t", df.where(F.col("id") % 3 == 0) if k else df)
    t = lake.open("t")
    before = {x["path"] for x in t.snapshot().files}
    assert t.compact(1, dry_run=True)["rewritten"] is False
    made = t.compact(1)
    files = t.reload().snapshot().files
    assert made["rewritten"] and all(x["bytes"] < 2 << 20 for x in files) and len({x["part"] for x in files}) == 3
    own = t.read_files(files, path_column=True)
    assert own.groupBy("_path").agg(F.count_distinct("g").alias("n")).where("n > 1").count() == 0
    for x in files:
        keys = [r[0] for r in t.read_files([x]).select("s").collect()]
        assert keys == sorted(keys)
    assert lake.table("t").count() == 100_000 and not before & {x["path"] for x in files}
    again = t.compact(1, min_files=50)
    assert not again["rewritten"]
    assert lake.compact_data_files("t", target_file_size_mb=64, partition_filter={"g": "1"})["files_before"] >= 1
    assert lake.compact_data_files("t", target_file_size_mb=64, deduplicate=True)["rewritten"] and lake.table("t").count() == 60_000
    lake.z_order_optimize("t", ["id", "s"])
    lake.maintenance.sort("t", [F.col("id").desc()])
    assert lake.table("t").count() == 60_000 and [len({x["part"]}) for x in lake.open("t").snapshot().files]
    with pytest.raises(MaintenanceError):
        t.compact(0)
    lake.enable_bloom_filters("t", ["s"], 0.05)
    lake.overwrite("t", df.limit(10))
    assert lake.table("t").count() == 10


def test_write_guards(four, spark):
    with pytest.raises(ValidationError):
        four.append("t", [{"id": 5, "g": "c", "v": -1}], validators=[col("v") > 0])
    assert ids(four.table("t")) == [1, 2, 3, 4]
    four.insert_items("t", [])
    four.insert_items("t", [{"id": 5, "g": "c", "v": 1}])
    four.query("t").insert([{"id": 6, "g": "c", "v": 1}])
    assert four.query("t").filter(col("v") == 1).update({"v": 2}) == 2 and four.query("t").filter("v = 2").delete() == 2
    with pytest.raises(ValueError):
        four.query("t").delete()
    more = MergeOnRead(four, "t")
    assert more.delete_where(col("id") == 1) == 1
    with pytest.raises(Unsupported):
        more.write_equality_deletes()
    with StreamingWriter(four, "t", batch_size=2) as w:
        w.enable_auto_compaction(2)
        for k in range(5):
            w.write({"id": 10 + k, "g": "s", "v": k})
    assert ids(four.table("t")) == [2, 3, 4, 10, 11, 12, 13, 14] and w.flushes == 3


# ---------------------------------------------------------------- queries


def test_builder_semantics(four, spark):
    q = four.query("t").with_column("v", F.col("v") + 100)
    for condition in (col("v") > 120, "v > 120", F.col("v") > 120):
        assert ids(q.filter(condition).select("id").execute()) == [3, 4]
    got = four.query("t").select("id", f.sum("v").alias("total"), f.count().alias("n")).execute()
    assert got.columns == ["id", "total", "n"] and {tuple(r)[1:] for r in got.collect()} == {(100, 4)}
    made = four.query("t").group_by("g").select(f.sum("v").alias("s"), col("id").alias("ids"), "g").having(col("s") > 40).execute()
    assert [(r.s, sorted(r.ids), r.g) for r in made.collect()] == [(70, [3, 4], "b")]
    with pytest.raises(ValueError):
        four.query("t").group_by("g").execute()
    with pytest.raises(ValueError):
        four.query("t").join("t", "id", "sideways")
    with pytest.raises(ValueError):
        f.lead("v", -1)
    with pytest.raises(ValueError):
        f.rank().over("g")
    assert ids(four.query("t").filter(col("v").between(20, 30)).select("id").execute()) == [2, 3]
    nested = four.over(spark.createDataFrame([(1, (5,), [7, 8])], "id int, s struct<x:int>, a array<int>"))
    assert tuple(nested.select(col("s").field("x").alias("x"), col("a").item(1).alias("y")).execute().first()) == (5, 8)
    a = services.advice(four.query("t").order_by("id"))
    assert len(a["suggestions"]) == 3 and not a["has_filters"]
    assert services.advice(four.query("t").filter(col("v") > 1).select("id"))["suggestions"] == []


def test_asof(four, spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 7), (4, None, 9), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 6, "x", 60), ("a", 10, "y", 100), ("b", 8, "z", 80), ("a", None, "n", 0)], "k string, t int, w string, id int")
    back = {r.id: (r.w, r.id_right) for r in four.over(left).asof_join(right, "t", "k").execute().collect()}
    assert back == {1: ("y", 100), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}
    ahead = {r.id: r.w for r in four.over(left).asof_join(right, "t", ["k"], "forward").execute().collect()}
    assert ahead == {1: "y", 2: "x", 3: "z", 4: None, 5: None}
    with pytest.raises(ValueError):
        four.over(left).asof_join(right, "t", "k", "sideways")


def test_cache(four, tmp_path):
    q = four.query("t").select("id")
    assert ids(q.cache(60).execute()) == [1, 2, 3, 4] and ids(q.cache(60).execute()) == [1, 2, 3, 4]
    assert four.results.stats()["hits"] == 1 and four.results.stats()["size"] == 1
    four.append("t", [{"id": 5, "g": "x", "v": 1}])
    assert ids(q.cache().execute()) == [1, 2, 3, 4, 5]
    assert ids(q.cache(0).execute()) == [1, 2, 3, 4, 5]
    four.results.clear()
    assert four.results.stats()["size"] == 0
    disk = services.DiskCache(str(tmp_path / "cache"))
    for _ in range(2):
        assert ids(disk.get(four.query("t").filter(col("id") > 3).select("id").execute(), {"t"})) == [4, 5]
    assert ids(disk.get(four.query("t").filter(col("id") > 4).select("id").execute(), {"t"}, ttl=-1)) == [5]
    assert disk.stats()["size"] == 1
    disk.invalidate("u")
    assert disk.stats()["size"] == 1
    disk.invalidate("t")
    assert disk.stats() == {"size": 0, "bytes": 0, "folder": disk.folder} and os.listdir(disk.folder) == []
    small = services.DiskCache(str(tmp_path / "small"), max_bytes=1)
    for k in (1, 2, 3):
        small.get(four.table("t").where(f"id > {k}"))
    assert small.stats()["size"] == 1


def test_sql_and_views(four, spark):
    four.create_view("big", "SELECT * FROM t WHERE v > 20")
    assert ids(four.sql("SELECT id FROM big")) == [3, 4] and four.list_views() == ["big"]
    with pytest.raises(CatalogError):
        four.create_view("big", "SELECT 1")
    four.create_view("big", "SELECT * FROM default.t WHERE v > 30", replace=True)
    assert ids(four.sql("SELECT id FROM big")) == [4]
    four.drop_view("big")
    with pytest.raises(CatalogError):
        four.drop_view("big")
    four.create_table("mine", "a int")
    spark.createDataFrame([(1,)], "b int").createOrReplaceTempView("mine")
    with pytest.raises(CatalogError):
        four.sql("SELECT * FROM mine")
    spark.catalog.dropTempView("mine")


def test_reads(four):
    assert four.count_rows("t") == 4 and four.head("t", 2).count() == 2 and four.to_pandas("t").shape == (4, 3) and four.to_arrow("t").num_rows == 4
    moment = datetime(2024, 5, 6, 7, 8, 9)
    times = four.spark.createDataFrame([(moment, moment.date())], "a timestamp, d date")
    four.create_table("times", times).append(times)
    batch = next(four.scan_batches("times"))
    assert batch.to_pylist()[0]["a"].astimezone().replace(tzinfo=None) == moment and batch.to_pylist()[0]["d"] == moment.date()
    batches = [*four.scan_batches("t", ["id", "g"], col("id") > 1, 2)]
    assert [b.num_rows for b in batches] == [2, 1] and batches[0].schema == batches[1].schema and batches[0].schema.field("id").type == pa.int64()
    assert sum(x.num_rows for x in four.read_table_chunked("t", 3)) == 4
    with pytest.raises(MemoryError):
        [*four.read_table_chunked("t", 3, max_memory_mb=1)]
    assert services.MemoryGuard().usage_mb() > 10 and services.MemoryGuard().check() is None
    made = four.read_tables_parallel(["t", "nope"])
    assert made["t"].count() == 4 and "error" in made["nope"]
    assert four.distribute(lambda x: x * 2, [1, 2]) == [2, 4] and four.distribute(len, []) == []
    with pytest.raises(ValidationError):
        four.read_table("t", filter=col("id") > 1, filter_sql="id > 1")
    assert four.describe("t").where("summary = 'nulls'").count() == 1


def test_async(four):
    async def run():
        async with AsyncLake(four) as a:
            await a.append("t", [{"id": 5, "g": "x", "v": 1}])
            return await a.read("t", columns=["id"]), await a.run(four.query("t").select("v")), await a.stats("t")

    rows, values, stats = asyncio.run(run())
    assert len(rows) == len(values) == 5 and stats["rows"] == 5


def test_federation(four, spark, tmp_path):
    other = Lake(spark, str(tmp_path / "other"))
    other.create_table("t", "id long, g string, v long").append(spark.createDataFrame([(9, "z", 1)], "id long, g string, v long"))
    both = Federation()
    both.add_catalog("a", four)
    both.add_catalog("b", other)
    assert both.list_catalogs() == ["a", "b"] and ids(both.union_tables([("a", "t"), ("b", "t")])) == [1, 2, 3, 4, 9]
    other.create_table("u", "x int")
    with pytest.raises(SchemaError):
        both.union_tables([("a", "t"), ("b", "u")])
    with pytest.raises(ValueError):
        both.get_catalog("c")


# ---------------------------------------------------------------- files


def test_readers_and_exports(four, spark, tmp_path):
    base, df = str(tmp_path), four.table("t")
    four.to_csv("t", f"{base}/c")
    four.to_parquet("t", f"{base}/p.parquet", ["id", "v"], col("v") > 10)
    four.to_json("t", f"{base}/j.json")
    sources.to_json(df, f"{base}/n.ndjson")
    df.write.orc(f"{base}/o.orc")
    df.write.format("xml").option("rowTag", "row").save(f"{base}/x.xml")
    with pa.OSFile(f"{base}/i.arrow", "wb") as out, pa.ipc.new_file(out, df.toArrow().schema) as w:
        w.write_table(df.toArrow())
    df.toPandas().to_stata(f"{base}/s.dta", write_index=False)
    assert ids(four.read_csv(f"{base}/c").select("id")) == ids(four.read_json(f"{base}/j.json").select("id")) == ids(four.read_ndjson(f"{base}/n.ndjson").select("id")) == [1, 2, 3, 4]
    assert ids(four.read_parquet(f"{base}/p.parquet")) == [2, 3, 4]
    for path in ("o.orc", "x.xml", "i.arrow", "s.dta"):
        assert ids(sources.read_file(spark, f"{base}/{path}").select("id")) == [1, 2, 3, 4], path
    with open(f"{base}/h.html", "w") as x:
        x.write("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x</td></tr></table>")
    assert sources.read_html(spark, f"{base}/h.html").columns == ["a", "b"]
    assert sources.from_payload(spark, {"users": [{"id": 1, "name": "n"}]}, "users").count() == 1
    with pytest.raises(ValueError):
        sources.read_file(spark, "what.ever")
    for kind in ("delta", "hudi", "avro", "lance", "vortex", "excel", "gsheets", "huggingface", "spss"):
        with pytest.raises((Unsupported, FileNotFoundError, Exception)):
            sources.READERS[kind](spark, f"{base}/none").count()
    os.makedirs(f"{base}/folder")
    for k, text in (("a.csv", "a\n1\n2\n"), ("b.csv", "a\n3\n4\n")):
        with open(f"{base}/folder/{k}", "w") as x:
            x.write(text)
    assert ids(sources.read_folder(spark, f"{base}/folder")) == [1, 2, 3, 4]
    four.create_table_from("k", "csv", f"{base}/folder")
    assert four.table("k").count() == 4
    four.create_table_from_parquet("kp", f"{base}/p.parquet")
    four.insert_from_file("kp", f"{base}/p.parquet")
    assert four.table("kp").count() == 6
    with open(f"{base}/folder/c.json", "w") as x:
        x.write("{}")
    with pytest.raises(ValueError):
        sources.read_folder(spark, f"{base}/folder")


def test_streams(four, spark, tmp_path):
    spark.createDataFrame(ROWS, "id long, g string, v long").write.parquet(f"{tmp_path}/in")
    four.create_table("s", "id long, g string, v long")
    for _ in range(2):  # the second run finds nothing new
        append_stream(four, file_stream(spark, f"{tmp_path}/in", "id long, g string, v long"), "s", f"{tmp_path}/point").awaitTermination()
    assert ids(four.table("s")) == [1, 2, 3, 4]


def test_late_rows_and_stream_joins(spark, tmp_path):
    """Rows later than the watermark are left out; two streams meet within an interval."""
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)

    def write(name, rows):
        spark.createDataFrame(rows, "k int, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def run(df, name):
        df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp-{name}").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out-{name}").awaitTermination()

    def counted():
        s = file_stream(spark, f"{tmp_path}/a", "k int, at timestamp").withWatermark("at", "10 seconds")
        return s.groupBy(F.window("at", "10 seconds"), "k").count().select(F.col("window.start").alias("at"), "k", "count")

    for rows in ([(1, at(1)), (1, at(2)), (1, at(45))], [(1, at(3)), (1, at(58))], [(1, at(59))]):
        write("a", rows)
        run(counted(), "late")
    got = {(r.at.second, r["count"]) for r in spark.read.parquet(f"{tmp_path}/out-late").collect()}
    assert (0, 2) in got and (0, 3) not in got
    write("b", [(1, at(2)), (2, at(50))])
    left = file_stream(spark, f"{tmp_path}/a", "k int, at timestamp").withWatermark("at", "1 minute")
    right = file_stream(spark, f"{tmp_path}/b", "k int, at timestamp").select(F.col("k").alias("j"), F.col("at").alias("then")).withWatermark("then", "1 minute")
    run(left.join(right, F.expr("k = j AND at BETWEEN then AND then + INTERVAL 2 SECONDS")), "join")
    assert sorted(r.at.second for r in spark.read.parquet(f"{tmp_path}/out-join").collect()) == [2, 3]


# ---------------------------------------------------------------- quality and services


def test_quality(four, spark):
    df = spark.createDataFrame([(1, "a@x", 5), (2, None, None), (2, "b", 50)], "id int, mail string, n int")
    v = Validator(four)
    assert not v.expect_unique(df, "id")["passed"] and v.expect_unique(df, "mail")["passed"]
    assert v.expect_between(df, "n", 0, 60)["details"][0]["failed"] == 1 and Validator(four, "pass").expect_between(df, "n", 0, 60)["passed"]
    assert v.expect_regex(df, "mail", "@")["details"][0]["failed"] == 2 and v.expect_in_set(df, "id", [1, 2])["passed"]
    assert not v.expect_not_null(df, "n")["passed"] and v.expect_row_count(df, 3, 3)["passed"] and not v.check_nulls(df, ["mail"])
    assert v.check_constraints("t", {"a": {"type": "not_null", "column": "id"}, "b": "v > 0"}) and four.validate_data("t", ["v > 0"])
    made = v.validate("t", [lambda d: d.count() == 4, lambda d: 1 / 0, "nope > 1"])
    assert [d["passed"] for d in made["details"]] == [True, False, False]
    with pytest.raises(ValidationError):
        Validator(four, "maybe")
    with pytest.raises(ValidationError):
        v.validate(df, [{"type": "strange"}])
    p = profile(df, "n").first()
    assert (p.n_rows, p.n_null, p.n_unique, p["mean"], round(p["std"], 3)) == (3, 1, 3, 27.5, 31.82)
    assert profile(df, "mail").first()["avg_length"] == 2.0 and describe(df).where("summary = 'nulls'").first()["n"] == "1"
    assert four.profile_column("t", "v").first()["max"] == 40


def test_services(four, spark, tmp_path):
    assert services.config_from_env({}) == {"type": "folder"} and services.config_from_env({"TARNLAKE_URI": "u", "TARNLAKE_TYPE": "rest", "TARNLAKE_TOKEN": "t"}) == {"uri": "u", "type": "rest", "token": "t"}
    services.check_config({"type": "folder", "warehouse": "w"})
    services.check_config({"type": "rest", "uri": "u", "token": "t"})
    with pytest.warns(UserWarning):
        services.check_config({"type": "rest", "uri": "u"})
    for bad in ({"type": "folder"}, {"type": "rest"}, {}):
        with pytest.raises(ValueError):
            services.check_config(bad)
    assert services.table_identifier("t") == "default.t" and services.table_identifier("a.t") == "a.t"
    assert services.plain_summary({"a": 1, "b": "x", "c": None}) == {"a": "1", "b": "x"}
    assert services.utc_ms(datetime(1970, 1, 2)) == 86_400_000 == services.utc_ms(datetime(1970, 1, 2, 1, tzinfo=timezone(timedelta(hours=1))))
    assert four.timed("q", four.table("t")) == 4
    with pytest.raises(Exception, match="nope"):
        four.timed("bad", four.sql("SELECT nope_(1)"))
    with pytest.raises(ZeroDivisionError):
        four.timed("bad", type("D", (), {"count": lambda self: 1 / 0})())
    s = four.metrics.stats()
    assert s["queries"] == 2 and s["error_rate"] == 0.5 and s["rows_returned"] == 4 and four.metrics.recent(1)[0]["error"]
    assert sum(r.n for r in four.viz.histogram("t", "v", 4).collect()) == 4 and four.viz.bars("t", "g").count() == 2 and four.viz.points("t", "id", "v").count() == 4
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(Unsupported):
            four.viz.draw(four.viz.bars("t", "g"))
    assert "<td>1</td>" in services.html_table(four.table("t")) and "&lt;" in services.html_table(spark.createDataFrame([("<",)], "x string"))
    rows, cut = four.capped(four.table("t"), rows=2)
    assert len(rows) == 2 and cut


def test_tools_and_cli(four, spark, capsys, tmp_path):
    assert four.tools.call("describe_table", name="t")[0] == {"name": "id", "type": "bigint", "nullable": True}
    assert four.tools.call("query", sql="SELECT COUNT(*) AS n FROM t")["rows"] == [{"n": 4}] and four.tools.call("read", name="t", limit=2)["truncated"] is False
    for bad in ("DROP TABLE t", " "):
        with pytest.raises(ValidationError):
            four.tools.query(bad)
    said = []
    four.tools.serve(['{"id": 1, "tool": "list_tables"}', "", '{"id": 2, "tool": "no"}', "{"], lambda x: said.append(json.loads(x)))
    assert said[0] == {"id": 1, "result": ["default.t"]} and "error" in said[1] and "error" in said[2]

    def run(*arguments, **more):
        out = []
        code = cli.main(["--warehouse", four.warehouse, *arguments], spark, out.append, **more)
        return code, "\n".join(out)

    assert run("list") == (0, "default.t") and run("list", "none") == (0, "no tables in none")
    assert "g\tstring" in run("describe", "t")[1] and len(run("head", "t", "-n", "2")[1].split("\n")) == 2 and '"rows": 4' in run("stats", "t")[1]
    assert json.loads(run("sql", "SELECT SUM(v) AS s FROM t")[1]) == {"s": 100} and run("describe", "none")[0] == 1
    assert json.loads(run("serve", lines=['{"id": 3, "tool": "table_stats", "arguments": {"name": "t"}}'])[1])["result"]["rows"] == 4
    shell = type("Shell", (), {"user_ns": {}, "register_magic_function": lambda self, fn, kind, name: setattr(self, name, fn)})()
    services.load_magic(shell, four)
    assert shell.lake("x", "SELECT id FROM t").count() == 4 and shell.user_ns["x"].count() == 4


def peak_memory(spark, after=-1):
    """Number of the last stage, and the execution memory that later stages than ``after`` took at most."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    found = [(stages.apply(i).stageId(), stages.apply(i).peakExecutionMemory()) for i in range(stages.size())]
    return max((s for s, _ in found), default=-1), max([0, *(m for s, m in found if s > after)])


@pytest.mark.parametrize("values", [4, 400])
def test_writes_by_partition_need_no_sort(lake, spark, values):
    """Rows of a few partitions go to their files as they come; those of many are sorted from the 17th on."""
    df = spark.range(200_000).selectExpr("id", f"id % {values} AS g")
    lake.create_table("t", df, partition_spec=["g"])
    t, held = lake.open("t"), spark.conf.get(OPEN_FILES)
    last, _ = peak_memory(spark)
    t.append(df)
    assert peak_memory(spark, last)[1] == 0 or values == 400
    assert spark.conf.get(OPEN_FILES) == held
    files = t.reload().snapshot().files
    assert sum(f["rows"] for f in files) == 200_000
    assert all(t.read_files([f]).select("g").distinct().count() == 1 for f in files[:: max(1, len(files) // 5)])
    assert lake.update("t", col("g") == 1, {"g": -1, "id": 0}) == 200_000 // values
    assert lake.table("t").where("g = -1 AND id = 0").count() == 200_000 // values and lake.table("t").count() == 200_000


@pytest.mark.parametrize("spec", [[], ["g"]])
def test_sorting_compaction_bounds_the_rows_of_a_task(lake, spark, monkeypatch, spec):
    """However well rows are packed, and however many are alike in the sort key."""
    df = spark.range(100_000).selectExpr("id", "id % 2 AS g", "CAST(7 AS INT) AS c")
    lake.create_table("t", df, partition_spec=spec, sort_order=["c"])
    lake.append("t", df)
    lake.append("t", df)
    t = lake.open("t")
    monkeypatch.setattr(store, "SORTED", 20_000 * t._width())
    for options in ({}, {"z_order": ["c", "id"]}, {"sort": ["c", F.col("id").desc()]}):
        t.compact(min_files=1, **options)
        files = t.reload().snapshot().files
        assert 10 <= len(files) <= 16 and max(f["rows"] for f in files) < 30_000 and lake.table("t").count() == 200_000
        assert not t.compact()["rewritten"] or spec
        t.reload()
    assert lake.table("t").groupBy("id").count().where("count = 2").count() == 100_000


def test_places_among_marks(spark):
    marks = sorted({(i * 37 % 101) / 3 for i in range(255)})
    for own in (marks, marks[:1], marks[:2], marks[:64], [*marks[:5], float("nan")], []):
        rows = spark.createDataFrame([(x,) for x in [None, float("nan"), float("-inf"), float("inf"), *marks, *[m + 0.1 for m in marks]]], "x double")
        every = F.size(F.filter(F.array(*[F.lit(q) for q in own]).cast("array<double>"), lambda q: q < F.col("x")))
        assert rows.where(~store._below(own, F.col("x")).eqNullSafe(every)).count() == 0
