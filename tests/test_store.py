"""The commit log: builds of several tables, competing writers, replays, metadata, schemas."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from listloom.operators import store
from listloom.session import fresh_path


def numbers(spark, n, **columns):
    return spark.range(n).withColumns({k: F.lit(v) for k, v in columns.items()})


def test_put_if_absent_has_one_winner(spark):
    path = f"{fresh_path(spark, 't-put')}/log/1.json"
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append((i, store.put_if_absent(spark, path, f"{i}\n" * 1000)))) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [i for i, ok in won if ok]
    assert len(winners) == 1
    assert [r[0] for r in spark.read.text(path).distinct().collect()] == [str(winners[0])]


def test_competing_builds_both_stand(spark):
    """Two writers of the same tables: each build is whole, and each part ends with the later one."""
    root = fresh_path(spark, "t-race")
    barrier, failed = threading.Barrier(3), []

    def build(k):
        try:
            staged = [store.stage(numbers(spark, 10 + k, by=k), root, name) for name in ("events", "films")]
            barrier.wait()
            store.commit(spark, root, staged, built_at=str(k))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=build, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    log = store.manifest(spark, root).collect()
    assert {r["commit"] for r in log} == {0, 1, 2} and {r["version"] for r in log} == {0, 1, 2}
    for number in (0, 1, 2, None):
        pair = [{r["by"] for r in store.read_current(spark, root, name, at=number).collect()} for name in ("events", "films")]
        assert pair[0] == pair[1] and len(pair[0]) == 1  # never events of one build with films of another


def test_conflict_with_what_was_read(spark):
    root = fresh_path(spark, "t-conflict")
    store.publish(numbers(spark, 3, v=1), root, "t", "a")
    base = store.last_commit(spark, root)
    store.publish(numbers(spark, 3, v=2), root, "t", "b")
    store.publish_together({"u": numbers(spark, 1)}, root, base=base)
    store.commit(spark, root, [store.stage(numbers(spark, 3, v=3), root, "t", "a")], base=base)  # b changed, a did not
    with pytest.raises(store.Conflict):
        store.commit(spark, root, [store.stage(numbers(spark, 3, v=4), root, "t", "a")], base=base)
    assert {(r["v"], r["n"]) for r in store.read_current(spark, root, "t").groupBy("v").agg(F.count("*").alias("n")).collect()} == {(2, 3), (3, 3)}


def test_uncommitted_folders_are_invisible(spark):
    root = fresh_path(spark, "t-staged")
    store.stage(numbers(spark, 5), root, "t")
    assert store.read_current(spark, root, "t") is None and store.last_commit(spark, root) == -1
    assert store.commit(spark, root, []) == [] and store.builds(spark, root).collect() == []


def test_metadata_is_counted_on_the_way(spark):
    root = fresh_path(spark, "t-meta")
    tables = {"t": numbers(spark, 1000).repartition(3), "none": numbers(spark, 0), "local": spark.createDataFrame([], "id long")}
    done = store.publish_together(tables, root, "2024-01-01", notes={"run": "nightly"}, measures={"t": {"top": F.max("id"), "sum": F.sum("id")}, "none": {"top": F.max("id")}})
    assert {(s.name, s.n_rows) for s in done} == {("t", 1000), ("none", 0), ("local", 0)}
    assert {(r["key"], r["value"]) for r in store.metadata(spark, root).collect()} == {("run", "nightly"), ("t.top", "999"), ("t.sum", "499500"), ("none.top", None)}
    build = store.builds(spark, root).first()
    paths = [s.path for s in done]
    assert build["n_rows"] == 1000 and build["n_tables"] == 3
    assert build["n_bytes"] == spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths).agg(F.sum("length")).first()[0]
    store.publish_parts(numbers(spark, 10).withColumn("source", F.concat(F.lit("s/"), F.col("id") % 3)), root, "p", "source")
    parts = {r["part"]: (r["n_rows"], r["n_bytes"] > 0, r["n_files"]) for r in store.current_entries(spark, root, "p").collect()}
    assert parts == {"s/0": (4, True, 1), "s/1": (3, True, 1), "s/2": (3, True, 1)}


def test_schemas_widen_and_never_narrow(spark):
    root = fresh_path(spark, "t-schema")
    one = spark.createDataFrame([(1, 1.5, "a")], "k int, x float, note string")
    two = spark.createDataFrame([(2**40, 2.5, True)], "k long, x double, flag boolean")
    store.publish(one, root, "t", "a")
    store.publish(two, root, "t", "b")
    got = store.read_current(spark, root, "t", defaults={"note": "?"})
    assert got.dtypes == [("k", "bigint"), ("x", "double"), ("note", "string"), ("flag", "boolean")]
    assert {tuple(r) for r in got.collect()} == {(1, 1.5, "a", None), (2**40, 2.5, "?", True)}
    with pytest.raises(store.Narrowing):
        store.publish(one, root, "t", "b")
    with pytest.raises(store.Narrowing):
        store.publish(one.withColumn("k", F.col("k").cast("string")), root, "t", "a")
    assert store.last_commit(spark, root) == 1
    assert [tuple(r) for r in store.schema_history(spark, root, "t").orderBy("commit", "position").select("part", "column", "type").collect()] == [
        ("a", "k", "int"), ("a", "x", "float"), ("a", "note", "string"), ("b", "k", "bigint"), ("b", "x", "double"), ("b", "flag", "boolean")]


@pytest.mark.parametrize("one,other,both", [("int", "bigint", "bigint"), ("bigint", "smallint", "bigint"), ("int", "double", "double"), ("float", "int", None), ("bigint", "double", None),
                                            ("decimal(10,2)", "decimal(8,4)", "decimal(12,4)"), ("string", "int", None), ("void", "string", "string"), ("date", "timestamp_ntz", "timestamp_ntz")])
def test_wider(one, other, both):
    assert store.wider(one, other) == store.wider(other, one) == both


def test_log_is_plain_lines(spark):
    root = fresh_path(spark, "t-lines")
    store.publish(numbers(spark, 2), root, "t", built_at="2024-02-02")
    lines = [json.loads(r[0]) for r in spark.read.text(f"{root}/log").collect()]
    assert len(lines) == 1 and lines[0]["n_rows"] == 2 and lines[0]["version"] == 0 and lines[0]["built_at"] == "2024-02-02"
