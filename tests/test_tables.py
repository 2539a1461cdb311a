import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators.upsert import upsert_buckets
from wayfold.plans import dossier
from wayfold.sources import tables


def rows_scanned(df):
    """Rows that the file scans of a finished query handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"):
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan parquet"):
            total += node.metrics().get("numOutputRows").get().value()
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def keyed(spark, path, n=200_000):
    df = spark.range(0, n).selectExpr("id * 2 AS k", "uuid() AS v")
    tables.write_keyed(df, path, "k", group_bytes=1 << 16)
    return n


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    path = f"{tmp_path}/t"
    n = keyed(spark, path)
    keys = spark.createDataFrame([(10,), (11,), (200_000,), (None,), (10,), (399_998,)], "k long")
    found = tables.lookup(spark, path, "k", keys)
    assert sorted(r["k"] for r in found.collect()) == [10, 200_000, 399_998]
    assert rows_scanned(found) < 0.2 * n
    near = tables.lookup(spark, path, "k", spark.createDataFrame([(k,) for k in range(1001, 1601)], "k long"))
    assert near.count() == 300 and rows_scanned(near) < 0.2 * n
    assert tables.lookup(spark, path, "k", keys.limit(0)).count() == 0
    assert tables.first_row(spark, path, "k", 10)["k"] == 10 and tables.first_row(spark, path, "k", 11) is None


def test_a_missing_key_between_others_is_ruled_out_by_the_bloom_filters(spark, tmp_path):
    path = f"{tmp_path}/t"
    n = keyed(spark, path)
    odd = tables.lookup(spark, path, "k", spark.createDataFrame([(100_001,), (300_001,)], "k long"))
    assert odd.count() == 0 and rows_scanned(odd) < 0.05 * n


def test_more_keys_than_the_reader_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PUSHED", 10)
    path = f"{tmp_path}/t"
    n = keyed(spark, path)
    found = tables.lookup(spark, path, "k", spark.range(5000, 5100).withColumnRenamed("id", "k"))
    assert found.count() == 50 and rows_scanned(found) < 0.2 * n


@pytest.mark.parametrize("by_table", [False, True])
def test_tenant_scope_prunes_folders(spark, tmp_path, by_table):
    rows = spark.range(1000).selectExpr("id % 10 AS tenant_id", "id AS x")
    tables.TenantTables.write(rows, str(tmp_path), "log")
    spark.createDataFrame([(3, "on"), (5, "off"), (7, "on"), (99, "on")], "tenant_id long, state string").write.parquet(f"{tmp_path}/tenants")
    chosen = spark.read.parquet(f"{tmp_path}/tenants").filter("state = 'on'") if by_table else [3, 7, 99]
    scope = tables.TenantTables(spark, str(tmp_path), chosen)
    out = scope.read("log").agg(F.sum("x").alias("x"))
    assert out.first()["x"] == sum(i for i in range(1000) if i % 10 in (3, 7))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan or "PartitionFilters: [tenant_id" in plan
    assert ("dynamicpruning" in plan) == by_table
    assert not hasattr(scope, "scan") and rows_scanned(scope.read("log")) <= 200 + 4


def test_a_second_run_replaces_rows_and_leaves_other_buckets_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    frame = lambda data: spark.createDataFrame(data, "a long, b long, v string, at long")
    upsert_buckets(spark, path, frame([(i, None if i % 2 else i, "first", 1) for i in range(500)]), ["a", "b"], ["at"], buckets=64)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    for _ in range(2):  # a repeated run changes nothing
        upsert_buckets(spark, path, frame([(1, None, "second", 2), (2, 2, "old", 0), (900, None, "new", 2), (900, None, "newer", 3)]), ["a", "b"], ["at"], buckets=64)
    got = {(r["a"], r["b"]): r["v"] for r in spark.read.parquet(path).collect()}
    assert spark.read.parquet(path).count() == len(got) == 501
    assert got[1, None] == "second" and got[2, 2] == "first" and got[900, None] == "newer" and got[3, None] == "first"
    left = {p for p in (tmp_path / "t").rglob("*.parquet") if before.get(p) == p.stat().st_mtime_ns}
    assert len(before) - 3 <= len(left) < len(before)


def test_a_dossier_is_one_exchange_and_lists_are_bounded(spark):
    rng = random.Random(4)
    logs = [(rng.randrange(30), rng.randrange(50), i, f"v{i}") for i in range(900)] + [(7, 60 + i % 3, 1000 + i, "hot") for i in range(800)]
    spine = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "target_id long, status string")
    log = spark.createDataFrame(logs, "target_id long, at long, seq long, v string").withColumn("at", F.timestamp_seconds("at"))
    some = log.filter("seq % 2 = 0")
    wide = dossier.wide_rows(spine, "target_id", {"one": dossier.Log(log, "at", "seq", ("v", "seq")), "many": dossier.Log(some, "at", "seq", ("v", "seq"), 3)})
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {r["target_id"]: r for r in wide.collect()}
    assert set(got) == set(range(40))
    for t, r in got.items():
        mine = sorted(((a, q, v) for k, a, q, v in logs if k == t), reverse=True)
        half = [x for x in mine if x[1] % 2 == 0]
        assert r["status"] == f"t{t}" and r["one_count"] == len(mine) and r["many_count"] == len(half)
        assert (r["one"] and r["one"]["seq"]) == (mine[0][1] if mine else None)
        assert [x["seq"] for x in r["many"]] == [q for _, q, _ in half[:3]]


def test_a_row_of_several_logs_moves_once(spark):
    logs = [(i % 7, i // 7 % 5, i, "OFR"[i % 3] if i % 11 else None) for i in range(300)]
    spine = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "target_id long, status string")
    log = spark.createDataFrame(logs, "target_id long, at long, seq long, flag string").withColumn("at", F.timestamp_seconds("at"))
    kinds = {"all": (F.lit(True), 0), "open": (F.col("flag") == "O", 2), "shut": (F.col("flag") == "F", 0)}
    shared = dossier.wide_rows(spine, "target_id", {k: dossier.Log(log, "at", "seq", ("seq", F.upper("flag").alias("f")), n, w) for k, (w, n) in kinds.items()})
    apart = dossier.wide_rows(spine, "target_id", {k: dossier.Log(log.filter(w), "at", "seq", ("seq", F.upper("flag").alias("f")), n) for k, (w, n) in kinds.items()})
    assert sorted(shared.collect()) == sorted(apart.collect())
    plan = shared._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and apart._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 4
