from pyspark.sql import functions as F

from loomstack.operators import dedup as D

EVENTS = "id long, session_id long, part_ordinal long, native_event_id string, bucket string"


def test_surplus_rows(spark):
    rows = [(4, 1, 0, "A", "x"), (2, 1, 0, " a\n", "x"), (9, 1, 0, "a", "x"), (3, 1, 1, "a", "x"), (5, 2, 0, "a", "x"), (6, 1, 0, None, "x"), (7, 1, 0, " ", "x"), (8, None, 0, "a", "x"), (10, None, 0, "a", "x"), (11, 1, None, "a", "x"), (11, 1, None, "a", "x")]
    e = spark.createDataFrame(rows, EVENTS)
    assert sorted(r.event_id for r in D.surplus(e).collect()) == [4, 9]
    assert D.deduplicated(e).count() == len(rows) - 2
    assert D.surplus(e.where("false")).count() == 0


def test_upserts_are_idempotent_and_compaction_merges_runs(spark, tmp_path):
    store = D.BucketedStore(spark, f"file://{tmp_path}/store", buckets=3)
    a = D.keyed(spark.createDataFrame([(5, 1, 0, "a", ""), (6, 1, 0, "b", "")], EVENTS))
    b = D.keyed(spark.createDataFrame([(2, 1, 0, "A", ""), (7, 1, 0, "c", "")], EVENTS))
    for batch, rows in (("1", a), ("2", b), ("2", b), ("1", a)):
        store.upsert(rows, batch)
    assert sum(store.run(r).count() for r in store.runs()) == 4
    assert {(r.native_id, r.id) for r in store.compact().collect()} == {("a", 2), ("b", 6), ("c", 7)}


def test_merge_needs_no_exchange_and_no_sort(spark, tmp_path):
    store = D.BucketedStore(spark, f"file://{tmp_path}/store", buckets=4)
    rows = D.keyed(spark.range(1, 2000).selectExpr("id", "id % 7 as session_id", "0L as part_ordinal", "cast(id % 500 as string) as native_event_id"))
    store.upsert(rows.where("id < 1200"), "1")
    store.upsert(rows.where("id >= 1000"), "2")
    with D._setting(spark, D._ORDERING, "true"):
        merged = store.merged("1", "2")
        plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    want = {}
    for r in rows.collect():
        k = (r.session_id, r.native_id)
        want[k] = min(want.get(k, r.id), r.id)
    assert {(r.session_id, r.native_id): r.id for r in store.compact().collect()} == want
    assert len(store.runs()) == 1 and D.BucketedStore(spark, store.path, 4).compact().count() == len(want)


def test_store_is_found_again_without_its_tables(spark, tmp_path):
    store = D.BucketedStore(spark, f"file://{tmp_path}/store", buckets=2)
    e = D.keyed(spark.createDataFrame([(5, 1, 0, "a", ""), (6, 1, 0, "b", "")], EVENTS))
    store.upsert(e, "1")
    store.upsert(e.withColumn("id", e.id - 2), "2")
    for r in store.runs():
        spark.sql(f"drop table {store._name(r)}")
    assert {r.id for r in store.compact().collect()} == {3, 4}


def test_versions_fold(spark):
    rows = [(1, 1, 0, "a", 1, False), (2, 1, 0, "A ", 2, False), (3, 1, 0, "a", 2, False), (4, 1, 0, "b", 1, False), (5, 1, 0, "b", 2, True), (6, 1, 0, "c", None, False), (7, 1, 0, "c", 0, False), (8, 1, 0, None, None, False), (9, 1, 0, "d", 3, False), (10, 1, 0, "d", 1, True)]
    e = spark.createDataFrame(rows, "id long, session_id long, part_ordinal long, native_event_id string, v long, del boolean")
    assert sorted(r.id for r in D.folded_versions(e, F.col("v"), F.col("del")).collect()) == [2, 7, 8, 9]
    assert sorted(r.id for r in D.folded_versions(e, F.col("v")).collect()) == [2, 5, 7, 8, 9]
    assert sorted(r.id for r in D.folded_versions(e).collect()) == [1, 4, 6, 8, 9]


def test_hot_identifier(spark):
    e = spark.range(1, 20_001).selectExpr("id", "1L as session_id", "0L as part_ordinal", "'same' as native_event_id")
    assert D.surplus(e).count() == 19_999
