import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lorekeep.plans import jobs
from lorekeep.session import checkpointed, new_dir, shared_dir, union_all
from lorekeep.sources import catalog
from lorekeep.sources.sinks import append_columns, save_table
from lorekeep.streaming.incremental import folder_per_batch, ingest_new


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert checkpointed(spark.range(3)).count() == 3


def test_union_of_partitioned_inputs_groups_right(spark):
    small = spark.range(10).repartition(2, "id")
    large = spark.range(1000).repartition(7, "id")
    assert union_all([small, large]).groupBy("id").count().filter("count = 2").count() == 10


def test_register_scan_and_refresh(spark):
    root = new_dir(spark, "t")
    first = catalog.refresh_table(spark.range(3), "test_src", "numbers", root, 1)
    assert first.count() == 3
    old = catalog.scan(spark, "test_src", "numbers")
    new = catalog.refresh_table(old.filter("id > 0"), "test_src", "numbers", root, 2)
    assert sorted(r["id"] for r in new.collect()) == [1, 2]
    with pytest.raises(AnalysisException):
        catalog.refresh_table(spark.range(9), "test_src", "numbers", root, 2)
    assert sorted(r["id"] for r in catalog.scan(spark, "test_src", "numbers").collect()) == [1, 2]
    catalog.ensure_source(spark, "test_src")
    counts = catalog.table_counts(spark, "test_src", ["numbers"]).collect()
    assert [tuple(r) for r in counts] == [("numbers", 2)]


def test_register_csv_with_options(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;x\n2;y\n")
    options = {"path": str(tmp_path / "a.csv"), "header": "true", "sep": ";"}
    for _ in range(2):
        table = catalog.register_external(spark, "test_src", "letters", "csv", options)
    assert [r["b"] for r in table.orderBy("a").collect()] == ["x", "y"]


def test_sql_parameters_need_no_escaping(spark):
    spark.createDataFrame([("O'Hara",), ("x",)], "name string").createOrReplaceTempView("people")
    found = catalog.run_sql(spark, "SELECT name FROM people WHERE name = :n", {"n": "O'Hara"})
    assert [r["name"] for r in found.collect()] == ["O'Hara"]


def test_sql_source_is_the_default_database(spark):
    catalog.ensure_source(spark, "test_other")
    save_table(spark.range(5), "test_other.five")
    before = spark.catalog.currentDatabase()
    assert catalog.run_sql(spark, "SELECT * FROM five", source="test_other").count() == 5
    assert spark.catalog.currentDatabase() == before


def test_append_matches_columns_by_name(spark):
    catalog.ensure_source(spark, "test_other")
    save_table(spark.createDataFrame([(1, "x")], "a int, b string"), "test_other.pairs")
    append_columns(spark.createDataFrame([("y", 2)], "b string, a int"), "test_other.pairs", ["b", "a"])
    assert {tuple(r) for r in spark.table("test_other.pairs").collect()} == {(1, "x"), (2, "y")}
    with pytest.raises(ValueError):
        append_columns(spark.range(1), "test_other.pairs", ["id"])


def deliver(df, source, n):
    df.write.mode("overwrite").parquet(f"{source}/part={n}")


@pytest.mark.parametrize("cuts", [[10], [3, 10], [1, 1, 5, 10]])
def test_incremental_equals_one_batch(spark, cuts):
    source, target, state = (new_dir(spark, n) for n in ("in", "out", "state"))
    schema = spark.range(1).schema
    start = 0
    for n, end in enumerate(cuts):
        deliver(spark.range(start, end), source, n)
        for _ in range(2):  # the second run finds nothing new
            ingest_new(spark, f"{source}/*", schema, state, folder_per_batch(target))
        start = end
    got = [r["id"] for r in spark.read.parquet(target).select("id").collect()]
    assert sorted(got) == list(range(10))


def test_incremental_batches_may_be_repeated(spark):
    source, target, state = (new_dir(spark, n) for n in ("in", "out", "state"))
    deliver(spark.range(4), source, 0)
    deliver(spark.range(0), source, 1)
    once = folder_per_batch(target)

    def twice(batch, batch_id):
        once(batch, batch_id)
        once(batch, batch_id)

    ingest_new(spark, f"{source}/*", spark.range(1).schema, state, twice, max_files_per_batch=1)
    assert sorted(r["id"] for r in spark.read.parquet(target).select("id").collect()) == [0, 1, 2, 3]


def test_jobs_are_gated_and_logged(spark):
    log = jobs.RunLog(spark, new_dir(spark, "log"))
    done = []

    def ok():
        done.append(1)
        return 7

    def fails():
        raise RuntimeError("broken; really")

    some, none = spark.range(1), spark.range(0)
    assert jobs.run_job("p", "yes", [ok, ok], log, some) == "done"
    assert jobs.run_job("p", "no", [ok], log, none) == "skipped"
    assert jobs.run_job("p", "bad", [ok, fails, ok], log) == "failed"
    assert jobs.run_job("q", "yes", [ok], log) == "done"
    assert len(done) == 4
    got = {(r["project"], r["name"]): (r["status"], r["rows"], r["error"]) for r in log.read().collect()}
    assert got[("p", "yes")] == ("done", 14, None)
    assert got[("p", "no")] == ("skipped", 0, None)
    assert got[("p", "bad")] == ("failed", 7, "RuntimeError: broken; really")
    assert jobs.history(log.read(), "p").count() == 3
    assert jobs.history(log.read(), "p", "yes").count() == 1
    jobs.run_job("p", "yes", [fails], log)
    status = {(r["project"], r["name"]): r["status"] for r in jobs.latest_status(log.read()).collect()}
    assert status == {("p", "yes"): "failed", ("p", "no"): "skipped", ("p", "bad"): "failed", ("q", "yes"): "done"}


def test_staged_load_moves_one_date_once(spark):
    catalog.ensure_source(spark, "test_stage")
    rows = spark.range(30).withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")))
    jobs.create_staging(rows, "test_stage.staging")
    main = new_dir(spark, "main")
    assert jobs.load_staged(spark, "test_stage.staging", main, "2024-01-02", "r1") == 10
    assert jobs.load_staged(spark, "test_stage.staging", main, "2024-01-02", "r1") == 0
    assert spark.read.parquet(main).count() == 10
    assert spark.table("test_stage.staging").count() == 20
    assert jobs.load_staged(spark, "test_stage.staging", main, "2024-01-03") == 10
    assert spark.read.parquet(main).select("id").distinct().count() == 20


def test_late_rows_and_crashes_lose_nothing(spark, monkeypatch):
    catalog.ensure_source(spark, "test_stage")
    day = F.lit("2024-01-02").cast("date").alias("date")
    jobs.create_staging(spark.range(10).select("id", day), "test_stage.late")
    main = new_dir(spark, "main")
    assert jobs.load_staged(spark, "test_stage.late", main, "2024-01-02", "r1") == 10
    jobs.stage_rows(spark.range(10, 13).select("id", day), "test_stage.late")
    assert jobs.load_staged(spark, "test_stage.late", main, "2024-01-02", "r1") == 0
    assert spark.read.parquet(main).count() == 10 and spark.table("test_stage.late").count() == 3

    real = spark.sql

    def broken(text, *more, **named):
        if "DROP" in text:
            raise RuntimeError("lost")
        return real(text, *more, **named)

    monkeypatch.setattr(spark, "sql", broken, raising=False)
    with pytest.raises(RuntimeError):  # written, but not dropped
        jobs.load_staged(spark, "test_stage.late", main, "2024-01-02")
    monkeypatch.undo()
    jobs.stage_rows(spark.range(13, 15).select("id", day), "test_stage.late")
    assert jobs.load_staged(spark, "test_stage.late", main, "2024-01-02") == 2
    assert sorted(r["id"] for r in spark.read.parquet(main).collect()) == list(range(15))
    assert spark.table("test_stage.late").count() == 0


def test_sql_steps_and_whole_errors(spark):
    log = jobs.RunLog(spark, new_dir(spark, "log"))
    catalog.ensure_source(spark, "test_other")
    steps = ["CREATE OR REPLACE TEMP VIEW step_one AS SELECT 5 AS a", "CREATE TABLE test_other.made_by_step AS SELECT a FROM step_one"]
    assert jobs.run_job("p", "sql", steps, log, "SELECT 1 WHERE :x = 1", {"x": 1}) == "done"
    assert spark.table("test_other.made_by_step").first()["a"] == 5
    assert jobs.run_job("p", "gate", steps, log, "SELECT 1 WHERE :x = 1", {"x": 2}) == "skipped"

    def fails():
        raise RuntimeError("x" * 9_000)

    jobs.run_job("p", "long", [fails], log)
    last = {r["name"]: r for r in jobs.latest_status(log.read()).collect()}
    assert len(last["long"]["error"]) > 9_000 and last["sql"]["rows"] == 0 and last["sql"]["start_ts"] is not None
