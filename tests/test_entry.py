import __spark_entry__ as entry
from tallystone.plans import catalog


def test_every_query_has_a_name_and_most_an_oracle():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(catalog.QUERIES) <= set(queries)
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"complexity_pages"}


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"language", "files", "code", "tokens"} <= set(rows[0].asDict())


def test_nothing_else_imports_the_training_data_part():
    from pathlib import Path

    root = Path(entry.__file__).parent / "tallystone"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tallystone.llm" not in f.read_text(), f


def test_streaming_churn_gives_the_table_result(spark, tmp_path):
    from tallystone.streaming.churn import daily_churn

    rows = spark.createDataFrame([("a", 10, 3), ("a", 86_500, 1), ("b", 20, 2), ("a", 30, 1)], "path string, ts long, added long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = daily_churn(stream).writeStream.format("memory").queryName("churned").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("churned").collect())) == sorted(map(tuple, daily_churn(rows).collect()))


def test_code_spans_runs_the_kernel_once_a_file_and_in_several_tasks(spark, tmp_path):
    from tallystone.plans.code_catalog import TASK_FILES, sources

    parts = spark.range(2 * TASK_FILES).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").coalesce(1)
    parts.write.parquet(str(tmp_path / "part.parquet"))
    assert sources(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    plan = entry.queries()["code_spans"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
