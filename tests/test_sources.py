from fieldspark.sources.tables import from_wide, table, write_text


def test_wide_tables_become_long(spark):
    wide = spark.createDataFrame([(1, 10.0, 20.0), (2, None, 40.0)], "ncol int, t850 double, t500 double")
    out = from_wide(wide, ["ncol"], "plev", {850.0: "t850", 500.0: "t500"}, "t")
    assert sorted((r.ncol, r.plev, r.t) for r in out.collect() if r.t is not None) == [(1, 500.0, 20.0), (1, 850.0, 10.0), (2, 500.0, 40.0)]
    assert out.columns == ["ncol", "plev", "t"] and out.count() == 4


def test_tables_are_pruned_to_what_is_read(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS v", "'x' AS s").write.parquet(str(tmp_path / "f.parquet"))
    plan = table(spark, str(tmp_path), "f").filter("id > 5").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in plan and "s:string" not in plan


def test_text_sink():
    seen = []
    write_text(["a", "b"], seen.append)
    assert seen == ["a", "b"]
