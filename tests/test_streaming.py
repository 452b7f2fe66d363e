from sparkloom.streaming import findings


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", "a", "critical"), ("2024-01-01 23:00:00", "a", "warning"), ("2024-01-02 01:00:00", "b", "warning"), ("2024-01-05 00:00:00", "b", "info")]
    spark.createDataFrame(rows, "t string, rule_id string, severity string").selectExpr("cast(t AS timestamp) AS ts", "rule_id", "'imports' AS category", "severity").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, rule_id string, category string, severity string").parquet(f"{tmp_path}/in")
    query = findings.windowed_counts(stream).writeStream.format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/at").start()
    query.processAllAvailable()
    query.stop()
    got = findings.windowed_adjustments(spark.table("counts")).orderBy("start").collect()
    assert [(str(r["start"])[:10], r["findings"], r["burden"], r["critical_risk"]) for r in got] == [("2024-01-01", 2, 1.1, 10.0), ("2024-01-02", 1, 1.1, 0.0)]
