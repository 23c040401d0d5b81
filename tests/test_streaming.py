from lakequill.streaming.files import follow


def test_new_files_are_taken_once(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    spark.range(5).write.parquet(source)
    for expected in (3, 3, 6):
        follow(spark, source, "parquet", target, marks, lambda df: df.filter("id >= 2")).awaitTermination()
        assert spark.read.parquet(target).count() == expected
        if expected == 3 and spark.read.parquet(source).count() == 5 and (tmp_path / "second").exists():
            spark.range(5).write.mode("append").parquet(source)
        (tmp_path / "second").touch()
