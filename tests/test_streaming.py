import pytest

from larkspur.plans import suite
from larkspur.streaming import windows


def test_buckets_and_sessions_over_a_stream(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, f in (("b", lambda d: windows.bucket_counts(d, "ts", "6 hours", "event_type")), ("s", lambda d: windows.sessions(d, "ts", "30 minutes", "user_id"))):
        q = f(stream).writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(batch).collect()))


@pytest.mark.parametrize("name", ["streaming_buckets", "streaming_sessions"])
def test_streamed_results_are_files_that_the_driver_does_not_hold(spark, sf_dir, tmp_path, name):
    assert suite.QUERIES[name](spark, sf_dir).inputFiles()
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert suite.QUERIES[name](spark, str(tmp_path)).count() == 0
