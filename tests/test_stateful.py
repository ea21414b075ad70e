import time

from driftlog.streaming.stateful import ROCKSDB, quiet_counts


def test_counts_come_when_a_key_is_quiet(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        spark.createDataFrame([("a",), ("a",), ("b",)], "pk string").coalesce(1).write.parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema("pk string").parquet(str(tmp_path / "in"))
        q = (
            quiet_counts(rows, quiet_ms=500).writeStream.format("memory").queryName("quiet").outputMode("append")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        )
        end = time.time() + 90
        while time.time() < end and spark.table("quiet").count() < 2 and q.isActive:
            time.sleep(1)
        got = {(r.pk, r.n) for r in spark.table("quiet").collect()}
        q.stop()
        assert got == {("a", 2), ("b", 1)}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
