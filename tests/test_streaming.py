import datetime as dt

from orbweave.streaming.edges import stream_pairs


def test_pairs_of_a_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "trackid string, time timestamp, cell long"
    for part, hours in enumerate(([0, 6], [12, 18])):
        rows = [(t, start + dt.timedelta(hours=h), h // 6 + (t == "b")) for t in ("a", "b") for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_pairs(stream).writeStream.format("memory").queryName("pairs_out").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.trackid, r.orig, r.dest) for r in spark.table("pairs_out").collect()}
    assert got == {("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 1, 2), ("b", 2, 3), ("b", 3, 4)}
