"""The windowed counts of a stream equal those of the table it is made of."""

from cairnwork.streaming.usage import windowed_usage

SF = "/root/testdata/sf0.001"


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_usage(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    rows = [sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in x.collect()) for x in (spark.table("usage"), windowed_usage(table))]
    assert rows[0] == rows[1] and rows[0]
