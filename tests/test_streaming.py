import datetime as dt

from panelweave.operators.cleaning import resample
from panelweave.streaming.bars import streaming_bars

TICK = "stock_code string, ts timestamp, seq int, price double, qty double"


def test_streamed_bars_equal_resampled_ones(spark, tmp_path):
    at = lambda i: dt.datetime(2026, 4, 24, 9, 30) + dt.timedelta(seconds=37 * i)
    rows = [("a" if i % 3 else "b", at(i), i, 10.0 + i % 7, 1.0) for i in range(200)] + [("a", dt.datetime(2026, 4, 24, 9, 35), 900, 50.0, 1.0), ("z", dt.datetime(2026, 4, 25), 901, 1.0, 1.0)]
    ticks = spark.createDataFrame(rows, TICK)
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("bars_out").collect()}
    want = {tuple(r) for r in resample(ticks, (5,)).where("stock_code <> 'z'").drop("minutes").collect()}
    assert got == want and len(want) > 40
