from quartzite.plans.cleaning import COLS, ROLES, contacts
from quartzite.streaming.standardize import issue_rate, standardized


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    df = contacts(spark, sf_dir).select(*COLS)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = standardized(stream, ROLES).writeStream.format("memory").queryName("std").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, spark.table("std").collect())) == sorted(map(key, standardized(df, ROLES).collect()))


def test_issue_rate_drops_late_rows(spark, tmp_path):
    """Windows are counted by event time; a row later than the delay no longer counts once the watermark has passed its window."""
    schema = "at timestamp, phone string"
    write = lambda i, rows: spark.createDataFrame(rows, "at string, phone string").selectExpr("CAST(at AS timestamp) AS at", "phone").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    batches = [
        [("2024-01-01 10:05:00", "(214) 555-0100"), ("2024-01-01 10:40:00", "12")],
        [("2024-01-01 13:00:00", "2145550100")],  # lifts the watermark to 12:50
        [("2024-01-01 10:10:00", "2145550100"), ("2024-01-01 13:20:00", None)],  # the first is too late
        [("2024-01-01 20:00:00", "2145550100")],
    ]
    write(0, batches[0])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = issue_rate(stream, {"phone": "phone"}, "at").writeStream.format("memory").queryName("rate").outputMode("append").start()
    q.processAllAvailable()
    for i, rows in enumerate(batches[1:], 1):
        write(i, rows)
        q.processAllAvailable()
    q.stop()
    got = {r.start.hour: (r.n, r.with_issue) for r in spark.table("rate").collect()}
    assert got[10][0] == 2 and got[13][0] == 2
    assert got[10][1] >= 1
