import random

from pyspark.sql import functions as F

from statloom.streaming.stateful import limited_sessions, stream_limited_sessions

HOUR, MINUTE = 3_600_000_000, 60_000_000


def rows(seed):
    rng = random.Random(seed)
    out = [(k, t * 20 * MINUTE + rng.randrange(MINUTE)) for k in ("a", "b") for t in range(70)]  # no pause: cut at 8 hours
    out += [("c", rng.randrange(40 * HOUR)) for _ in range(60)] + [("d", 0), ("d", 30 * MINUTE), ("d", 60 * MINUTE + 1)]
    return [(k, 1000 * HOUR + t) for k, t in out]


def run(spark, folder, batches, name):
    schema = "user string, us long"
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(folder / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "in")).withColumn("ts", F.timestamp_micros("us"))
    told = stream_limited_sessions(stream, "user", "ts", late="1 hour")
    q = told.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    left = [p["numRowsTotal"] for p in q.lastProgress["stateOperators"]]
    return sorted(tuple(r) for r in spark.table(name).where("user <> 'end'").collect()), left


def test_stream_cuts_sessions_as_the_batch_does(spark, tmp_path):
    events = rows(1)
    batch = spark.createDataFrame(events, "user string, us long").withColumn("ts", F.timestamp_micros("us"))
    want = sorted((r["user"], r["start_us"], r["end_us"], r["n"]) for r in limited_sessions(batch, "user", "ts").collect())
    events.sort(key=lambda e: e[1] + random.Random(e[1]).randrange(50 * MINUTE))  # late by less than the hour
    parts = [events[i : i + 60] for i in range(0, len(events), 60)] + [[("end", 2000 * HOUR)], [("end", 3000 * HOUR)]]
    got, left = run(spark, tmp_path, parts, "first")
    assert got == want and any(r[2] - r[1] > 7 * HOUR for r in got) and all(r[2] - r[1] <= 8 * HOUR for r in got)
    again, _ = run(spark, tmp_path, [], "again")
    assert again == got
    assert max(left) < 20  # of the keys that ended nothing stays
