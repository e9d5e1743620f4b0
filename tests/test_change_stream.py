"""A stream of observations gives the changes that a replay of all of them as a table gives."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from groundwell.streaming import changes

START = datetime(2026, 3, 1)
SCHEMA = "path string, seen timestamp, digest string, delivery string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def rows(df):
    return sorted((r.path, r.at, r.kind, r.digest) for r in df.collect())


def test_quick_edits_repeats_and_removals(spark):
    seen = [("a", 0, "1"), ("a", 1, "2"), ("a", 2, "3"), ("a", 10, "3"), ("a", 20, None), ("a", 30, "4"), ("b", 5, None), ("b", 9, "x"), ("b", 9.5, None), (None, 1, "q"), ("c", 1, "1"), ("c", 1, "2")]
    df = spark.createDataFrame([(p, at(s), d) for p, s, d in seen], "path string, seen timestamp, digest string")
    assert rows(changes.settled(df)) == [("a", at(2), "added", "3"), ("a", at(20), "deleted", None), ("a", at(30), "added", "4"), ("c", at(1), "added", "2")]
    assert changes.settled(df.limit(0)).collect() == []


def test_the_stream_equals_a_replay(spark, tmp_path):
    r = random.Random(4)
    seen, clock = [], 0.0
    for n in range(240):
        clock += r.choice((0.3, 0.9, 3.0, 6.0))
        seen.append((f"p{r.randrange(5)}", at(clock), r.choice(("x", "y", "z", None)), f"d{n}"))
    again = [(p, t, d, k) for p, t, d, k in seen[::9]]  # delivered again in the next batch
    folder = tmp_path / "in"
    for n in range(6):
        part = seen[40 * n : 40 * n + 40] + [x for x in again if 40 * (n - 1) <= int(x[3][1:]) < 40 * n and x[1] > seen[40 * n][1] - timedelta(seconds=60)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        # one file a batch, in this order
    spark.createDataFrame([("end", at(clock + 1000), "e", "end")], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    spark.createDataFrame([("end", at(clock + 2000), "f", "end2")], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got, hooks = [], []

    def take(batch):
        got.extend(batch.collect())
        return len(got) % 2 == 0

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    n = changes.follow(stream, take, str(tmp_path / "check"), lambda: hooks.append(1), late="60 seconds")
    wanted = changes.settled(spark.createDataFrame(seen, SCHEMA))
    assert sorted((x.path, x["at"], x.kind, x.digest) for x in got if x.path != "end") == rows(wanted)
    assert {x.kind for x in got} == {"added", "changed", "deleted"} and len(hooks) < n
    # started again it has nothing to say
    assert changes.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder)), take, str(tmp_path / "check"), late="60 seconds") == 0
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert wanted.where(F.col("kind").isNull()).count() == 0
