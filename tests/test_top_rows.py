"""First rows of windows from those of panes, and what streams gather for them."""

import pytest
from pyspark.sql import functions as F

from windrose import StreamContext
from windrose.sinks import MemorySink
from windrose.sources import replay

OVER = "e OVER (WINDOW '180' MINUTES, SLIDE '60' MINUTES) t"
TEXTS = [
    f"SELECT t.id, o.k FROM {OVER} JOIN o ON t.u = o.u ORDER BY o.price DESC, o.k, t.id LIMIT 3",
    f"SELECT t.id, o.price FROM {OVER} LEFT JOIN o ON t.u = o.u AND o.price > 5 WHERE t.id % 3 > 0 ORDER BY price NULLS LAST, t.u DESC, id, o.k LIMIT 4",
    f"SELECT o.k, t.id AS x FROM o JOIN {OVER} ON t.u = o.u ORDER BY x DESC, o.k LIMIT 2",
]


def context(spark, folder=None, **kw):
    c = StreamContext(spark, **kw)
    e = spark.range(200).select("id", F.timestamp_seconds(F.col("id") * 433 % 40_000).alias("ts"), (F.col("id") % 7).alias("u"), F.lit("x").alias("unused"))
    last = e.limit(1).withColumn("ts", F.lit("2100-01-01 00:00:00").cast("timestamp"))
    c.register_stream(replay(spark, e.repartition(1), folder, 2, "ts", last) if folder else e, "e", "ts")
    c.register_table(spark.range(20).select((F.col("id") % 6).alias("u"), F.col("id").alias("k"), (F.col("id") * 5 % 11).alias("price")), "o")
    return c


@pytest.mark.parametrize("text", TEXTS)
def test_by_panes_as_by_windows(spark, text):
    want, got = (sorted(map(tuple, context(spark, panes=panes).sql(text).collect()), key=repr) for panes in (False, True))
    assert got == want and len(got) > 20


def test_rows_are_joined_before_they_are_copied(spark):
    plan = context(spark).sql(TEXTS[0])._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Expand") < plan.find("Join Inner")


@pytest.mark.parametrize("text", TEXTS)
def test_as_stream(spark, tmp_path, text):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    want = sorted(map(tuple, context(spark).sql(text).collect()), key=repr)
    q, sink = context(spark, str(tmp_path / "r")).sql(text), MemorySink()
    assert q.mode == "windows"
    q.start(sink, trigger={"availableNow": True}, checkpoint=str(tmp_path / "c")).awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((tuple(r) for r in sink.rows if r.window_end.year < 2090), key=repr) == want


def test_only_named_columns_are_gathered(spark, tmp_path):
    c = context(spark, str(tmp_path / "r"))
    fields = lambda text: set(c.sql(text)._windows(None)[0].schema["rows"].dataType.elementType["r0"].dataType.names)
    assert fields(TEXTS[0]) == {"id", "u", "ts"}
    assert fields(f"SELECT COUNT(*) OVER (ORDER BY `id`) AS n FROM {OVER}") == {"id", "ts"}
    for item in ("*", "t.*", "id, *", "to_json(struct(*)) AS j"):
        assert fields(f"SELECT {item} FROM {OVER} ORDER BY id LIMIT 1") == {"id", "u", "ts", "unused"}


def test_parts_are_written_by_several_tasks(spark, tmp_path):
    df = spark.range(0, 1000, 1, 3).select("id", F.when(F.col("id") < 990, F.lit(1)).otherwise(F.col("id")).alias("ts"))
    stream, seen = replay(spark, df, str(tmp_path / "r"), 3, "ts", df.limit(1)), []
    assert len(list((tmp_path / "r").glob("*.parquet"))) == 3 * 3 + 1
    stream.writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(seen) == 1001 and seen[3] == 1
