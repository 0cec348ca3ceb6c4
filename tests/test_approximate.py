"""Approximate distinct counts: how near they are, by which plan, and as streams."""

import pytest
from pyspark.sql import functions as F

from windrose import StreamContext
from windrose.sinks import MemorySink
from windrose.sources import replay


def rows(spark, windows, values):
    """Each value in each window of an hour, twice, but for one null."""
    df = spark.range(windows * values * 2).withColumn("w", (F.col("id") / (2 * values)).cast("int"))
    df = df.select(F.timestamp_seconds(F.col("w") * 3600 + F.col("id") % 3600).alias("ts"), F.when(F.col("id") % (2 * values) > 0, F.col("id") % values + F.col("w") * 100_003).alias("u"))
    return df.withColumns({"s": F.col("u").cast("string"), "d": F.when(F.col("u") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0))})


def context(spark, df):
    c = StreamContext(spark)
    c.register_stream(df, "e", "ts")
    return c


@pytest.mark.parametrize("over", ["WINDOW '60' MINUTES", "WINDOW '120' MINUTES, SLIDE '60' MINUTES"])
def test_three_deviations_hold_in_every_group(spark, over):
    c = context(spark, rows(spark, 1500, 500))
    got = c.sql(f"SELECT ABS((APPROXIMATE COUNT(DISTINCT u)) - COUNT(DISTINCT u)) <= 0.15 * COUNT(DISTINCT u) AS near FROM e OVER ({over}) t")
    assert [tuple(r) for r in got.groupBy("near").count().collect()] == [(True, 1500 + ("SLIDE" in over))]


def test_no_sketch_for_each_value(spark):
    """Beside an exact count Spark's own sketch would be held for each distinct value of each group."""
    for over in ("WINDOW '60' MINUTES", "WINDOW '120' MINUTES, SLIDE '60' MINUTES"):
        got = context(spark, rows(spark, 2, 10)).sql(f"SELECT ABS((APPROXIMATE(0.01) COUNT(DISTINCT u)) - COUNT(DISTINCT u)) AS off, COUNT(*) AS n FROM e OVER ({over}) t")
        assert "approx_count_distinct" not in got._jdf.queryExecution().analyzed().toString()
        assert {r.off for r in got.collect()} == {0}


@pytest.mark.parametrize("n", [1, 2, 30, 1000, 20_000, 200_000])
@pytest.mark.parametrize("rsd", [0.1, 0.01])
def test_small_and_large_counts(spark, n, rsd):
    for with_exact in ("", ", COUNT(DISTINCT s) AS x"):
        got = context(spark, rows(spark, 1, n)).sql(f"SELECT APPROXIMATE({rsd}) COUNT(DISTINCT s) AS a, COUNT(*) AS c{with_exact} FROM e OVER (WINDOW '60' MINUTES) t").first()
        assert abs(got.a - n) <= 2 * rsd * n and got.c == 2 * n


def test_nulls_zeros_and_other_aggregates(spark):
    c = context(spark, rows(spark, 3, 40))
    got = c.sql("SELECT APPROXIMATE COUNT(DISTINCT d) AS zeros, APPROXIMATE COUNT(DISTINCT d) + COUNT(DISTINCT d) AS two, COUNT(u) * 10 + 1 AS n FROM e OVER (WINDOW '60' MINUTES) t")
    assert [tuple(r)[2:] for r in got.collect()] == [(1, 2, 791)] * 3
    none = c.sql("SELECT APPROXIMATE COUNT(DISTINCT u) AS a, COUNT(DISTINCT u) AS x FROM e OVER (WINDOW '60' MINUTES) t WHERE u IS NULL")
    assert [tuple(r)[2:] for r in none.collect()] == [(0, 0)] * 3


def test_items_that_panes_do_not_know(spark):
    """These keep Spark's own plan."""
    c = context(spark, rows(spark, 2, 50))
    for item in ("MAX(u) OVER (ORDER BY u) AS x", "COUNT(*) FILTER (WHERE u > 5) + COUNT(*) AS x", "COUNT(*) + percentile(u, 0.5) AS x", "(COUNT(*) + any_value(1)) AS x"):
        assert c.sql(f"SELECT {item} FROM e OVER (WINDOW '120' MINUTES, SLIDE '60' MINUTES) t").count() >= 3


@pytest.mark.parametrize("items", ["APPROXIMATE COUNT(DISTINCT u) AS a", "APPROXIMATE COUNT(DISTINCT u) - COUNT(DISTINCT u) AS off, SUM(DISTINCT u) AS s, COUNT(*) AS n"])
@pytest.mark.parametrize("over", ["WINDOW '60' MINUTES", "WINDOW '120' MINUTES, SLIDE '60' MINUTES"])
def test_as_stream(spark, tmp_path, items, over):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    df = rows(spark, 4, 30)
    text = f"SELECT {items} FROM e OVER ({over}) t"
    want = sorted(map(tuple, context(spark, df).sql(text).collect()))
    last = df.limit(1).withColumn("ts", F.lit("2100-01-01 00:00:00").cast("timestamp"))
    q = context(spark, replay(spark, df, str(tmp_path / "r"), 2, "ts", last)).sql(text)
    assert q.mode == "native"
    sink = MemorySink()
    q.start(sink, trigger={"availableNow": True}, checkpoint=str(tmp_path / "c")).awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(tuple(r) for r in sink.rows if r.window_end.year < 2090) == want


def test_copies_for_windows_never_move(spark):
    """What is shuffled grows with (group, value) rows, not with the windows that hold them."""
    got = context(spark, rows(spark, 3, 2000)).sql("SELECT ABS((APPROXIMATE(0.01) COUNT(DISTINCT u)) - COUNT(DISTINCT u)) <= 60 AS near FROM e OVER (WINDOW '480' MINUTES, SLIDE '60' MINUTES) t")
    assert {r.near for r in got.collect()} == {True}
    todo, written = [got._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        todo += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
        if p.nodeName() == "Exchange":
            written.append(p.metrics().apply("shuffleRecordsWritten").value())
    assert len(written) > 1 and max(written) <= 2 * 12_000  # 8 windows hold each row; beside a block's end it has two masks


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("width, slide", [(540, 360), (180, 60), (4320, 1440), (6000, 60), (61, 60)])
def test_sliding_distinct_values_against_rows_in_windows(spark, zone, kind, width, slide):
    """Over a change of clocks and 1970, with nulls, in many blocks of windows."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = F.timestamp_seconds(F.when(F.col("id") % 2 == 0, F.lit(1710039600)).otherwise(F.lit(-90_000)) + F.col("id") * 7919 % 200_000)
        df = spark.range(400).select(at.cast(kind).alias("ts"), F.when(F.col("id") % 9 > 0, F.col("id") % 23).alias("u"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("g"))
        over = f"OVER (WINDOW '{width}' MINUTES, SLIDE '{slide}' MINUTES) t"
        got = context(spark, df).sql(f"SELECT g, COUNT(DISTINCT u) AS c, SUM(DISTINCT u) AS s, APPROXIMATE COUNT(DISTINCT u) AS a FROM e {over} GROUP BY g")
        many = context(spark, df).sql(f"SELECT COUNT(DISTINCT u, g) AS c FROM e {over}")
        want = df.groupBy(F.window("ts", f"{width} minutes", f"{slide} minutes").alias("w"), "g").agg(F.countDistinct("u").alias("c"), F.sum_distinct("u").alias("s")).select("w.start", "w.end", "g", "c", "s", "c")
        pairs = df.groupBy(F.window("ts", f"{width} minutes", f"{slide} minutes").alias("w")).agg(F.countDistinct("u", "g").alias("c")).select("w.*", "c")
        for a, b in ((got, want), (many, pairs)):
            assert [t for _, t in a.dtypes] == [t for _, t in b.dtypes]
            mine = sorted(map(str, map(tuple, a.collect())))
            spark.conf.set("spark.sql.codegen.wholeStage", "false")  # Spark's code for 100 windows a row doesn't run
            assert mine == sorted(map(str, map(tuple, b.collect())))
            spark.conf.unset("spark.sql.codegen.wholeStage")
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
