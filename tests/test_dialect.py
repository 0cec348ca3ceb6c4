"""The front end: tokens, clauses, rejections, and the entry points."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from windrose import StreamContext
from windrose.functions import DelimiterConverter, converter
from windrose.operators.durations import WindowError, literal, span
from windrose.plans.lexer import SyntaxProblem, render, statements, tokens
from windrose.plans.parser import Derived, Insert, Join, Query, Table, parse
from windrose.sinks import DictStore, KafkaSink, KeyValueSink, MemorySink
from windrose.sources import SourceError, kafka_options, open_source

T0 = dt.datetime(1970, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_tokens_keep_strings_comments_and_names():
    assert [t.text for t in tokens("a.b + 'it''s; -- no' -- gone\n, `x y` /* gone */ <=> 1.5e3")] == ["a", ".", "b", "+", "'it''s; -- no'", ",", "`x y`", "<=>", "1.5e3"]
    assert render(tokens("count( * ) , t . x [ 1 ]")) == "count(*), t.x[1]"
    assert statements("a 'x;y'; b -- ; c\n;; d") == ["a 'x;y'", "b -- ; c", "d"]
    with pytest.raises(SyntaxProblem):
        tokens("a \\ b")


def test_window_clause_stands_before_the_alias():
    q = parse("SELECT a FROM t OVER (WINDOW '9' SECONDS, SLIDE 3 SECONDS) AS x JOIN (SELECT b FROM u) OVER (WINDOW '1' MINUTES) y ON x.a = y.b")
    j = q.first.source
    assert isinstance(j, Join) and isinstance(j.left, Table) and isinstance(j.right, Derived)
    assert (j.left.window.width, j.left.window.slide, j.left.alias) == (9000, 3000, "x")
    assert (j.right.window.width, j.right.window.slide, j.right.alias) == (60_000, None, "y")
    assert render(j.on) == "x.a = y.b"


def test_clauses():
    q = parse("WITH c AS (SELECT 1 AS x) SELECT DISTINCT a b, CASE WHEN a THEN 1 END AS d, count(*) n, INTERVAL 1 DAY FROM t WHERE left(a, 1) = 'q' GROUP BY a, f(b, c) HAVING n > 1 ORDER BY a DESC NULLS LAST, b LIMIT 5")
    b = q.first
    assert [i.alias for i in b.items] == ["b", "d", "n", None] and b.distinct and [n for n, _ in q.ctes] == ["c"]
    assert render(b.where) == "left(a, 1) = 'q'" and render(b.group) == "a, f(b, c)" and [o.tail for o in b.order] == ["DESC NULLS LAST", ""] and render(b.limit) == "5"
    i = parse("INSERT OVERWRITE TABLE k SELECT a FROM t")
    assert isinstance(i, Insert) and i.overwrite and i.target == "k"
    assert [op for op, _ in parse("SELECT 1 UNION SELECT 2 INTERSECT SELECT 3 UNION ALL SELECT 4 EXCEPT SELECT 5").rest] == ["union", "intersect", "union all", "except"]


@pytest.mark.parametrize("text", ["SELECT", "SELECT a FROM (SELECT 1)", "INSERT INTO t SELECT 1", "SELECT a FROM t WHERE", "SELECT a FROM t x y"])
def test_unreadable(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_durations():
    assert literal("'9'", "SECONDS") == 9000 and literal("5", "minutes") == 300_000 and span("2 hours") == 7_200_000 and span(5) == 5
    for bad in (("9", "SECOND"), ("'x'", "SECONDS"), ("9", "HOURS")):
        with pytest.raises(WindowError):
            literal(*bad)
    with pytest.raises(WindowError):
        span("soon")


@pytest.fixture
def ctx(spark):
    c = StreamContext(spark, "1 second")
    rows = [(at(0), "a", 1), (at(1), "a", None), (at(1), "b", 3), (at(4), None, 4)]
    c.register_stream(spark.createDataFrame(rows, "ts timestamp_ntz, k string, v int"), "s", "ts")
    c.register_table(spark.createDataFrame([("a", "x"), ("b", "y")], "k string, n string"), "names")
    return c


def answers(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_subqueries_keep_the_time_that_they_do_not_select(ctx):
    want = answers(ctx.sql("SELECT k, COUNT(*) AS c FROM s OVER (WINDOW '2' SECONDS) t GROUP BY k"))
    assert answers(ctx.sql("SELECT t.k, COUNT(*) AS c FROM (SELECT k FROM s) OVER (WINDOW '2' SECONDS) AS t GROUP BY t.k")) == want
    assert answers(ctx.sql("WITH q AS (SELECT k AS g FROM s WHERE v > 0 UNION ALL SELECT k FROM s WHERE v IS NULL) SELECT g AS k, COUNT(*) AS c FROM q OVER (WINDOW '2' SECONDS) t GROUP BY g")) == want
    assert ctx.sql("SELECT k FROM s ORDER BY v LIMIT 1").columns == ["k"] and ctx.sql("SELECT COUNT(*) AS c FROM s").first().c == 4


def test_rejections(ctx, spark):
    for text in (
        "SELECT k FROM s OVER (WINDOW '1500' MILLISECONDS) t",
        "SELECT k FROM s OVER (WINDOW '0' SECONDS) t",
        "SELECT a.k FROM s OVER (WINDOW '4' SECONDS, SLIDE '2' SECONDS) a JOIN s OVER (WINDOW '4' SECONDS, SLIDE '1' SECONDS) b ON a.k = b.k",
        "SELECT k FROM names OVER (WINDOW '4' SECONDS) n",
        "SELECT k FROM s OVER (WINDOW '4' SECONDS) t UNION SELECT k FROM names",
        "SELECT k FROM s OVER (WINDOW '4' SECOND) t",
        "SELECT FROM s OVER (WINDOW '4' SECONDS) t",
        "SELECT k FROM s OVER (WINDOW '4' SECONDS) t UNION SELECT k FROM s OVER (WINDOW '2' SECONDS) u",
    ):
        with pytest.raises(WindowError):
            ctx.sql(text)


def test_nulls_and_empty_groups(ctx):
    got = ctx.sql("SELECT k, COUNT(*) AS c, COUNT(v) AS n, SUM(v) AS s, AVG(v) AS m, MIN(v) AS lo FROM s OVER (WINDOW '1' SECONDS) t GROUP BY k")
    assert answers(got) == sorted(map(repr, [(at(0), at(1), "a", 1, 1, 1, 1.0, 1), (at(1), at(2), "a", 1, 0, None, None, None), (at(1), at(2), "b", 1, 1, 3, 3.0, 3), (at(4), at(5), None, 1, 1, 4, 4.0, 4)]))
    assert len(ctx.sql("SELECT COUNT(*) AS c FROM s OVER (WINDOW '1' SECONDS) t").collect()) == 3  # no row for an empty window


def test_default_slide(spark, ctx):
    c = StreamContext(spark, "1 second", default_slide="batch")
    c.register_stream(ctx.table("s"), "s", "ts")
    assert c.sql("SELECT k FROM s OVER (WINDOW '2' SECONDS) t").count() == 8 and ctx.sql("SELECT k FROM s OVER (WINDOW '2' SECONDS) t").count() == 4


def test_star_hides_the_window(ctx):
    assert ctx.sql("SELECT * FROM s OVER (WINDOW '1' SECONDS) t").columns == ["window_start", "window_end", "ts", "k", "v"]
    assert ctx.sql("SELECT t.*, n.n FROM s OVER (WINDOW '1' SECONDS) t JOIN names n ON t.k = n.k").columns == ["window_start", "window_end", "ts", "k", "v", "n"]


def test_limit_is_per_instant_and_hidden_keys(ctx):
    got = ctx.sql("SELECT k FROM s OVER (WINDOW '1' SECONDS) t ORDER BY v DESC LIMIT 1")
    assert answers(got.select("k")) == sorted(map(repr, [("a",), ("b",), (None,)]))


def test_fallback_to_spark(ctx):
    assert ctx.sql("SHOW TABLES").columns[:2] == ["namespace", "tableName"]
    assert ctx.sql("VALUES (1), (2)").count() == 2


def test_helpers(ctx, spark):
    row = spark.range(1).select(ctx.parse_expression("1 + 2 * 3").alias("a"), ctx.parse_expression("approximate count(distinct id)").over(Window.partitionBy()).alias("b")).first()
    assert tuple(row) == (7, 1)
    assert ctx.parse_table_identifier("db.`a.b`") == ("db", "a.b")
    with pytest.raises(SyntaxProblem):
        ctx.parse_table_identifier("a.")


def test_script(ctx, spark, tmp_path):
    sink = MemorySink()
    ctx.register_sink("out", sink)
    ctx.command("SET spark.app.note = `a;b`; INSERT INTO TABLE out SELECT k, COUNT(*) FROM s OVER (WINDOW '10' SECONDS) t GROUP BY k")
    assert sorted(map(repr, map(tuple, sink.rows))) == sorted(map(repr, [("a", 2), ("b", 1), (None, 1)]))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.txt").write_text("x 1\nbad\ny z 9\n")
    ctx.command(f"CREATE TEMPORARY TABLE msgs (w string, n int) USING text OPTIONS (path '{tmp_path}/in', stream 'false', messageToRow 'space')")
    assert answers(ctx.sql("SELECT * FROM msgs")) == sorted(map(repr, [("x", 1), ("bad", None), ("y", None)]))
    ctx.drop_table("s")
    assert "s" not in ctx.streams


def test_create_stream(ctx):
    from dataclasses import dataclass

    @dataclass
    class P:
        name: str
        n: int

    assert ctx.create_stream([P("a", 1)]).collect()[0]["name"] == "a"
    assert ctx.create_stream([(1,)], "x int").schema.simpleString() == "struct<x:int>"


def test_converters(spark):
    df = spark.createDataFrame([("a", 1, None)], "x string, y int, z double")
    c = DelimiterConverter(".")
    assert df.select(c.to_message(df).alias("m")).first().m == "a.1.null"
    back = spark.createDataFrame([("a.1",), ("a.b.2.5",), (None,)], "value string").select(*c.to_row(F.col("value"), df.schema))
    assert answers(back) == sorted(map(repr, [("a", 1, None), ("a", None, 2.0), (None, None, None)]))
    j = converter("json")
    bad = spark.createDataFrame([('{"x":"q"}',), ("nope",)], "value string").select(*j.to_row(F.col("value"), spark.createDataFrame([], "x string, _corrupt_record string").schema))
    assert answers(bad) == sorted(map(repr, [("q", None), (None, "nope")]))
    with pytest.raises(ValueError):
        converter("unknown")


def test_kafka_options():
    o = kafka_options({"topics": "a:2,b:1", "brokerlist": "h:9", "groupid": "g", "kafkaparams": "x:1,y:2"}, "q7")
    assert o == {"kafka.bootstrap.servers": "h:9", "subscribe": "a,b", "kafka.group.id": "q7", "kafka.x": "1", "kafka.y": "2"}
    with pytest.raises(SourceError):
        kafka_options({"topics": "a"})


def test_sources_need_their_options(spark):
    for provider in ("x.y.SocketTextSource", "socket", "kafka", "text", "json"):
        with pytest.raises(SourceError):
            open_source(spark, provider, None, {})


def test_sink_messages_and_keys(spark):
    df = spark.createDataFrame([("a", 1, None)], "x string, y int, z string")
    assert KafkaSink({"topics": "t:1", "brokerList": "h"}, "comma").messages(df).first().value == "a,1,null"
    store = DictStore()
    KeyValueSink("q", store, 9).write(df.withColumn("window_end", F.lit("1970-01-01 00:01:00").cast("timestamp")), 0)
    assert store.data == {"q.60": {"a.1": "null"}} and store.ttl == {"q.60": 9}
    KeyValueSink("q", store).write(df.select("y"), 1)
    assert [v for k, v in store.data.items() if k != "q.60"] == [{"": "1"}]


rows = st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5))), max_size=25)


@settings(max_examples=12, deadline=None)
@given(rows, st.integers(1, 7), st.integers(1, 7), st.booleans())
def test_windows_against_recomputation(spark, data, w, s, panes):
    w = max(w, s)
    c = StreamContext(spark, "1 second", panes=panes)
    c.register_stream(spark.createDataFrame([(at(t), k, v) for t, k, v in data], "ts timestamp_ntz, k string, v int"), "p", "ts")
    got = c.sql(f"SELECT k, COUNT(*) AS c, SUM(v) AS s, MIN(v) AS lo, MAX(v) AS hi, AVG(v) AS m FROM p OVER (WINDOW '{w}' SECONDS, SLIDE '{s}' SECONDS) t GROUP BY k")
    want = []
    for end in range(-s * 2, 60 + w):
        if (end - w) % s:
            continue
        for k in ("a", "b", None):
            vs = [v for t, g, v in data if g == k and end - w <= t < end]
            known = [v for v in vs if v is not None]
            if vs:
                want.append((at(end - w), at(end), k, len(vs), *((sum(known), min(known), max(known), sum(known) / len(known)) if known else (None,) * 4)))
    assert answers(got) == sorted(map(repr, want))


def test_panes_plan_copies_groups_not_rows(ctx):
    plan = ctx.sql("SELECT k, COUNT(*) AS c FROM s OVER (WINDOW '60' SECONDS, SLIDE '1' SECONDS) t GROUP BY k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate") if "Expand" in plan else plan.count("Aggregate") == 2


def test_random_texts_never_crash_the_lexer():
    r = random.Random(7)
    for _ in range(300):
        text = "".join(r.choice("ab1.'\"`(),;*-/ \n=<>") for _ in range(r.randrange(30)))
        try:
            statements(text)
            parse(text)
        except (SyntaxProblem, WindowError):
            pass
    assert isinstance(parse("SELECT 1"), Query)


def test_averages_of_large_numbers_by_panes(spark):
    c = StreamContext(spark)
    c.register_stream(spark.createDataFrame([(at(k), 2**62) for k in range(6)], "ts timestamp_ntz, v long"), "big", "ts")
    got = c.sql("SELECT AVG(v) AS m FROM big OVER (WINDOW '4' SECONDS, SLIDE '2' SECONDS) t")
    assert {r.m for r in got.collect()} == {2.0**62}


def test_tables_of_spark_itself(spark):
    c = StreamContext(spark)
    c.command("DROP TABLE IF EXISTS own_t; CREATE TABLE own_t (a int) USING parquet; INSERT INTO own_t SELECT 3 AS a")
    assert [r.a for r in c.sql("SELECT a FROM own_t").collect()] == [3]
    c.command("DROP TABLE own_t")


def test_tab_converter():
    assert converter("tab").delimiter == "\t" and converter("org.x.TabConverter").delimiter == "\t"
