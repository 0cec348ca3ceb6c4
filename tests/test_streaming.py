"""Queries as streams: the sample tables replayed, and stream against batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from windrose import StreamContext
from windrose.operators.durations import WindowError
from windrose.sinks import KeyValueSink, MemorySink, ParquetStore
from windrose.sources import replay

T0 = dt.datetime(1970, 1, 1)
REG = [(1, 1235, "math", 80), (1, 1235, "english", 60), (2, 1236, "math", 70), (2, 1236, "english", 80)]
STU = [(1234, "mike", 20), (1235, "jack", 30), (1236, "lucy", 20), (1237, "ann", 30)]
JOIN = """SELECT AVG(r.score) AS score, s.name AS student, t.name AS teacher
    FROM registration OVER (WINDOW '2000' MILLISECONDS, SLIDE '1000' MILLISECONDS) AS r
    JOIN student OVER (WINDOW '2000' MILLISECONDS, SLIDE '1000' MILLISECONDS) AS s ON s.id = r.studentId JOIN teacher t ON t.id = r.teacherId
    GROUP BY t.name, s.name, r.score"""
#: By batch: the rows of windows of two batches.
WANT = {1: [(60.0, "jack", "bing"), (80.0, "jack", "bing")], 2: [(60.0, "jack", "bing"), (70.0, "lucy", "google")], 3: [(70.0, "lucy", "google"), (80.0, "lucy", "google")]}
BATCHES = 8


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def tables(spark, n=BATCHES, last=True):
    reg = [(at(b), *REG[b % 4]) for b in range(n)]
    stu = [(at(b), *STU[b % 4]) for b in range(n)]
    r = spark.createDataFrame(reg, "ts timestamp, teacherId int, studentId int, className string, score int")
    s = spark.createDataFrame(stu, "ts timestamp, id int, name string, age int")
    end = (spark.createDataFrame([(at(10_000), -1, -1, "", 0)], r.schema), spark.createDataFrame([(at(10_000), -2, "", 0)], s.schema))
    return r, s, end


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each has its own state files in each batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def context(spark, folder=None, parts=BATCHES):
    c = StreamContext(spark, "1 second")
    r, s, (re, se) = tables(spark)
    if folder:
        r = replay(spark, r, f"{folder}/r", parts, "ts", re)
        s = replay(spark, s, f"{folder}/s", parts, "ts", se)
    c.register_stream(r, "registration", "ts")
    c.register_stream(s, "student", "ts")
    c.register_stream(tables(spark)[1], "past", "ts")
    c.register_table(spark.createDataFrame([(1, "bing"), (2, "google")], "id int, name string"), "teacher")
    return c


def by_batch(rows):
    out = {}
    for r in rows:
        b = int((r["window_end"] - T0).total_seconds()) - 1
        out.setdefault(b, []).append((r["score"], r["student"], r["teacher"]))
    return {b: sorted(x) for b, x in out.items() if b < BATCHES}


EXPECTED = {b: WANT[b % 4] for b in range(BATCHES) if b % 4 in WANT}


def test_windowed_join_as_batch(spark):
    got = by_batch(context(spark).sql(JOIN).collect())
    got = {b: x for b, x in got.items() if b not in (BATCHES,)}
    assert got == EXPECTED


@pytest.mark.parametrize("fallback", [False, True])
def test_windowed_join_as_stream(spark, tmp_path, fallback):
    c = context(spark, str(tmp_path))
    sink = MemorySink()
    q = c.sql(JOIN)
    assert q.mode == "native"
    if fallback:
        q.mode = "windows"
    q.start(sink, trigger={"availableNow": True}, checkpoint=str(tmp_path / "c")).awaitTermination()
    assert by_batch(sink.rows) == EXPECTED


def test_stream_and_table_by_batches(spark, tmp_path):
    c = context(spark, str(tmp_path))
    sink = MemorySink()
    q = c.sql("SELECT r.className AS c, t.name AS n FROM registration r JOIN teacher t ON r.teacherId = t.id")
    assert q.mode == "batches"
    q.start(sink, trigger={"availableNow": True}, checkpoint=str(tmp_path / "c")).awaitTermination()
    assert [tuple(r) for r in sink.rows] == [("math", "bing"), ("english", "bing"), ("math", "google"), ("english", "google")] * 2


def test_unwindowed_streams_meet_in_a_batch_interval(spark, tmp_path):
    c = context(spark, str(tmp_path))
    sink = MemorySink()
    q = c.sql("SELECT r.className AS c, s.name AS n FROM registration r JOIN student s ON r.studentId = s.id")
    q.start(sink, trigger={"availableNow": True}, checkpoint=str(tmp_path / "c")).awaitTermination()
    assert sorted((r.c, r.n) for r in sink.rows) == sorted([("english", "jack"), ("math", "lucy")] * 2)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT className, COUNT(*) AS n, SUM(score) AS s FROM registration OVER (WINDOW '4' SECONDS, SLIDE '2' SECONDS) r GROUP BY className",
        "SELECT className, score FROM registration OVER (WINDOW '4' SECONDS, SLIDE '2' SECONDS) r ORDER BY score DESC, className LIMIT 2",
        "SELECT studentId AS i FROM registration OVER (WINDOW '4' SECONDS) r INTERSECT SELECT id AS i FROM student OVER (WINDOW '4' SECONDS) s",
        "SELECT studentId AS i FROM registration OVER (WINDOW '4' SECONDS) r EXCEPT SELECT id AS i FROM student OVER (WINDOW '4' SECONDS) s WHERE id > 1235",
        "SELECT r.className, s.name FROM registration OVER (WINDOW '4' SECONDS, SLIDE '2' SECONDS) r LEFT JOIN student OVER (WINDOW '2' SECONDS) s ON r.studentId = s.id",
        "SELECT COUNT(DISTINCT studentId) AS u FROM registration OVER (WINDOW '4' SECONDS, SLIDE '2' SECONDS) r",
        "SELECT MAX(q.n) AS most FROM (SELECT className, COUNT(*) AS n FROM registration OVER (WINDOW '4' SECONDS) r GROUP BY className) AS q",
        "SELECT DISTINCT className FROM registration OVER (WINDOW '4' SECONDS) r",
        "SELECT t.name, s.name AS student FROM teacher t LEFT JOIN student OVER (WINDOW '2' SECONDS) s ON t.id = s.id - 1234",
        "SELECT className, RANK() OVER (ORDER BY score) AS k FROM registration OVER (WINDOW '4' SECONDS) r",
        "SELECT className, COUNT(DISTINCT studentId) AS u, SUM(score) AS s FROM registration OVER (WINDOW '2' SECONDS) r GROUP BY className",
        "SELECT AVG(score) AS m, COUNT(DISTINCT className, studentId) AS u FROM registration OVER (WINDOW '6' SECONDS, SLIDE '4' SECONDS) r",
        "SELECT className, COUNT(*) AS n FROM registration OVER (WINDOW '2' SECONDS, SLIDE '4' SECONDS) r GROUP BY className",
        "SELECT className FROM registration OVER (WINDOW '2' SECONDS, SLIDE '4' SECONDS) r ORDER BY score LIMIT 1",
        "SELECT r.className, p.name FROM registration OVER (WINDOW '4' SECONDS) r JOIN past p ON r.studentId = p.id ORDER BY p.name, r.score LIMIT 2",
        "SELECT r.className, p.name FROM registration OVER (WINDOW '4' SECONDS, SLIDE '2' SECONDS) r LEFT JOIN past OVER (WINDOW '2' SECONDS) p ON r.studentId = p.id ORDER BY r.score LIMIT 2",
        "SELECT className FROM registration OVER (WINDOW '4' SECONDS) r ORDER BY score DESC LIMIT 2",
    ],
)
def test_stream_equals_batch(spark, tmp_path, text):
    want = sorted(repr(tuple(r)) for r in context(spark).sql(text).collect())
    sink = MemorySink()
    q = context(spark, str(tmp_path), 2).sql(text)
    assert q.schema is not None
    q.start(sink, trigger={"availableNow": True}, checkpoint=str(tmp_path / "c")).awaitTermination()
    got = sorted(repr(tuple(r)) for r in sink.rows if r["window_end"] is not None and r["window_end"] < at(5000))
    assert got == [w for w in want if "None, None" not in w[:12]]


def test_modes(spark, tmp_path):
    """What runs by itself, and what must not be started: a stream without an end for its rows."""
    c = context(spark, str(tmp_path), 1)
    for text in ("COUNT(DISTINCT studentId) AS u", "className, AVG(score) AS m"):
        q = c.sql(f"SELECT {text} FROM registration OVER (WINDOW '4' SECONDS, SLIDE '1' SECONDS) r" + " GROUP BY className" * ("className" in text))
        assert q.mode == "native"
        plan = q.plan._jdf.queryExecution().analyzed().toString()
        assert plan.count("Aggregate [") == 2 + ("DISTINCT" in text)  # by pane before rows are copied to windows
    with pytest.raises(WindowError):
        c.sql("SELECT r.className FROM registration OVER (WINDOW '4' SECONDS) r JOIN student s ON r.studentId = s.id ORDER BY r.score LIMIT 1")
    free = StreamContext(spark)
    free.streams = c.streams
    for s in free.streams.values():
        s.batch = None
    with pytest.raises(WindowError):
        free.sql("SELECT r.className FROM registration r JOIN student s ON r.studentId = s.id ORDER BY r.score LIMIT 1")


def test_default_slide_of_streams(spark, tmp_path):
    text = "SELECT className, COUNT(*) AS n FROM registration OVER (WINDOW '2' SECONDS) r GROUP BY className"
    want, got = (context(spark, f, 2) for f in (None, str(tmp_path)))
    want.default_slide = got.default_slide = "batch"
    sink = MemorySink()
    got.sql(text).start(sink, trigger={"availableNow": True}, checkpoint=str(tmp_path / "c")).awaitTermination()
    rows = sorted(map(repr, map(tuple, want.sql(text).collect())))
    assert sorted(repr(tuple(r)) for r in sink.rows if r.window_end < at(5000)) == rows


def test_unwindowed_streams_in_order(spark, tmp_path):
    text = "SELECT r.className AS c, s.name AS n FROM registration r JOIN student s ON r.studentId = s.id ORDER BY s.age LIMIT 1"
    sink = MemorySink()
    context(spark, str(tmp_path)).sql(text).start(sink, trigger={"availableNow": True}, checkpoint=str(tmp_path / "c")).awaitTermination()
    assert sorted((r.c, r.n) for r in sink.rows) == sorted([("english", "jack"), ("math", "lucy")] * 2)


def test_an_insert_keeps_columns_named_like_bounds(spark, tmp_path):
    c, sink = context(spark), MemorySink()
    c.register_sink("k", sink)
    c.sql("INSERT INTO TABLE k SELECT className, score AS window_end FROM registration WHERE score > 70")
    assert sorted(map(tuple, sink.rows)) == [("english", 80)] * 2 + [("math", 80)] * 2
    c.sql("INSERT INTO TABLE k SELECT COUNT(*) AS n FROM registration OVER (WINDOW '4' SECONDS) r")
    assert sink.schema.names == ["n"] and [r.n for r in sink.rows] == [4, 4]


def test_no_views_are_left(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    c = context(spark)
    for k in range(3):
        c.sql(JOIN).collect()
    assert {t.name for t in spark.catalog.listTables()} - before <= {"registration", "student", "teacher", "past"}


def test_insert_from_a_stream(spark, tmp_path):
    c = context(spark, str(tmp_path))
    sink = MemorySink()
    c.register_sink("k", sink)
    c.sql("INSERT INTO TABLE k SELECT className FROM registration WHERE score > 70").processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert sorted(r.className for r in sink.rows) == ["english", "english", "math", "math"]


def test_key_value_sink_of_a_stream(spark, tmp_path):
    c = context(spark, str(tmp_path))
    q = c.sql("SELECT className, COUNT(*) AS n FROM registration OVER (WINDOW '4' SECONDS) r GROUP BY className")
    q.start(KeyValueSink("q9", ParquetStore(str(tmp_path / "kv"))), trigger={"availableNow": True}, checkpoint=str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "kv")).filter(F.col("field") != "")
    assert sorted((r.key, r.field, r.value) for r in got.collect()) == [("q9.4", "english", "2"), ("q9.4", "math", "2"), ("q9.8", "english", "2"), ("q9.8", "math", "2")]
