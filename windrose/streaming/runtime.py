"""Queries over streams: natively where Structured Streaming allows the plan, else window by window.

native: the lifted plan itself runs as a stream, in append mode: a window's rows come when the watermark has
passed it. Aggregations run by panes, and distinct ones in steps, wherever panes can express them.
windows: for what streams can't do (ORDER BY, LIMIT, INTERSECT, EXCEPT, row windows, ...): the windowed inputs are
gathered by instant and bucket in the state store, and each closed instant is answered by the batch plan. Bounded
inputs take part as they are; a windowed one in the instants at which a stream has rows.
batches: a query without windows over one stream is answered for each micro-batch.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import fields, is_dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from windrose.operators.durations import WindowError, spelled
from windrose.operators.windowing import WIN, assign, before
from windrose.plans.lexer import Token
from windrose.plans.lift import Lifted, Lifter, Stream, visible
from windrose.plans.parser import Query


def allowed(df: DataFrame) -> str | None:
    """None if Spark would run the plan as a stream in append mode, else why it wouldn't."""
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.streaming.OutputMode.Append()
    try:
        jvm.org.apache.spark.sql.catalyst.analysis.UnsupportedOperationChecker.checkForStreaming(df._jdf.queryExecution().analyzed(), mode)
    except Exception as e:  # an AnalysisException of the JVM
        return str(e).splitlines()[0]
    return None


class _Gathering(Lifter):
    """Notes each windowed relation of a live stream in the order met and goes on with an empty table in its place."""

    def __init__(self, *a, **k):
        super().__init__(*a, panes=False, **k)
        self.inputs: list[tuple[DataFrame, str, int, int]] = []

    def assigned(self, rel: Lifted, width: int, slide: int) -> Lifted:
        s = rel.stream
        if not s.live:
            return super().assigned(rel, width, slide)
        self.inputs.append((rel.df, s.ts, width, slide))
        return super().assigned(replace(rel, df=self.spark.createDataFrame([], rel.df.schema)), width, slide)


class _Answering(Lifter):
    """The n-th windowed relation of a live stream is the n-th of the given tables; ends: their instants, between first
    and last (microseconds; None: there are none). A single table, of windows of the given slide, is given by panes, too."""

    def __init__(self, *a, tables: list[DataFrame], ends: DataFrame, slide: int, first: int | None, last: int | None, **k):
        super().__init__(*a, panes=False, **k)
        self.tops = len(tables) == 1 and first is not None
        self.tables, self.ends, self.slide, self.first, self.last = itertools.cycle(tables), ends, slide, *(F.timestamp_micros(F.lit(x).cast("bigint")) for x in (first, last))

    def assigned(self, rel: Lifted, width: int, slide: int) -> Lifted:
        if rel.stream.live:
            df = next(self.tables)
            if self.tops and width == self.slide:
                # Of a row's copies the one of its pane's own end or, if that was answered before, the first one.
                pane = F.window(F.col(f"`{rel.stream.ts}`"), spelled(slide)).alias("__pane")
                df = df.select("*", pane).filter(F.col(f"{WIN}.end") == F.greatest("__pane.end", self.first)).drop(WIN).withColumnRenamed("__pane", WIN)
            return Lifted(df, [c for c in df.columns if c != WIN], WIN, width, slide, replace(rel.stream, df=df))
        done = super().assigned(rel, width, slide)
        at = self.ends.select(F.col("end").cast(done.df.schema[WIN].dataType["end"].dataType).alias("__end"))
        return replace(done, df=done.df.join(F.broadcast(at), done.df[WIN]["end"] == at["__end"], "left_semi"))

    def closed(self, df: DataFrame, win: str) -> DataFrame:
        return df.filter(F.col(f"{win}.end").between(self.first, self.last))


class ContinuousQuery:
    """A query over at least one stream; ``start`` runs it.

    show: what of a result goes to sinks, by default all that users see.
    """

    def __init__(self, spark: SparkSession, ast: Query, resolve: Callable[[str], Stream | DataFrame], *, delay: int, batch: int | None, windowed: bool, streams: int,
                 default_slide: str = "tumble", panes: bool = True, show: Callable[[Lifted], DataFrame] = visible):
        self.spark, self.ast, self.resolve, self.delay, self.batch, self.show = spark, ast, resolve, delay, batch, show
        self.slides = {"default_slide": default_slide}
        self.lifting = self.slides | {"unwindowed": batch or "table"}
        self.why: str | None = None
        if not windowed and streams < 2:
            self.mode = "batches"
            return
        for by_panes in (True, False) if panes else (False,):
            try:
                self.plan = show(Lifter(spark, self._watermarked, panes=by_panes, **self.lifting).query(ast))
                self.why = allowed(self.plan)
            except Exception as e:
                self.why = str(e).splitlines()[0]
            if self.why is None:
                break
        if self.why is not None:
            self._gather()  # a query that can't be lifted at all fails here
        self.mode = "native" if self.why is None else "windows"

    def _gather(self) -> _Gathering:
        gather = _Gathering(self.spark, self._timed, **self.lifting)
        if gather.query(self.ast).df.isStreaming or not gather.inputs:  # a stream is left that no window closes
            raise WindowError(f"each stream of the query needs a window, or joined ones a batch interval: {self.why}")
        if len({slide for *_, slide in gather.inputs}) > 1:
            raise WindowError("the streams of a query that is answered window by window must share their slide")
        return gather

    def _timed(self, name: str) -> Stream | DataFrame:
        s = self.resolve(name)
        if isinstance(s, Stream) and dict(s.df.dtypes)[s.ts] != "timestamp":
            return replace(s, df=s.df.withColumn(s.ts, F.col(f"`{s.ts}`").cast("timestamp")))
        return s

    def _watermarked(self, name: str) -> Stream | DataFrame:
        s = self._timed(name)
        if isinstance(s, Stream) and s.df.isStreaming:
            return replace(s, df=s.df.withWatermark(s.ts, spelled(self.delay)))
        return s

    def _emptied(self, name: str) -> Stream | DataFrame:
        """For schemas: a stream as an empty table."""
        s = self._timed(name)
        return replace(s, df=self.spark.createDataFrame([], s.df.schema)) if isinstance(s, Stream) else s

    def _shape(self) -> DataFrame:
        return self.plan if self.mode == "native" else self.show(Lifter(self.spark, self._emptied, **self.lifting).query(self.ast))

    @property
    def schema(self):
        return self._shape().schema

    def explain(self, extended: bool = False) -> None:
        self._shape().explain("extended" if extended else "formatted")

    def start(self, sink, *, name: str | None = None, checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
        """sink: its write(df, batch_id) gets every batch of results."""
        df, each = {"native": self._native, "windows": self._windows, "batches": self._batches}[self.mode](sink)
        out = df.writeStream.outputMode("append").foreachBatch(each)
        out = out.queryName(name) if name else out
        out = out.option("checkpointLocation", checkpoint) if checkpoint else out
        return (out.trigger(**trigger) if trigger else out).start()

    def _native(self, sink):
        return self.plan, sink.write

    def _batches(self, sink):
        found: list[tuple[str, Stream]] = []

        def note(name: str):
            s = self.resolve(name)
            if isinstance(s, Stream) and s.df.isStreaming:
                found.append((name, s))
                return replace(s, df=self.spark.createDataFrame([], s.df.schema))
            return s

        Lifter(self.spark, note, **self.slides).query(self.ast)
        name, s = found[0]

        def each(batch: DataFrame, n: int) -> None:
            def resolve(t: str) -> Stream | DataFrame:
                return replace(s, df=batch) if t.strip("`").lower() == name.strip("`").lower() else _there(t, self.resolve(t), batch.sparkSession)

            sink.write(self.show(Lifter(batch.sparkSession, resolve, **self.slides).query(self.ast)), n)

        return s.df, each

    def _windows(self, sink):
        inputs = self._gather().inputs
        said = _words(self.ast)
        # What the text doesn't name isn't gathered; the time always is.
        kept = [[c for c in df.columns if said is None or c == ts or c.lower() in said] for df, ts, *_ in inputs]
        # A row of one input is a struct with that input's field set.
        kinds = [F.lit(None).cast(df.select(*[f"`{c}`" for c in kept[k]]).schema).alias(f"r{k}") for k, (df, *_) in enumerate(inputs)]
        parts = []
        for k, (df, ts, width, slide) in enumerate(inputs):
            wide = assign(df, ts, max(width, slide), slide)
            # The instant is the event time here. It lies up to a width ahead of the row's time, so it may lag as much more.
            at = (F.col(f"{WIN}.end") - F.expr("INTERVAL 1 MILLISECOND")).alias("__at")
            own = F.struct(*[F.col(f"`{c}`") for c in kept[k]]).alias(f"r{k}")
            one = F.struct(F.lit(k).alias("tag"), *kinds[:k], own, *kinds[k + 1 :])
            part = wide.select(one.alias("row"), at, F.col(f"`{ts}`").alias("__ts")).withWatermark("__at", spelled(self.delay + max(width, slide)))
            # Rows between sampled windows tell the time, too, so they go only now.
            part = part.filter(F.col("__ts") >= before(F.col("__at") + F.expr("INTERVAL 1 MILLISECOND"), width)) if slide > width else part
            parts.append(part.drop("__ts"))
        slide = inputs[0][3]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        # An instant's rows are gathered in several buckets, so that no group and no task has all of them.
        tops = slide if inputs[0][2] > slide else 0
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        bucket = (F.rand(17) * buckets).cast("int").alias("bucket")
        gathered = union.withColumn("bucket", bucket).groupBy(F.window("__at", spelled(slide)).alias("w"), "bucket").agg(F.collect_list("row").alias("rows"))

        def each(batch: DataFrame, n: int) -> None:
            spark = batch.sparkSession
            batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # each input reads it
            try:
                rows = batch.select(F.col("w.end").alias("end"), F.explode("rows").alias("x"))
                tables = []
                for k, (_, _, width, slide) in enumerate(inputs):
                    win = F.struct(before(F.col("end"), max(width, slide)).alias("start"), F.col("end").alias("end"))
                    tables.append(rows.filter(F.col("x.tag") == k).select(F.col(f"x.r{k}").alias("r"), win.alias(WIN)).select("r.*", WIN))

                def resolve(name: str) -> Stream | DataFrame:
                    s = self._timed(name)
                    if isinstance(s, Stream) and s.live:
                        return replace(s, df=spark.createDataFrame([], s.df.schema))
                    return _there(name, s, spark)

                ends = batch.select("w.end").distinct()
                first, last = ends.agg(F.unix_micros(F.min("end")), F.unix_micros(F.max("end"))).first()
                sink.write(self.show(_Answering(spark, resolve, tables=tables, ends=ends, slide=tops, first=first, last=last, **self.lifting).query(self.ast)), n)
            finally:
                batch.unpersist()

        return gathered, each


def _there(name: str, s: Stream | DataFrame, spark: SparkSession) -> Stream | DataFrame:
    """A table or bounded stream in the session of a batch, which has the names of the query's session."""
    df = spark.table(name)
    return replace(s, df=df.withColumn(s.ts, F.col(f"`{s.ts}`").cast(s.df.schema[s.ts].dataType))) if isinstance(s, Stream) else df


def _words(x: object) -> set[str] | None:
    """All names in a query, in lower case; None: it has a star, other than in COUNT(*), and so any column."""
    if isinstance(x, list) and x and all(isinstance(t, Token) for t in x):
        for k, t in enumerate(x):
            counted = [y.upper for y in x[max(k - 2, 0) : k]] == ["COUNT", "("]
            if t.text == "*" and not counted and (k == 0 or x[k - 1].text in ("(", ",", ".") or x[k - 1].upper == "DISTINCT"):
                return None
        return {t.text.strip("`").replace("``", "`").lower() for t in x if t.kind in ("word", "quoted")}
    if is_dataclass(x):
        x = [getattr(x, f.name) for f in fields(x)]
    found: set[str] = {x.strip("`").lower()} if isinstance(x, str) else set()
    for y in x if isinstance(x, list | tuple) else ():
        if (more := _words(y)) is None:
            return None
        found |= more
    return found
