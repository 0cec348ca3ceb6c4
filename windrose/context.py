"""The public entry: streams and tables by name, queries in the dialect."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from windrose.functions import JsonConverter
from windrose.operators.durations import WindowError, span
from windrose.plans.lexer import SyntaxProblem, render, statements, tokens
from windrose.plans.lift import Lifted, Lifter, Stream, visible
from windrose.plans.parser import Derived, Insert, Join, Lateral, Query, Table, has_window, parse
from windrose.sinks import KafkaSink, Sink, TableSink
from windrose.sources import is_live, open_source
from windrose.streaming import ContinuousQuery


class StreamContext:
    """Queries over registered streams and tables.

    batch_interval: what windows and slides must be multiples of, and the tumbling window in which streams
    without a window are joined; None: neither. default_slide: 'tumble', or 'batch' for plain windows that
    move by the batch interval. lateness: how long streams wait for late rows.
    """

    def __init__(self, spark: SparkSession, batch_interval: str | int | None = None, *, default_slide: str = "tumble", lateness: str | int = 0, panes: bool = True):
        self.spark, self.batch = spark, None if batch_interval is None else span(batch_interval)
        self.default_slide, self.lateness, self.panes = default_slide, span(lateness), panes
        self.streams: dict[str, Stream] = {}
        self.sinks: dict[str, Sink] = {}

    # -- names -----------------------------------------------------------------------------------------------

    @property
    def udf(self):
        """The session's function registry."""
        return self.spark.udf

    def create_stream(self, rows: DataFrame | Iterable, schema: StructType | str | None = None) -> DataFrame:
        """A stream's rows from a DataFrame, or from dataclass instances, Rows or tuples."""
        if isinstance(rows, DataFrame):
            return rows
        rows = list(rows)
        if schema is None and rows and hasattr(rows[0], "__dataclass_fields__"):
            names = list(rows[0].__dataclass_fields__)
            return self.spark.createDataFrame([tuple(getattr(r, n) for n in names) for r in rows], names)
        return self.spark.createDataFrame(rows, schema)

    def register_stream(self, df: DataFrame, name: str, ts: str) -> None:
        """Names a stream; ts is its time column."""
        if ts not in df.columns:
            raise ValueError(f"{name} has no column {ts}")
        self.streams[name.lower()] = Stream(df, ts, self.batch)
        df.createOrReplaceTempView(name)

    def register_table(self, df: DataFrame, name: str) -> None:
        df.createOrReplaceTempView(name)

    def register_sink(self, name: str, sink: Sink) -> None:
        """A target of INSERT INTO TABLE."""
        self.sinks[name.lower()] = sink

    def drop_table(self, name: str) -> None:
        self.streams.pop(name.lower(), None)
        self.sinks.pop(name.lower(), None)
        self.spark.catalog.dropTempView(name)

    def table(self, name: str) -> DataFrame:
        s = self.streams.get(name.strip("`").lower())
        return s.df if s else self.spark.table(name)

    def _resolve(self, name: str) -> Stream | DataFrame:
        return self.streams.get(name.strip("`").lower()) or self.spark.table(name)

    def parse_expression(self, text: str) -> Column:
        """An expression in the dialect's spelling as a column."""
        return F.expr(render(Lifter(self.spark, self._resolve).expr(tokens(text))))

    @staticmethod
    def parse_table_identifier(text: str) -> tuple[str, ...]:
        """The parts of a table's name."""
        ts = tokens(text)
        if len(ts) % 2 == 0 or any(t.text != "." if k % 2 else t.kind not in ("word", "quoted") for k, t in enumerate(ts)):
            raise SyntaxProblem(f"no table name: {text}")
        return tuple(t.text[1:-1].replace("``", "`") if t.kind == "quoted" else t.text for t in ts[::2])

    # -- JSON ------------------------------------------------------------------------------------------------

    def infer_json_schema(self, path: str, sampling_ratio: float = 1.0) -> StructType:
        return self.spark.read.option("samplingRatio", sampling_ratio).json(path).schema

    def json_stream(self, df: DataFrame, schema: StructType | str, sampling_ratio: float = 1.0, value: str = "value") -> DataFrame:
        """Rows of a stream of JSON texts; schema: the type, or the path of a sample to infer it from."""
        if isinstance(schema, str):
            schema = self.infer_json_schema(schema, sampling_ratio)
        keep = [c for c in df.columns if c != value and c not in schema.names]
        return df.select(*keep, *JsonConverter().to_row(F.col(f"`{value}`").cast("string"), schema))

    # -- queries ---------------------------------------------------------------------------------------------

    def sql(self, text: str) -> DataFrame | ContinuousQuery | None:
        """A bounded query's result, a query over streams to be started, or None for a bounded INSERT.

        Text that isn't of the dialect goes to Spark's parser, unless it has a window clause.
        """
        try:
            ast = parse(text)
        except WindowError:
            raise
        except SyntaxProblem as e:
            if has_window(text):
                raise WindowError(f"the window clause can't be read: {e}") from e
            return self.spark.sql(text)
        if isinstance(ast, Insert):
            return self._insert(ast)
        return self._query(ast)

    def _query(self, ast: Query, show: Callable[[Lifted], DataFrame] = visible) -> DataFrame | ContinuousQuery:
        names, windowed = _tables(ast)
        live = [n for n in names if (s := self.streams.get(n.strip("`").lower())) and s.df.isStreaming]
        if live:
            return ContinuousQuery(self.spark, ast, self._resolve, delay=self.lateness, batch=self.batch, windowed=windowed, streams=len(live), default_slide=self.default_slide, panes=self.panes, show=show)
        return show(Lifter(self.spark, self._resolve, default_slide=self.default_slide, panes=self.panes).query(ast))

    def _insert(self, ast: Insert):
        ast.query.ctes = ast.ctes + ast.query.ctes
        got = self._query(ast.query, Lifted.only)  # the query's own columns, not the window bounds
        name = ast.target.strip("`").lower()
        if isinstance(got, ContinuousQuery):  # a stream sink appends, whatever the statement says
            return got.start(self.sinks.get(name) or TableSink(ast.target))
        (self.sinks.get(name) or TableSink(ast.target, overwrite=ast.overwrite)).write(got, 0)
        return None

    def explain(self, text: str, extended: bool = False) -> None:
        got = self.sql(text)
        got.explain(extended) if isinstance(got, ContinuousQuery) else got.explain("extended" if extended else "formatted")

    def command(self, text: str) -> None:
        """Runs the statements of a script at once: CREATE TABLE ... USING, INSERT, SET and what else Spark knows."""
        for s in statements(text):
            if (m := _CREATE.match(s)) and (is_live(m["provider"]) or re.search(r"\bpath\b", m["options"] or "", re.I)):
                self._create(m)
            elif re.match(r"\s*DROP\s+TABLE\s+(IF\s+EXISTS\s+)?[\w`.]+\s*$", s, re.I) and s.split()[-1].lower() in self.streams:
                self.drop_table(s.split()[-1])
            elif re.match(r"\s*(INSERT|WITH|SELECT)\b", s, re.I):
                self.sql(s)
            else:
                self.spark.sql(s)

    def _create(self, m: re.Match) -> None:
        """A source as a table; with option ts, or a source's own timestamp, as a stream."""
        schema = self.spark.createDataFrame([], m["cols"]).schema if m["cols"] else None
        options = {k.strip("`'\""): v[1:-1] for k, v in re.findall(r"([\w.`'\"]+)\s*=?\s*('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", m["options"] or "")}
        low = {k.lower(): v for k, v in options.items()}
        df = open_source(self.spark, m["provider"], schema, options)
        name = m["name"].strip("`")
        ts = low.get("ts") or ("timestamp" if "timestamp" in df.columns else None)
        if low.get("topics") and low.get("brokerlist"):
            self.register_sink(name, KafkaSink(options, low.get("messagetorow", "delimiter")))
        if ts:
            self.register_stream(df, name, ts)
        else:
            self.register_table(df, name)


_CREATE = re.compile(r"\s*CREATE\s+(?:TEMPORARY\s+)?(?:TABLE|VIEW)\s+(?P<name>[\w`.]+)\s*(?:\((?P<cols>(?:[^()']|\([^()]*\))*)\)\s*)?USING\s+(?P<provider>[\w.`]+)\s*(?:OPTIONS\s*\((?P<options>.*)\))?\s*$", re.I | re.S)


def _tables(q: object) -> tuple[list[str], bool]:
    """The table names of a query, and whether any relation has a window."""
    names, windowed = [], False

    def walk(x: object) -> None:
        nonlocal windowed
        if isinstance(x, Query):
            for _, body in x.ctes:
                walk(body)
            for y in [x.first, *(b for _, b in x.rest)]:
                walk(y if isinstance(y, Query) else y.source)
        elif isinstance(x, Join):
            walk(x.left)
            walk(x.right)
        elif isinstance(x, Lateral):
            walk(x.left)
        elif isinstance(x, Table | Derived):
            windowed = windowed or x.window is not None
            walk(x.query) if isinstance(x, Derived) else names.append(x.name)

    walk(q)
    return names, windowed
