"""Clauses to DataFrames that hold, for each instant, the SQL answer as of that instant.

Every windowed relation carries its window as a column that the text can't see. Each clause gets that column
where it needs it: joins are equal on it, groups and DISTINCT include it, LIMIT counts within it, set
operations compare it. The rest is left to Spark's SQL over temporary views.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.operators.durations import WindowError, check, spelled
from windrose.operators.windowing import END, HASHABLE, MERGEABLE, WIN, assign, before, pane_aggregate, register_bits
from windrose.plans.lexer import Token, render, tokens
from windrose.plans.parser import Block, Derived, Item, Join, Lateral, Order, Query, Table, WindowClause

_IDS = itertools.count()
#: The time of an unwindowed stream's rows, carried beside what a subquery selects.
TIME = "__ts"


@dataclass
class Stream:
    """A registered stream: its rows, time column and batch interval. live: whether it goes on, even where df stands
    for a part of it; None: as df says."""

    df: DataFrame
    ts: str
    batch: int | None = None
    live: bool | None = None

    def __post_init__(self) -> None:
        if self.live is None:
            self.live = self.df.isStreaming


@dataclass
class Lifted:
    """A result: df with the visible columns and, if windowed, WIN or END (kind)."""

    df: DataFrame
    columns: list[str]
    kind: str | None = None
    width: int | None = None
    slide: int | None = None
    stream: Stream | None = None  # of an unwindowed stream: df and its time column

    def only(self, kind: str | None = None) -> DataFrame:
        """The visible columns, and the instant as WIN or END."""
        names = [f"__k{i}" for i in range(len(self.df.columns))]  # names of a result may repeat
        df = self.df.toDF(*names)
        cols = [F.col(n).alias(c) for n, c in zip(names, self.columns)]
        if kind:
            at = F.col(names[self.df.columns.index(self.kind)])
            cols.append((at if kind == self.kind else at["end"]).alias(kind))
        return df.select(*cols)


@dataclass
class _Side:
    """Relations of a FROM clause so far: SQL, (alias, columns) of each, and the SQL of the instant."""

    sql: str
    parts: list[tuple[str, list[str]]]
    kind: str | None = None
    at: str = ""
    width: int | None = None
    slide: int | None = None
    single: Lifted | None = None
    streams: list[str] = field(default_factory=list)


class Lifter:
    """resolve: what a table name stands for. unwindowed: how joined streams without a window meet
    ('table': as whole tables, or milliseconds of a tumbling window)."""

    def __init__(self, spark: SparkSession, resolve: Callable[[str], Stream | DataFrame], *, default_slide: str = "tumble", unwindowed: str | int = "table", panes: bool = True):
        self.spark, self.resolve, self.default_slide, self.unwindowed, self.panes = spark, resolve, default_slide, unwindowed, panes
        self.tops = panes
        self._views: list[str] = []
        self._depth = 0

    # -- queries ---------------------------------------------------------------------------------------------

    def query(self, q: Query, env: dict[str, Lifted] | None = None) -> Lifted:
        env = dict(env or {})
        self._depth += 1
        try:
            for name, body in q.ctes:
                env[name.strip("`").lower()] = self.query(body, env)
            out = self.operand(q.first, env)
            for op, right in q.rest:
                out = self.combine(op, out, self.operand(right, env))
            return out
        finally:
            self._depth -= 1
            if not self._depth:  # what was made of the views is analysed by now
                while self._views:
                    self.spark.catalog.dropTempView(self._views.pop())

    def operand(self, x: Block | Query, env: dict[str, Lifted]) -> Lifted:
        return self.query(x, env) if isinstance(x, Query) else self.block(x, env)

    def combine(self, op: str, a: Lifted, b: Lifted) -> Lifted:
        """Set operations have no precedence; INTERSECT and EXCEPT are of sets."""
        if len(a.columns) != len(b.columns):
            raise ValueError(f"{op.upper()} of {len(a.columns)} and {len(b.columns)} columns")
        if (a.kind is None) != (b.kind is None):
            raise WindowError(f"{op.upper()} of a windowed and an unwindowed query")
        if a.kind and a.slide != b.slide:
            raise WindowError(f"{op.upper()} of queries with slides of {a.slide} and {b.slide} ms")
        kind = WIN if a.kind == b.kind == WIN and a.width == b.width else END if a.kind else None
        timed = op == "union all" and not kind and a.stream and b.stream
        if timed:  # streams united are a stream
            left, right = _with_time(a), _with_time(b)
        else:
            left, right = a.only(kind), b.only(kind)
        last = [kind] if kind else [TIME] if timed else []
        names = [f"c{i}" for i in range(len(a.columns))] + last
        left, right = left.toDF(*names), right.toDF(*names)
        df = {"union all": lambda: left.union(right), "union": lambda: left.union(right).distinct(), "intersect": lambda: left.intersect(right), "except": lambda: left.subtract(right)}[op]()
        df = df.toDF(*a.columns, *last)
        return Lifted(df, a.columns, kind, a.width if kind == WIN else None, a.slide, Stream(df, TIME, a.stream.batch, a.stream.live or b.stream.live) if timed else None)

    # -- relations -------------------------------------------------------------------------------------------

    def view(self, df: DataFrame) -> str:
        name = f"__v{next(_IDS)}"
        df.createOrReplaceTempView(name)
        self._views.append(name)
        return name

    def slide_of(self, w: WindowClause, s: Stream) -> int:
        slide = w.slide or (s.batch if self.default_slide == "batch" and s.batch else w.width)
        check(w.width, slide, s.batch)
        return slide

    def windowed(self, rel: Lifted, w: WindowClause, what: str) -> Lifted:
        if rel.kind:
            raise WindowError(f"{what} is windowed already")
        if rel.stream is None:
            raise WindowError(f"{what} is no stream: it has no time column")
        slide = self.slide_of(w, rel.stream)
        return self.assigned(rel, w.width, slide)

    def assigned(self, rel: Lifted, width: int, slide: int) -> Lifted:
        """A stream's rows in their windows."""
        return Lifted(assign(rel.df, rel.stream.ts, width, slide), rel.columns, WIN, width, slide, rel.stream)

    def relation(self, r: object, env: dict[str, Lifted]) -> _Side:
        if isinstance(r, Join):
            return self.join(r, env)
        if isinstance(r, Lateral):
            side = self.relation(r.left, env)
            alias = re.search(r"\)\s*(\S+)\s+(?:AS\s+)?([\w`, ]+)$", render(r.clause), re.I)
            made = [c.strip(" `") for c in alias[2].split(",")] if alias else []
            return _Side(f"{side.sql} LATERAL VIEW {render(self.expr(r.clause, side))}", [*side.parts, (alias[1] if alias else "", made)], side.kind, side.at, side.width, side.slide)
        if isinstance(r, Derived):
            rel, alias = self.query(r.query, env), r.alias
        else:
            key = r.name.strip("`").lower()
            alias = r.alias or f"`{r.name.split('.')[-1].strip('`')}`"
            if key in env:
                rel = env[key]
            else:
                got = self.resolve(r.name)
                rel = Lifted(got.df, got.df.columns, stream=got) if isinstance(got, Stream) else Lifted(got, got.columns)
        if r.window:
            rel = self.windowed(rel, r.window, r.name if isinstance(r, Table) else alias)
        at = f"{alias}.{rel.kind}" if rel.kind else ""
        return _Side(f"{self.view(rel.df)} AS {alias}", [(alias, rel.columns)], rel.kind, at, rel.width, rel.slide, rel, [alias] if rel.stream and not rel.kind else [])

    def join(self, j: Join, env: dict[str, Lifted]) -> _Side:
        a, b = self.relation(j.left, env), self.relation(j.right, env)
        if isinstance(self.unwindowed, int) and a.streams and b.streams and not a.kind and not b.kind:
            a, b = self._tumbled(a), self._tumbled(b)
        on = [f"({render(self.expr(j.on))})"] if j.on else []
        kind, at, width, slide = a.kind, a.at, a.width, a.slide
        if a.kind and b.kind:
            if a.slide != b.slide:
                raise WindowError(f"joined streams must share their slide; these have {a.slide} and {b.slide} ms")
            kind = WIN if a.kind == b.kind == WIN and a.width == b.width else END
            la, lb = (x.at if kind == WIN or x.kind == END else f"{x.at}.end" for x in (a, b))
            on.append(f"{la} = {lb}")
            at = {"right": lb, "full": f"coalesce({la}, {lb})"}.get(j.kind, la)
            width = a.width if kind == WIN else None
        elif b.kind:
            if j.kind == "semi":
                raise WindowError("a windowed stream on the right of LEFT SEMI JOIN needs a windowed left side")
            kind, at, width, slide = b.kind, b.at, b.width, b.slide
        word = {"inner": "INNER", "left": "LEFT OUTER", "right": "RIGHT OUTER", "full": "FULL OUTER", "semi": "LEFT SEMI"}[j.kind]
        right = f"({b.sql})" if isinstance(j.right, Join) else b.sql
        sql = f"{a.sql} {word if on or j.kind != 'inner' else 'CROSS'} JOIN {right}" + (f" ON {' AND '.join(on)}" if on else "")
        return _Side(sql, a.parts + (b.parts if j.kind != "semi" else []), kind, at, width, slide, None, a.streams + b.streams)

    def _tumbled(self, side: _Side) -> _Side:
        rel = side.single
        if rel is None:
            return side
        done = self.assigned(rel, self.unwindowed, self.unwindowed)
        done.stream = None
        alias = side.parts[0][0]
        return _Side(f"{self.view(done.df)} AS {alias}", side.parts, WIN, f"{alias}.{WIN}", self.unwindowed, self.unwindowed, done)

    # -- expressions -----------------------------------------------------------------------------------------

    def expr(self, ts: list[Token], side: _Side | None = None) -> list[Token]:
        """Spark's spelling of the dialect: approximate counts, mixed intervals, and row windows within an instant."""
        out: list[Token] = []
        i = 0
        while i < len(ts):
            t = ts[i]
            if t.upper == "APPROXIMATE":
                k, rsd = i + 1, []
                if k < len(ts) and ts[k].text == "(":
                    rsd, k = [Token("op", ","), ts[k + 1]], k + 3
                if [x.upper for x in ts[k : k + 3]] == ["COUNT", "(", "DISTINCT"]:
                    end = _closing(ts, k + 1)
                    out += [Token("word", "approx_count_distinct"), Token("op", "("), *self.expr(ts[k + 3 : end], side), *rsd, Token("op", ")")]
                    i = end + 1
                    continue
            if t.upper == "INTERVAL" and i + 2 < len(ts):
                parts, k = {}, i + 1
                while k < len(ts):
                    sign = ts[k].text == "-"
                    unit = ts[k + sign + 1].text.lower().rstrip("s") if k + sign + 1 < len(ts) else ""
                    if ts[k + sign].kind not in ("number", "string") or unit not in _UNITS:
                        break
                    parts[unit] = ("-" if sign else "") + ts[k + sign].text.strip("'\"")
                    k += 2 + sign
                if parts:
                    scale = lambda *us: " + ".join(f"{parts[u]} * {f}" if f != 1 else parts[u] for u, f in us if u in parts) or "0"
                    text = f"make_interval({scale(('year', 1))}, {scale(('month', 1))}, {scale(('week', 1))}, {scale(('day', 1))}, {scale(('hour', 1))}, {scale(('minute', 1))}, {scale(('second', 1), ('millisecond', '0.001'), ('microsecond', '0.000001'))})"
                    out += tokens(text)
                    i = k
                    continue
            out.append(t)
            if t.upper == "OVER" and side is not None and side.kind and i + 1 < len(ts) and ts[i + 1].text == "(":
                at = tokens(side.at)
                if [x.upper for x in ts[i + 2 : i + 4]] == ["PARTITION", "BY"]:
                    out += [ts[i + 1], ts[i + 2], ts[i + 3], *at, Token("op", ",")]
                    i += 4
                else:
                    out += [ts[i + 1], Token("word", "PARTITION"), Token("word", "BY"), *at]
                    i += 2
                continue
            i += 1
        return out

    # -- blocks ----------------------------------------------------------------------------------------------

    def block(self, b: Block, env: dict[str, Lifted], *, of_panes: bool = False) -> Lifted:
        """of_panes: for ``_tops``, with hidden sort keys and in no order."""
        said = b
        b = replace(b, order=[replace(o) for o in b.order], sort=[replace(o) for o in b.sort])  # a query may be lifted again
        side = self.relation(b.source, env) if b.source is not None else _Side("", [])
        text = lambda ts: render(self.expr(ts, side))
        items = self._items(b.items, side)
        if side.kind and self.panes and (fast := self._by_panes(b, side, items)):
            return self._ordered(b, fast, [])
        hidden = self._hidden_keys(b, items)
        cols = [f"{text(i.expr)}" + (f" AS {i.alias}" if i.alias else "") for i in items] + [f"{text(e)} AS {n}" for n, e in hidden]
        frm = (f" FROM {side.sql}" if side.sql else "") + (f" WHERE {text(b.where)}" if b.where else "")
        late = b.having is not None and not b.group and not self._aggregates(cols, frm)
        grouped = bool(b.group) or (side.kind is not None and self._aggregates(cols, frm))
        group = f" GROUP BY {text(b.group)}" if b.group else ""
        timed = side.single is not None and side.single.stream is not None and not (side.kind or grouped or late or b.distinct or self._aggregates(cols, frm))
        if timed:
            cols.append(f"{side.parts[0][0]}.`{side.single.stream.ts}` AS {TIME}")
        if side.kind:
            cols.append(f"{side.at} AS {side.kind}")
            if grouped:
                group = f" GROUP BY {side.at}" + (f", {_rollup(b.group, text)}" if b.group else "")
        having = f" HAVING {text(b.having)}" if b.having and not late else ""
        df = self.spark.sql(f"SELECT {'DISTINCT ' if b.distinct else ''}{', '.join(cols)}{frm}{group}{having}")
        if late:  # HAVING without groups filters what was selected
            df = df.filter(text(b.having))
        n = len(items)
        out = Lifted(df, df.columns[:n], side.kind, side.width, side.slide)
        if timed:
            out.stream = replace(side.single.stream, df=df, ts=TIME)
        hidden = [name for name, _ in hidden]
        if of_panes:
            return self._ordered(b, out, hidden, whole=False)
        if self.tops and side.kind == WIN and b.limit is not None and b.order and not (grouped or late or b.distinct or b.sort):
            out = self._tops(said, side, env) or out
        return self._ordered(b, out, hidden)

    def _tops(self, b: Block, side: _Side, env: dict[str, Lifted]) -> Lifted | None:
        """The rows that may be among the first of a sliding window: those that are among the first of their pane, so
        that joins and sorts have each row once and not once for each window."""
        if side.slide >= side.width or side.width % side.slide or any(t.upper == "OVER" for i in b.items for t in i.expr) or any(t.upper == "OVER" for o in b.order for t in o.expr):
            return None
        source = _in_panes(b.source, side.slide, env)
        if source is None:
            return None
        rel = self.block(replace(b, source=source), env, of_panes=True)
        df = rel.df
        names = [f"__k{i}" for i in range(len(df.columns))]
        pane = names[df.columns.index(WIN)]
        wide = df.toDF(*names).select(*[c for c in names if c != pane], F.window(F.col(f"{pane}.start"), spelled(side.width), spelled(side.slide)).alias(pane))
        wide = self.closed(wide.select(*names), pane).toDF(*df.columns)
        return Lifted(wide, rel.columns, WIN, side.width, side.slide)

    def closed(self, df: DataFrame, win: str) -> DataFrame:
        """Of rows in all windows of their pane those in windows to be answered."""
        return df

    def _items(self, items: list[Item], side: _Side) -> list[Item]:
        """Stars become the columns that the text may see, where there are others."""
        out = []
        for i in items:
            names = [t.text for t in i.expr]
            if names[-1] == "*" and (len(names) == 1 or names[-2] == ".") and side.parts:
                of = "".join(names[:-2]).strip("`").lower() if len(names) > 1 else None
                for alias, cols in side.parts:
                    if of is None or alias.strip("`").lower() == of:
                        out += [Item(tokens((f"{alias}." if alias else "") + f"`{c}`")) for c in cols]
            else:
                out.append(i)
        return out

    def _aggregates(self, cols: list[str], frm: str) -> bool:
        """Whether a SELECT without GROUP BY aggregates; Spark's analyzer knows all functions."""
        plan = self.spark.sql(f"SELECT {', '.join(cols)}{frm}")._jdf.queryExecution().analyzed()
        while True:
            name = plan.nodeName()
            if name == "Aggregate":
                return True
            if name not in ("Project", "Window") or plan.children().size() != 1:
                return False
            plan = plan.children().head()

    def _hidden_keys(self, b: Block, items: list[Item]) -> list[tuple[str, list[Token]]]:
        """Sort keys that aren't in the result ride along. Fills in what each key is called."""
        hidden = []
        names = {(i.alias or i.expr[-1].text).strip("`").lower(): i for i in items}
        for n, o in enumerate(b.order + b.sort):
            key = render(o.expr)
            same = next((i for i in items if render(i.expr).lower() == key.lower()), None)
            if len(o.expr) == 1 and (key.isdigit() or key.strip("`").lower() in names):
                continue
            if same is not None:
                k = items.index(same)
                o.expr = [Token("number", str(k + 1))]
            elif b.distinct:
                raise ValueError(f"ORDER BY {key} isn't selected by SELECT DISTINCT")
            else:
                hidden.append((f"__o{n}", o.expr))
                o.expr = [Token("word", f"__o{n}")]
        return hidden

    def _ordered(self, b: Block, rel: Lifted, hidden: list[str], whole: bool = True) -> Lifted:
        """ORDER BY, SORT BY and LIMIT, within each instant. whole: the result in its order and without hidden keys."""
        keys = b.order + b.sort
        if not keys and b.limit is None:
            return rel
        df = rel.df
        names = [f"__k{i}" for i in range(len(df.columns))]
        own = df.toDF(*names)  # names of a result may repeat

        def sort_key(o: Order):
            t = render(o.expr)
            pos = int(t) - 1 if t.isdigit() else [c.lower() for c in df.columns].index(t.strip("`").lower())
            c = own[names[pos]]
            if "NULLS FIRST" in o.tail:
                return c.desc_nulls_first() if o.tail.startswith("DESC") else c.asc_nulls_first()
            if "NULLS LAST" in o.tail:
                return c.desc_nulls_last() if o.tail.startswith("DESC") else c.asc_nulls_last()
            return c.desc() if o.tail.startswith("DESC") else c.asc()

        by = [sort_key(o) for o in keys]
        at = own[names[df.columns.index(rel.kind)]] if rel.kind else None
        if b.limit is not None:
            n = self.spark.sql(f"SELECT CAST({render(b.limit)} AS INT)").first()[0]
            if rel.kind:
                end = at["end"] if rel.kind == WIN else at  # windows of one width; a time sorts faster than a struct
                own = own.withColumn("__rn", F.row_number().over(W.partitionBy(end).orderBy(*(by or [at])))).filter(F.col("__rn") <= n)
        if not whole:
            return replace(rel, df=own.drop("__rn").toDF(*df.columns))
        when = [] if at is None else [at["end"].asc() if rel.kind == WIN else at.asc()]
        if b.order:
            own = own.orderBy(*when, *by)
        elif b.sort:
            own = own.sortWithinPartitions(*when, *by)
        if b.limit is not None and not rel.kind:
            own = own.limit(n)
        keep = [i for i, c in enumerate(df.columns) if c not in hidden]
        out = own.select(*[names[i] for i in keep]).toDF(*[df.columns[i] for i in keep])
        return Lifted(out, rel.columns, rel.kind, rel.width, rel.slide, rel.stream and replace(rel.stream, df=out))

    def _by_panes(self, b: Block, side: _Side, items: list[Item]) -> Lifted | None:
        """An aggregation of one stream by panes, if every item is a group or made of mergeable, distinct and approximate
        aggregates.

        A tumbling one has only its distinct values to gain from steps, and these only on streams; approximate counts
        need them, since one plan for both kinds of counts would keep a sketch for each distinct value.
        """
        rel = side.single
        if rel is None or rel.kind != WIN or rel.stream is None or rel.slide > rel.width or b.having or b.distinct or any(len(o.expr) > 1 for o in b.order + b.sort):
            return None
        groups = {render(g).lower() for g in _split(b.group)} if b.group else set()
        keys, aggs, of, distinct, approx, out = {}, {}, {}, {}, {}, []
        values: str | None = None
        base = rel.stream.df.alias(side.parts[0][0].strip("`"))
        if b.where:
            base = base.filter(render(self.expr(b.where)))
        for n, i in enumerate(items):
            if render(i.expr).lower() in groups:
                keys[f"__g{n}"] = F.expr(render(self.expr(i.expr)))
                out.append(f"`__g{n}`")
                continue
            found = _calls(i.expr, f"__a{n}")
            if found is None or not found[1] or len(found[0]) > 1 and not i.alias:
                return None
            rest, calls = found
            for name, f, inner, rsd in calls:
                inner = self.expr(inner)
                many = _split(inner)
                if any(t.upper == "OVER" for t in inner) or not all(many):
                    return None
                if f in ("distinct count", "distinct sum", "approx"):
                    if values not in (None, render(inner)) or len(many) > 1 and f != "distinct count" or any(x[0].text == "*" for x in many):
                        return None
                    values = render(inner)
                    of = {f"__d{k}": F.expr(render(x)) for k, x in enumerate(many)}
                    kinds = [t for _, t in base.select(*[e.alias(k) for k, e in of.items()]).dtypes]
                    if any(t.startswith(("map", "variant")) for t in kinds) or f == "distinct sum" and kinds[0].startswith(("decimal", "interval")):
                        return None
                    if kinds[0] in ("float", "double"):
                        of["__d0"] = F.when(of["__d0"] == 0, F.lit(0).cast(kinds[0])).otherwise(of["__d0"])
                    if f == "approx":
                        if kinds[0].split("(")[0] not in HASHABLE:
                            return None
                        approx[name] = register_bits(rsd)
                    else:
                        distinct[name] = f.split()[1]
                    continue
                if len(many) > 1:
                    return None
                e = F.lit(1) if render(inner) == "*" else F.expr(render(inner))
                if f in ("sum", "avg") and dict(base.select(e.alias("x")).dtypes)["x"].startswith(("decimal", "interval")):
                    return None
                aggs[name] = (f, e)
            out.append(render(self.expr(rest)))
        if not (aggs or distinct or approx) or len(groups) != len(keys) or rel.slide == rel.width and not (approx or distinct and rel.stream.df.isStreaming):
            return None
        names = [(i.alias or (i.expr[-1].text if f"__g{n}" in keys else render(i.expr))).strip("`") for n, i in enumerate(items)]
        df = pane_aggregate(base, rel.stream.ts, rel.width, rel.slide, keys, aggs, of, distinct, approx)
        top = df._jdf.queryExecution().analyzed().nodeName()
        try:
            df = df.select(*[F.expr(o).alias(n) for o, n in zip(out, names)], WIN)
        except AnalysisException:  # what is left of an item needs the rows' columns
            return None
        plan = df._jdf.queryExecution().analyzed()
        if plan.nodeName() != "Project" or plan.children().head().nodeName() != top:  # or aggregates or generates
            return None
        return Lifted(df, names, WIN, rel.width, rel.slide)


_UNITS = {"year", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond"}


def _in_panes(r: object, slide: int, env: dict[str, Lifted]) -> object | None:
    """A FROM clause with panes as the windows of its only windowed relation, whose rows alone are in the result; None:
    it isn't such a clause."""
    if isinstance(r, Table | Derived) and r.window is not None:
        return replace(r, window=WindowClause(slide, slide))
    if isinstance(r, Join) and r.kind in ("inner", "left"):
        plain = lambda x: isinstance(x, Table) and x.window is None and x.name.strip("`").lower() not in env
        if plain(r.right) and (left := _in_panes(r.left, slide, env)) is not None:
            return replace(r, left=left)
        if r.kind == "inner" and plain(r.left) and (right := _in_panes(r.right, slide, env)) is not None:
            return replace(r, right=right)
    return None


def _closing(ts: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, len(ts)):
        depth += ts[i].text in ("(", "[")
        depth -= ts[i].text in (")", "]")
        if depth == 0:
            return i
    return -1


def _calls(ts: list[Token], prefix: str) -> tuple[list[Token], list[tuple[str, str, list[Token], float]]] | None:
    """An item with names in place of its aggregate calls, and for each its name, function, arguments and deviation.
    None: there is something whose calls aren't of the groups alone."""
    out: list[Token] = []
    calls: list[tuple[str, str, list[Token], float]] = []
    i = 0
    while i < len(ts):
        t, k, rsd = ts[i], i, 0.05
        approx = t.upper == "APPROXIMATE"
        if approx:
            k = i + 1
            if k < len(ts) and ts[k].text == "(":
                if not re.fullmatch(r"[\d.]*\d[\d.]*(e-?\d+)?", ts[k + 1].text, re.I):
                    return None
                rsd, k = float(ts[k + 1].text), k + 3
        if t.upper in ("OVER", "SELECT", "FILTER"):
            return None
        if k + 2 >= len(ts) or ts[k + 1].text != "(" or ts[k].text.lower() not in MERGEABLE or i and ts[i - 1].text == ".":
            out.append(t)
            i += 1
            continue
        end, f, few = _closing(ts, k + 1), ts[k].text.lower(), ts[k + 2].upper == "DISTINCT"
        if end < 0 or approx and not (few and f == "count" and rsd > 0) or few and f not in ("count", "sum") or end + 1 < len(ts) and ts[end + 1].upper in ("OVER", "FILTER"):
            return None
        name = f"{prefix}_{len(calls)}"
        calls.append((name, "approx" if approx else f"distinct {f}" if few else f, ts[k + 2 + few : end], rsd))
        out.append(Token("word", name))
        i = end + 1
    return out, calls


def _split(ts: list[Token] | None) -> list[list[Token]]:
    """At the commas of their own level."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in ts or ():
        depth += t.text in ("(", "[")
        depth -= t.text in (")", "]")
        if t.text == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _rollup(group: list[Token], text) -> str:
    """``a, b WITH CUBE`` can't follow another key, ``CUBE(a, b)`` can."""
    if len(group) > 2 and group[-2].upper == "WITH" and group[-1].upper in ("CUBE", "ROLLUP"):
        return f"{group[-1].upper}({text(group[:-2])})"
    return text(group)


def _with_time(rel: Lifted) -> DataFrame:
    names = [f"__k{i}" for i in range(len(rel.df.columns))]
    df = rel.df.toDF(*names)
    return df.select(*names[: len(rel.columns)], F.col(names[rel.df.columns.index(rel.stream.ts)]).alias(TIME))


def visible(rel: Lifted) -> DataFrame:
    """The result as users see it: windowed ones begin with window_start (if there's one width) and window_end."""
    if rel.kind is None:
        return rel.only() if len(rel.columns) < len(rel.df.columns) else rel.df
    names = [f"__k{i}" for i in range(len(rel.df.columns))]
    df = rel.df.toDF(*names)
    win = names[rel.df.columns.index(rel.kind)]
    start = lambda: F.col(f"{win}.start") if rel.slide <= rel.width else before(F.col(f"{win}.end"), rel.width)
    times = [(start(), "window_start"), (F.col(f"{win}.end"), "window_end")] if rel.kind == WIN else [(F.col(win), "window_end")]
    shown = names[: len(rel.columns)]
    return df.select(*[c.alias(n) for c, n in times], *[F.col(c).alias(n) for c, n in zip(shown, rel.columns)])
