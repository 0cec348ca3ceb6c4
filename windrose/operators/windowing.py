"""Time windows as a column, and aggregation over panes."""

from __future__ import annotations

from math import ceil, gcd, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.operators.durations import spelled

#: The window struct (start, end) of a row, or the end alone where windows of several widths meet.
WIN, END = "__win", "__we"


def before(end: Column, ms: int) -> Column:
    return end - F.expr(f"make_dt_interval(0, 0, 0, {ms / 1000:.3f})")


def assign(df: DataFrame, ts: str, width: int, slide: int) -> DataFrame:
    """One row for each window that holds a row's time: [end - width, end), ends at multiples of slide.

    With a slide longer than the width, rows between two windows are in none, and the column begins at the window's end
    less the slide: as it is, streams know when it closes.
    """
    if slide <= width:
        return df.withColumn(WIN, F.window(F.col(f"`{ts}`"), spelled(width), *([spelled(slide)] if slide != width else [])))
    df = df.withColumn(WIN, F.window(F.col(f"`{ts}`"), spelled(slide)))
    return df.filter(F.col(f"`{ts}`") >= before(F.col(f"{WIN}.end"), width))


#: Aggregates whose partial results merge exactly.
MERGEABLE = ("count", "sum", "min", "max", "avg")
_PARTIAL = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


#: Types whose equal values have equal hashes; of -0.0 and 0.0 callers make one.
HASHABLE = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "date", "timestamp", "timestamp_ntz", "string", "binary")


def register_bits(rsd: float) -> int:
    """Bits of the registers' number for an approximate count of relative standard deviation rsd.

    The registers' own deviation, 1.04 / sqrt(2^bits), is a fourth of rsd at most: rsd is a promise for each of many
    groups, so three times rsd must be beyond chance. Registers are rows and only filled ones exist, so a small group
    has no more of them than values.
    """
    return min(max(ceil(2 * log2(4 * 1.04 / rsd)), 4), 31)


def _register(value: Column, bits: int) -> tuple[Column, Column]:
    """HyperLogLog's register of a value, by its hash's first bits, and the rank of the first 1 in the others."""
    h = F.xxhash64(value)
    rest = F.shiftleft(h, bits).bitwiseOR(F.lit(1 << bits - 1).cast("bigint"))
    there = value.isNotNull()
    return F.when(there, F.shiftrightunsigned(h, 64 - bits).cast("int")), F.when(there, (65 - F.length(F.bin(rest))).cast("int"))


def _estimate(bits: int) -> Column:
    """The number of values from all filled registers of a group, without bias for small and middle counts (Ertl 2017)."""
    m = float(1 << bits)
    empty = (F.lit(m) - F.count("__reg")) / m
    low = empty
    for k in range(1, bits + 7):
        low = low + F.pow(empty, F.lit(float(1 << k))) * float(1 << k - 1)
    full = F.sum(F.when(F.col("__reg").isNotNull(), F.lit(1.0) / F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__rank"))))
    return F.when(F.count("__reg") == 0, F.lit(0)).otherwise(F.round(F.lit(m * m / (2 * log(2))) / (low * m + full))).cast("bigint")


#: Windows of a block, as the bits of a long.
BLOCK = 64


def _distinct_by_blocks(df: DataFrame, ts: str, width: int, slide: int, keys: dict[str, Column], of: dict[str, Column], distinct: dict[str, str], approx: dict[str, int]) -> DataFrame:
    """Distinct and approximate counts of bounded rows: windows as the bits of a mask, one for each block of windows.

    A value has one row for each group and block, however many windows hold it, and masks merge by OR. Of a register the
    values come by falling rank, and each fills it in the windows where no value before did. Only in the last step, after
    rows have moved, do bits become windows; they are summed before they move.
    """
    bits = max(approx.values(), default=0)
    ntz = df.schema[ts].dataType.typeName() == "timestamp_ntz"
    epoch = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
    at = f"CAST(CAST(CAST(`{ts}` - {epoch} AS INTERVAL SECOND) AS DECIMAL(20, 6)) * 1000000 AS BIGINT)" if ntz else f"unix_micros(`{ts}`)"
    div = lambda x, by: f"(({x}) - pmod({x}, {by}L)) div {by}L"
    named = [c.alias(k) for k, c in (keys | of).items()]
    rows = df.filter(F.col(f"`{ts}`").isNotNull()).select(*named, F.expr(at).alias("__at"))
    if approx:
        reg, rank = _register(F.col(next(iter(of))), bits)
        rows = rows.withColumns({"__reg": reg} if distinct else {"__reg": reg, "__rank": rank})
    inner = [*(of if distinct else ()), *(["__reg"] if approx else ()), *(["__rank"] if approx and not distinct else ())]
    rows = rows.select(*keys, *inner, F.expr(div("__at", slide * 1000)).alias("__hi"), F.expr(f"{div(f'__at - {width * 1000}L', slide * 1000)} + 1L").alias("__lo"))
    rows = rows.withColumn("__block", F.explode(F.expr(f"sequence({div('__lo', BLOCK)}, {div('__hi', BLOCK)})")))
    first, last = f"int(greatest(__lo - __block * {BLOCK}L, 0L))", f"int(least(__hi - __block * {BLOCK}L, {BLOCK - 1}L))"
    rows = rows.withColumn("__in", F.expr(f"shiftleft(-1L, {first}) & shiftrightunsigned(-1L, {BLOCK - 1} - {last})"))
    rows = rows.groupBy("__block", *keys, *inner).agg(F.bit_or("__in").alias("__in"))
    whole = F.lit(True)
    for c in of if distinct else ():
        whole = whole & F.col(c).isNotNull()
    rows = rows.withColumn("__whole", whole)
    if approx:
        if distinct:
            rows = rows.withColumn("__rank", rank)
        above = W.partitionBy("__block", *keys, "__reg").orderBy(F.col("__rank").desc()).rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("__seen", F.coalesce(F.bit_or("__in").over(above), F.lit(0).cast("bigint")))
    else:
        rows = rows.withColumn("__seen", F.lit(0).cast("bigint"))
    rows = rows.withColumn("__bit", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))).filter("shiftrightunsigned(__in, __bit) & 1L = 1L")
    finals = [(F.count(F.when(F.col("__whole"), F.lit(1))) if f == "count" else F.sum(next(iter(of)))).alias(name) for name, f in distinct.items()]
    if approx:
        rows = rows.withColumn("__reg", F.expr("if(shiftrightunsigned(__seen, __bit) & 1L = 0L, __reg, NULL)"))
        finals += [_estimate(bits).alias(name) for name in approx]
    out = rows.groupBy("__block", "__bit", *keys).agg(*finals)
    n = f"(__block * {BLOCK}L + __bit)"
    second = lambda ms: f"make_dt_interval(0, 0, 0, {ms / 1000:.3f})"
    start, end = (F.expr(f"{epoch} + {second(slide)} * {n}" + (f" + {second(ms)}" if ms else "") if ntz else f"timestamp_micros({n} * {slide * 1000}L + {ms * 1000}L)") for ms in (0, width))
    return out.select(F.struct(start.alias("start"), end.alias("end")).alias(WIN), *keys, *distinct, *approx)


def pane_aggregate(df: DataFrame, ts: str, width: int, slide: int, keys: dict[str, Column], aggs: dict[str, tuple[str, Column]],
                   of: dict[str, Column] | None = None, distinct: dict[str, str] | None = None, approx: dict[str, int] | None = None) -> DataFrame:
    """Aggregates of windows from panes as long as the greatest common divisor of width and slide.

    Rows are aggregated once, into the pane they fall in; only the few (pane, key) rows are then copied to the
    windows that cover the pane. Without panes each row is copied width/slide times before it is aggregated.
    Partial counts, sums, minima and maxima merge exactly; avg is its sum, as a double, over its count. aggs: name
    to (function, expression).

    distinct: name to count or sum, of the distinct values of the columns ``of``. These columns are keys of the
    panes and of the windows until equal values have met, then one more step counts them.

    approx: name to the bits of the registers, of the one column ``of``; all share the most bits. A register is a key
    as a distinct value is. Beside distinct aggregates the registers are filled from the distinct values.

    Each step is an aggregation by event time, so that streams run it natively, one after the other. Sliding windows of
    bounded rows that ask for nothing else have their distinct values by blocks. Returns WIN, the keys and the aggregates.
    """
    of, distinct, approx = of or {}, distinct or {}, approx or {}
    if of and not aggs and slide != width and not df.isStreaming and df.schema[ts].dataType.typeName() in ("timestamp", "timestamp_ntz"):
        return _distinct_by_blocks(df, ts, width, slide, keys, of, distinct, approx)
    bits = max(approx.values(), default=0)
    # Keys of the panes beside the groups: the distinct values or, without need for them, the registers.
    inner = of
    if approx and not distinct:
        reg, rank = _register(next(iter(of.values())), bits)
        inner, aggs = {"__reg": reg}, aggs | {"__rank": ("max", rank)}
    parts, merges, finals = [], [], []
    for name, (f, e) in aggs.items():
        cut = [(f"{name}__s", "sum", e.cast("double")), (f"{name}__c", "count", e)] if f == "avg" else [(name if name == "__rank" else f"{name}__p", f, e)]
        parts += [_PARTIAL[g](x).alias(p) for p, g, x in cut]
        merges += [_MERGE[g](p).alias(p) for p, g, _ in cut]
        if name != "__rank":
            finals.append((F.sum(cut[0][0]) / F.nullif(F.sum(cut[1][0]), F.lit(0)) if f == "avg" else _MERGE[f](cut[0][0])).alias(name))
    whole = F.lit(True)
    for c in of:
        whole = whole & F.col(c).isNotNull()
    count, total = F.count(F.when(whole, F.lit(1))), F.sum(next(iter(of), F.lit(0)))
    if approx and distinct:  # counted when the registers are filled
        filled = [count.alias("__dc"), *([total.alias("__ds")] if "sum" in distinct.values() else []), F.max("__rank").alias("__rank")]
        count, total = F.sum("__dc"), F.sum("__ds")
    finals += [(count if f == "count" else total).alias(name) for name, f in distinct.items()]
    finals += [_estimate(bits).alias(name) for name in approx]
    named = [c.alias(k) for k, c in (keys | inner).items()]
    by, deep = [F.col(k) for k in keys], [F.col(k) for k in keys | inner]
    # Spark wants an aggregate in each step, also where only keys are made distinct.
    none = [F.count(F.lit(1)).alias("__n")]
    if slide == width:
        wide = df.groupBy(F.window(F.col(f"`{ts}`"), spelled(width)).alias(WIN), *named).agg(*(parts or none))
    else:
        panes = df.groupBy(F.window(F.col(f"`{ts}`"), spelled(gcd(width, slide))).alias("__pane"), *named).agg(*(parts or none))
        wide = panes.select(F.window(F.window_time("__pane"), spelled(width), spelled(slide)).alias(WIN), *[c for c in panes.columns if c != "__pane"])
        if inner:
            wide = wide.groupBy(WIN, *deep).agg(*(merges or none))
    if approx and distinct:
        reg, rank = _register(F.col(next(iter(of))), bits)
        wide = wide.withColumns({"__reg": reg, "__rank": rank}).groupBy(WIN, *by, "__reg").agg(*merges, *filled)
    return wide.groupBy(WIN, *by).agg(*finals)
