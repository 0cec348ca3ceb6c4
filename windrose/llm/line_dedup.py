"""Line deduplication within a bound of word edits, by deletion neighbourhoods.

Two lines whose words differ by one substitution, insertion or deletion have a variant in common: the line
itself or the line without one word. Lines emit the hashes of these variants, equal hashes meet, and a line
goes if an earlier line is within the bound. What meets under one hash is never paired off: all lines of
one length that lack the same word position differ there at most, and all lines that become a given line by
one deletion are one edit from it, so the earliest of each suffices.

A line has as many variants as words, so only lines that can have a partner emit them: within one edit two
lines agree at one of their ends, and lines whose ends occur once have no partner.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import SPACE, SPACES, checkpoint, join_split, likely, named, packed, parted, small_hashes, words
from windrose.shipping import ship

#: The edit bound of a line of n words is 1 from so many words on, and 0 below: one word of few is no copy's edit.
MIN_WORDS = 10
#: Rows of (document, line) or keys of ends that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 400_000
#: Lines of one key in a task of a join.
HOT = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = 0xC2B2AE3D27D4EB4F


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _plain(line: Column) -> Column:
    """The words of a line one space apart."""
    odd = reduce(lambda a, b: a | b, [line.contains(x) for x in ("  ", *SPACES[1:])]) | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)


def _keys(rows: DataFrame, least: int) -> DataFrame:
    """(id, line, s) of lines that have words to (id, line, h1, h2, ends): hashes of all words and keys of both ends.

    Under its ends a line meets every line within one word edit: its first h and its last h words. h is half the
    greatest power of two that isn't above the number of words, and at least half of ``least``. One edit can't touch
    both ends, so two lines that have the same h share one. A line that is the shortest of its h has the keys of the
    next smaller h too, for partners with one word less. Lines of fewer than ``least`` words have no ends.
    """
    half = lambda n: F.expr(f"greatest({least} div 2, int(pow(2, floor(log2({n})))) div 2)")
    of = lambda h: f"xxhash64({h}, 0, substring_index(s, ' ', {h})), xxhash64({h}, 1, substring_index(s, ' ', -{h}))"
    plain = rows.select("id", "line", F.lower("s").alias("s")).select("id", "line", _plain(F.col("s")).alias("s"))
    sized = plain.select("*", (F.octet_length("s") - F.octet_length(F.replace("s", F.lit(" "), F.lit(""))) + 1).alias("n"))
    halves = sized.select("*", half("n").alias("h"), half(f"greatest(n - 1, {least})").alias("less"))
    ends = F.expr(f"CASE WHEN n < {least} THEN NULL WHEN h = less THEN array({of('h')}) ELSE array({of('h')}, {of('less')}) END")
    return halves.select("id", "line", F.xxhash64("s").alias("h1"), F.xxhash64("n", "s").alias("h2"), ends.alias("ends"))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, word hashes) to the keys of the line (pos -1) and of the line without each word.

    The hash of words h0, h1, ... is the sum of h_i B^i mod 2^64; without word i it is what stands before plus
    what stands after divided by B, so all n variants take O(n). A key is that hash plus the number of words times C.
    """
    power = np.ones(1, np.uint64)
    for b in batches:
        flat, ends = b.column(1).flatten().to_numpy().view(np.uint64), b.column(1).offsets.to_numpy()
        row, pos, key = [], [], []
        for r in range(b.num_rows):
            w = flat[ends[r] - ends[0] : ends[r + 1] - ends[0]]
            if len(w) > len(power):
                power = np.cumprod(np.full(len(w) * 2, _BASE, np.uint64)) * np.uint64(_INVERSE)
            sums = np.cumsum(w * power[: len(w)])
            whole = sums[-1]
            less = (sums - w * power[: len(w)]) + (whole - sums) * np.uint64(_INVERSE)
            n = np.full(len(w) + 1, len(w) - 1, np.uint64)
            n[0] += 1
            row.append(np.full(len(w) + 1, r))
            pos.append(np.arange(-1, len(w), dtype=np.int32))
            key.append(np.concatenate([[whole], less]) + n * np.uint64(_LENGTH))
            if sum(map(len, key)) > 1 << 18 or r == b.num_rows - 1:
                cols = [b.column(0).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(pos)), pa.array(np.concatenate(key).view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["at", "pos", "key"])
                row, pos, key = [], [], []


def _fetch(text: DataFrame, rows: DataFrame, extra: list[str]) -> DataFrame:
    """The words of given lines: rows (id, line, ...) of a checkpoint, with w added.

    Many rows are joined to the lines by shuffle, and of these only such move as a bitmap of the rows lets pass.
    """
    if rows.count() <= BROADCAST_ROWS:
        grouped = rows.groupBy("id").agg(F.collect_list(F.struct("line", *extra)).alias("want"))
        wanted = text.join(F.broadcast(grouped), "id").select("id", _lines(F.col("t")).alias("ls"), "want")
        one = wanted.select("id", F.explode(F.transform("want", lambda x: F.struct(*[x[c].alias(c) for c in ("line", *extra)], F.get("ls", x["line"]).alias("text")))).alias("x"))
        found = one.select("id", "x.*")
    else:
        lines = text.select("id", F.posexplode(_lines(F.col("t"))).alias("line", "text")).withColumn("at", F.struct("id", "line"))
        found = likely(lines, "at", rows.select(F.struct("id", "line").alias("at"))).drop("at").join(rows, ["id", "line"])
    return found.select("id", "line", *extra, words(F.lower(F.col("text"))).alias("w"))


def within_one(a: str, b: str) -> Column:
    """Whether two arrays of words are at most one substitution, insertion or deletion apart."""
    short, long = f"if(size({a}) <= size({b}), {a}, {b})", f"if(size({a}) <= size({b}), {b}, {a})"
    # the words before the first difference, then the rest must be equal from one word on
    at = f"coalesce(array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false), 0)"
    sub = f"slice({a}, {at} + 1, size({a})) = slice({b}, {at} + 1, size({b}))"
    ins = f"slice({short}, greatest({at}, 1), size({short})) = slice({long}, {at} + 1, size({long}))"
    return F.expr(f"CASE WHEN {a} = {b} THEN true WHEN size({a}) = size({b}) THEN {sub} WHEN abs(size({a}) - size({b})) = 1 THEN {ins} ELSE false END")


def find_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """The lines that go: id, line (0-based), of rows with an id, which is of any type that has an order.

    Lines are compared by their words, lower-cased. A line without words never goes. It goes if a line
    that comes earlier (by id, then place) has the same words or, where both have ``min_words``, is one word
    edit away; that earlier line may itself go, so the result depends on no order of work.
    """
    ship(df.sparkSession)
    small_hashes(df.sparkSession)
    text = df.filter(named(id_col).isNotNull()).select(named(id_col).alias("id"), named(text_col).alias("t"))
    lines = text.select("id", F.posexplode(_lines(F.col("t"))).alias("line", "s")).filter(F.ltrim("s", F.lit(SPACES)) != "")
    rows = checkpoint(_keys(lines, min_words))
    order = F.struct("id", "line")

    # Ends that different lines share: of equal lines both hashes are equal.
    end = rows.filter(F.col("ends").isNotNull()).select("h1", "h2", F.explode("ends").alias("end"))
    shared = checkpoint(end.groupBy("end").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.count("*").alias("c")).filter("a <> b").select("end", "c"))
    some = likely(end, "end", shared)
    some = some.join(F.broadcast(shared), "end") if shared.count() <= BROADCAST_ROWS else join_split(some, shared, ["end"], "c", ["h1"], hot)
    able = some.select("h1", "h2").distinct().withColumn("able", F.lit(True))
    first = rows.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    first = checkpoint(first.join(able, ["h1", "h2"], "left").filter("copies > 1 OR able"))
    # The lines that may have partners are numbered in their order, so that a number stands for a line of any id.
    place = first.filter("able").select("first.id", "first.line").distinct().orderBy("id", "line")
    place = checkpoint(place.select("id", "line", F.monotonically_increasing_id().alias("at")))

    hashed = _fetch(text, place, ["at"]).select("at", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    var = checkpoint(hashed.mapInArrow(_variants, "at long, pos int, key long"))
    # Variants that meet another. Lines that lack one position are one substitution apart; a whole line meets the
    # lines that become it by one deletion.
    lacks = F.col("pos") >= 0
    meet = checkpoint(var.groupBy("key").agg(F.min(F.when(~lacks, F.col("at"))).alias("whole"), F.min(F.when(lacks, F.col("at"))).alias("lacking"), F.count("*").alias("c")).filter("c > 1"))
    met = checkpoint(likely(var, "key", meet))
    least = checkpoint(met.filter(lacks).groupBy("key", "pos").agg(F.min("at").alias("by"), F.count("*").alias("c")).filter("c > 1"))
    beaten = join_split(met, least, ["key", "pos"], "c", ["at"], hot).select("at", "by").unionByName(
        join_split(met, meet.dropna(), ["key"], "c", ["at"], hot).select("at", F.when(lacks, F.col("whole")).otherwise(F.col("lacking")).alias("by")))
    pairs = checkpoint(beaten.filter("by < at").groupBy("at").agg(F.min("by").alias("by")))
    ends = pairs.select("at", F.col("at").alias("of"), F.lit(0).alias("end")).unionByName(pairs.select(F.col("by").alias("at"), F.col("at").alias("of"), F.lit(1).alias("end")))
    ends = checkpoint(ends.join(place, "at").select("id", "line", "of", "end"))
    words_of = _fetch(text, ends, ["of", "end"]).groupBy("of").agg(F.min_by("w", "end").alias("a"), F.max_by("w", "end").alias("b"))
    near = words_of.filter(within_one("a", "b")).select(F.col("of").alias("at")).join(place, "at").select(order.alias("first"), F.lit(True).alias("near"))

    verdict = checkpoint(first.join(near, "first", "left").filter("copies > 1 OR near").select("h1", "h2", "first", "near", "copies"))
    gone = join_split(rows.select("id", "line", "h1", "h2"), verdict, ["h1", "h2"], "copies", ["id", "line"], hot).filter((order != F.col("first")) | F.col("near"))
    return gone.select(F.col("id"), "line").distinct()


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the repeated lines taken out of its text, and n_lines and n_gone (long).

    Null texts stay null and have no lines; rows without an id are left as they are. Rows that share an id have
    their lines addressed alike, so repeated rows lose the same lines and keep the same first ones. All other
    columns stay, whatever their names; n_lines and n_gone are replaced. An empty table gives an empty result.
    Of the rows only those move whose id may have lost a line. ``df`` is read several times.
    """
    gone = checkpoint(find_repeats(df, id_col=id_col, text_col=text_col, min_words=min_words).groupBy("id").agg(F.collect_list("line").alias("gone")))
    names = [c for c in df.columns if c not in ("n_lines", "n_gone")]
    may, rest = parted(packed(df.select(*[named(c) for c in names]), id=named(id_col)), "id", gone)
    joined = may.join(gone, "id", "left").unionByName(rest.withColumn("gone", F.lit(None).cast("array<int>")))
    out = joined.withColumn("t", F.col(f"r.c{names.index(text_col)}")).withColumn("ls", F.when(F.col("t").isNotNull(), _lines(F.col("t"))))
    kept = F.array_join(F.expr("transform(array_except(sequence(0, size(ls) - 1), gone), i -> get(ls, i))"), "\n")
    text = F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept)
    n_lines, n_gone = (F.coalesce(F.size(c), F.lit(0)).cast("long") for c in ("ls", "gone"))
    cols = [text.alias(c) if c == text_col else F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)]
    return out.select(*cols, F.greatest(n_lines, F.lit(0)).alias("n_lines"), F.greatest(n_gone, F.lit(0)).alias("n_gone"))
