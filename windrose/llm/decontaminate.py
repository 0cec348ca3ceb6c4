"""Benchmark decontamination: windows as long as each item, SimHash fingerprints, exact verification.

1. A word position is a hit for a length if the shingle that begins there is one of an item of that length.
   A window passes step 4 only if it shares SIMILARITY of the item's n shingles, each at a position of its own,
   so every item-sized window with that many hits is kept, wherever it begins, and dropping the others loses
   nothing.
2. Windows and items get 64-bit SimHash fingerprints of their shingles, repeats counted.
3. A multi-index finds all item fingerprints within RADIUS: of N_BLOCKS blocks at least one differs in at
   most one bit (RADIUS < 2 x N_BLOCKS), so items are listed under each block's value and its one-bit
   neighbours, and a window looks up its own block values.
4. The weighted similarity of shingle multisets, sum of minima over sum of maxima, decides.

Only built-in expressions; nothing depends on how often a passage occurs, since windows are looked up one
by one against the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import broadcast_if, checkpoint, likely, named, packed, unpacked, words

SHINGLE, SIMILARITY, RADIUS, N_BLOCKS = 5, 0.8, 19, 10
#: Bytes of a side that is broadcast, as counted; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def _hashes(w: str, k: int) -> Column:
    """64-bit hashes of all runs of k words, from an array of word hashes."""
    parts = ", ".join(["x"] + [f"get({w}, i + {j})" for j in range(1, k)])
    return F.expr(f"transform(slice({w}, 1, greatest(size({w}) - {k - 1}, 0)), (x, i) -> xxhash64({parts}))")


def _shingles(w: str, k: int) -> Column:
    """All runs of k words, joined by spaces; the whole sequence if it is shorter."""
    return F.expr(f"transform(sequence(0, greatest(size({w}) - {k}, 0)), i -> concat_ws(' ', slice({w}, i + 1, {k})))")


def with_fingerprint(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """Adds the SimHash of an array of 64-bit hashes: a bit is 1 if set in over half of them.

    Bits are counted two at a time, in the halves of a long.
    """
    df = df.select("*", F.expr(f"transform(sequence(0, 31), k -> aggregate({hashes}, 0L, (a, x) -> a + (shiftrightunsigned(x, k) & 4294967297L)))").alias("__sums"))
    count = "if(k < 32, get(__sums, k) & 4294967295L, shiftrightunsigned(get(__sums, k - 32), 32))"
    return df.select("*", F.expr(f"aggregate(sequence(0, 63), 0L, (a, k) -> a | if(2 * {count} > size({hashes}), shiftleft(1L, k), 0L))").alias(name)).drop("__sums")


def _blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of n blocks of 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_keys(fp: Column, n_blocks: int, near: bool) -> Column:
    """An array of (block, value); near: with the values one bit off."""
    keys = []
    for b, (at, n) in enumerate(_blocks(n_blocks)):
        v = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))
        keys += [F.struct(F.lit(b).alias("b"), v.bitwiseXOR(F.lit(x).cast("long")).alias("v")) for x in [0, *([1 << i for i in range(n)] if near else [])]]
    return F.array(*keys)


def _first_block(a: Column, b: Column, n_blocks: int) -> Column:
    """The first block in which two fingerprints differ by at most one bit."""
    out = F.lit(None).cast("int")
    for k, (at, n) in reversed([*enumerate(_blocks(n_blocks))]):
        off = F.bit_count(F.shiftrightunsigned(a.bitwiseXOR(b), at).bitwiseAND(F.lit((1 << n) - 1)))
        out = F.when(off <= 1, F.lit(k)).otherwise(out)
    return out


def common_count(a: str, b: str) -> Column:
    """Sum of the minima of the counts of two arrays' elements."""
    plain = f"size(array_distinct({a})) = size({a}) AND size(array_distinct({b})) = size({b})"
    many = f"aggregate(array_intersect({a}, {b}), 0, (n, s) -> n + least(size(filter({a}, x -> x = s)), size(filter({b}, x -> x = s))))"
    return F.expr(f"if({plain}, size(array_intersect({a}, {b})), {many})")


def _starts(shingle: int, similarity: float) -> Column:
    """Where windows of ``len`` words begin that hold enough of the sorted hits p.

    Any m hits in a row that span less than n positions are held by the windows that begin from n - 1 before the
    last of them to the first; what begins at or before the hit that precedes them is given by that one's run.
    """
    n = f"greatest(len - {shingle - 1}, 1)"
    m = f"greatest(int(ceil({similarity!r}D * {n} - 1e-6D)), 1)"
    runs = f"filter(sequence(0, greatest(size(p) - {m}, 0)), i -> get(p, i + {m} - 1) - get(p, i) < {n})"
    first = f"get(p, i + {m} - 1) - {n} + 1"
    return F.expr(f"flatten(transform({runs}, i -> transform(sequence(greatest({first}, coalesce(get(p, i - 1) + 1, {first})), get(p, i)), s -> struct(s AS at, len AS len))))")


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, n_blocks: int = N_BLOCKS) -> DataFrame:
    """One row for each document and benchmark item that it holds a copy of:
    id, item, first_word (0-based, of the best and then first window), n_words of the item, similarity.

    Words are lower-cased and split at ASCII white space; an item of fewer words than a shingle is one
    shingle. Null and blank texts and items match nothing, texts of any length are searched whole, equal
    windows of a document count once (the first), rows that share an id are one document, and other columns
    are ignored. Null ids are kept as one document. Empty tables give an empty result.
    """
    if radius >= 2 * n_blocks:
        raise ValueError("the block index finds fingerprints within a radius below twice its blocks")
    items = benchmark.select(F.col(item_col).alias("item"), words(F.lower(F.col(item_text_col))).alias("w")).filter("size(w) > 0")
    items = items.select("item", "w", F.size("w").alias("len"), _shingles("w", shingle).alias("sh"), F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    items = with_fingerprint(items.withColumn("hs", F.transform("sh", lambda s: F.xxhash64(s))), "hs", "fp").drop("hs", "w")
    items = checkpoint(items.withColumn("row", F.monotonically_increasing_id()))  # items may share their ids
    widths = sorted(r[0] for r in items.select(F.least("len", F.lit(shingle)).alias("k")).distinct().collect())  # at most `shingle` rows

    text = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("t"))
    found = None
    for k in widths:
        of = items.filter(F.col("len") >= k if k == shingle else F.col("len") == k)
        starts = of.select("len", F.explode(_hashes("wh", k)).alias("h")).distinct()
        seen = text.select("id", words(F.col("t")).alias("w")).select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
        seen = seen.select("id", F.posexplode(_hashes("wh", k)).alias("pos", "h"))
        hits = seen.join(broadcast_if(starts, 24 * starts.count(), BROADCAST_BYTES), "h").select("id", "pos", "len")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} {benchmark.schema[item_col].dataType.simpleString()}, first_word int, n_words int, similarity double")
    hit = found.groupBy("id", "len").agg(F.sort_array(F.collect_set("pos")).alias("p")).select("id", _starts(shingle, similarity).alias("a"))
    anchors = checkpoint(hit.filter("size(a) > 0").groupBy("id").agg(F.flatten(F.collect_list("a")).alias("anchors")))

    bytes_of = 16 * (anchors.agg(F.sum(4 + F.size("anchors"))).first()[0] or 0)
    text = text if bytes_of <= BROADCAST_BYTES else likely(text, "id", anchors)
    held = text.join(broadcast_if(anchors, bytes_of, BROADCAST_BYTES), text.id.eqNullSafe(anchors.id)).select(text.id, words(F.col("t")).alias("w"), "anchors")
    win = held.select("id", "w", F.explode("anchors").alias("a"))
    win = win.select("id", F.greatest("a.at", F.lit(0)).alias("at"), F.col("a.len").alias("len"), F.expr("slice(w, greatest(a.at, 0) + 1, greatest(least(a.len, a.len + a.at), 0))").alias("w"))
    win = win.filter("size(w) > 0").select("id", "at", "len", _shingles("w", shingle).alias("wsh"))
    win = with_fingerprint(win.withColumn("whs", F.transform("wsh", lambda s: F.xxhash64(s))), "whs", "wfp").drop("whs")
    win = checkpoint(win)  # else filters on fingerprints are pushed below them and compute them again for each bit
    index = items.select("row", "len", "fp", F.explode(block_keys(F.col("fp"), n_blocks, True)).alias("k")).select("row", "len", "fp", "k.b", "k.v")
    sizes = items.agg(F.count("*").alias("n"), F.sum(F.expr("aggregate(sh, 0L, (a, x) -> a + length(x) + 16)")).alias("b")).first()
    probe = win.select("*", F.explode(block_keys(F.col("wfp"), n_blocks, False)).alias("k")).select("id", "at", "len", "wsh", "wfp", "k.b", "k.v")
    near = probe.join(broadcast_if(index, 40 * sizes.n * (64 + n_blocks), BROADCAST_BYTES), ["len", "b", "v"]).filter(F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp"))) <= radius)
    # A pair comes from several blocks: the first block that fits keeps it, so no shuffle is needed to make pairs distinct.
    near = near.filter(F.col("b") == _first_block(F.col("wfp"), F.col("fp"), n_blocks))
    near = near.join(broadcast_if(items.select("row", "item", "sh"), sizes.b or 0, BROADCAST_BYTES), "row")
    common = common_count("wsh", "sh")
    scored = near.withColumn("common", common).withColumn("similarity", F.col("common") / (F.size("wsh") + F.size("sh") - F.col("common"))).filter(F.col("similarity") >= similarity)
    best = scored.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("at")).alias("at"), "len")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("m.at")).alias("first_word"), F.col("m.len").alias("n_words"), F.col("m.similarity").alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """The documents that hold no copy of a benchmark item, all columns as they were."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, **kw).select(named(id_col).alias("leak")).distinct()
    rows = packed(docs, id=named(id_col))
    return unpacked(rows.join(leaks, rows.id.eqNullSafe(leaks.leak), "left_anti"), docs.columns)
