"""Near-duplicates by SimHash, searched with sharded BK-trees.

Fingerprints within RADIUS agree on some two of RADIUS + 2 blocks of bits, so each distinct fingerprint goes to
one shard for every pair of blocks, keyed by those blocks' values, and no link is lost. A shard's tree is a
BK-tree: a child hangs on the edge named by its Hamming distance to the parent, and a search follows only the
edges within RADIUS of its own distance. Shards of more than SHARD fingerprints are sharded once more by the bits that
their blocks don't fix: of RADIUS + 1 parts of these one is equal. What is larger still is cut into parts, and the tree
of each part is sent to every later part's fingerprints, so no task holds more than two parts. A tree task returns
the links that join something new (a spanning forest), never all pairs, and components grow by star contraction.

Near copies by similarity (``near_copies``) are too many bits apart for blocks: at 0.8 some 10 of 64, and up to 24.
There fingerprints share a shard if they share a band of MinHash values, a shard's tree is searched within
COPY_RADIUS, and what it finds is a link only if the exact Jaccard similarity of the shingle sets suffices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import checkpoint, likely, named, packed, unpacked
from windrose.shipping import ship

SHINGLE, RADIUS, SHARD = 3, 2, 1024
#: Of near copies: shingle words, least Jaccard similarity, bits searched. Of texts of that similarity 5 in 10^8 share no band.
COPY_SHINGLE, SIMILARITY, COPY_RADIUS, BANDS, BAND_ROWS = 5, 0.8, 24, 32, 4
#: Bytes of shingle sets in a part of a shard.
PART_BYTES = 32 << 20
#: Texts that are broadcast by id to fetch their shingles; more are joined by shuffle.
BROADCAST_ROWS = 400_000
_CHUNK = 1 << 16


def simhash(text: str | None, k: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is 1 if set in over half of the XXH64 (seed 42) of the k-word shingles.

    Words are those between ASCII white space, A-Z lower-cased; repeats count; fewer than k words are one
    shingle; no words give 0.
    """
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules for both
    if not w:
        return 0
    joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]).tolist()
    if len(w) <= k:
        return xxh64_intdigest(joined, 42)
    counts, n = np.zeros(64, np.int64), len(w) - k + 1
    for at in range(0, n, _CHUNK):
        a = ([0] + ends[: n - 1])[at : at + _CHUNK] if at == 0 else ends[at - 1 : min(at + _CHUNK, n) - 1]
        z = ends[at + k - 1 : min(at + _CHUNK, n) + k - 1]
        h = np.fromiter((xxh64_intdigest(joined[i : j - 1], 42) for i, j in zip(a, z)), np.uint64, len(z))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in text], np.uint64).view(np.int64))

    return df.select(F.col(id_col).alias("id"), fp(F.col(text_col).cast("string")).alias("fp"))


class BKTree:
    """Integers under Hamming distance. node: [value, {distance: node}]"""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while d := (node[0] ^ x).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [x, {}]
                return
            node = child

    def near(self, x: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            value, kids = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                yield value
            if len(kids) > 2 * radius + 1:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
            else:
                todo += [c for e, c in kids.items() if -radius <= e - d <= radius]


def _forest(mine: list[int], other: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links within radius that join something new: among mine, or (other given) from other to mine."""
    tree, up, out = BKTree(), {}, []

    def top(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def link(x: int) -> None:
        for y in tree.near(x, radius):
            if (a := top(x)) != (b := top(y)):
                up[a] = b
                out.append((x, y))

    for x in mine:
        if other is None:
            link(x)
        tree.add(x)
    for x in other or ():
        link(x)
    return out


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << 64) - 1
        for b in batches:
            links: list[tuple[int, int]] = []
            for i, j, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                part = [[m["fp"] & mask for m in members if m["part"] == p] for p in ({i, j} if i != j else {i})]
                links += _forest(part[0], part[1] if i != j else None, radius)
            a = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp`` that connect all that are within radius."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    keep = [sum(((1 << (b - a)) - 1) << a for a, b in pair) for pair in combinations(list(zip(cuts, cuts[1:])), 2)]
    keep = [m - (1 << 64) if m >> 63 else m for m in keep]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("v")) for k, m in enumerate(keep)])).alias("s")).select("fp", "s.c", "s.v")
    sizes = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).filter("n > 1")
    free = []  # masks of each shard kind's other bits, in radius + 1 parts
    for m in keep:
        bits = [b for b in range(64) if not m >> b & 1]
        free += [sum(1 << b for b in bits[len(bits) * k // (radius + 1) : len(bits) * (k + 1) // (radius + 1)]) for k in range(radius + 1)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in free])
    finer = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda k: F.struct(k.alias("s"), F.col("fp").bitwiseAND(F.get(masks, F.col("c") * (radius + 1) + k)).alias("u")))
    same = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("u")))
    keyed = keyed.join(sizes, ["c", "v"]).select("fp", "c", "v", F.explode(F.when(F.col("n") > shard, finer).otherwise(same)).alias("f"))
    keyed = checkpoint(keyed.select("fp", F.xxhash64("c", "v", "f.s", "f.u").alias("v"), F.concat_ws(":", "c", "f.s").alias("c")))
    sizes = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / shard).cast("int")
    held = keyed.join(sizes, ["c", "v"]).select("c", "v", "fp", parts.alias("k")).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    jobs = held.select("c", "v", "fp", "part", F.explode(pairs).alias("p")).groupBy("c", "v", "p.i", "p.j").agg(F.collect_list(F.struct("fp", "part")).alias("members"))
    return jobs.select("i", "j", "members").mapInArrow(_search(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge the least node that it is connected with.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until nothing changes; both are
    aggregations and joins, and their number grows with the logarithm of the nodes.
    """
    e = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = e.select("a", "b").union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).filter("a <> b").distinct()
        e = checkpoint(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b")).distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits), component_id: the least id that is reachable, itself included.

    Null, empty and blank texts have fingerprint 0 and link to each other as any equal fingerprints do. Texts of
    any length are read whole. Rows without an id get the component of their fingerprint and never give it its
    name; a component of such rows alone has a null id. Repeated rows each give their row, equal fingerprints are
    searched once, an empty table gives an empty result and other columns are ignored.
    """
    ship(df.sparkSession)
    each = checkpoint(fingerprints(df, id_col, text_col, shingle))
    distinct = checkpoint(each.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), radius, shard))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return each.join(of, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, k: int = COPY_SHINGLE) -> np.ndarray:
    """Sorted XXH64 of the distinct k-word shingles, of words as in ``simhash``."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(np.array([xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else [], np.uint64))


def _sketches(k: int):
    """(id, text) to id, key of the shingle set, its size, SimHash of the set, MinHash bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        by = np.random.default_rng(7).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            keys, sizes, fps, bands = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, k)
                counts, least = np.zeros(64, np.int64), np.full(len(by), (1 << 64) - 1, np.uint64)
                for at in range(0, len(s), 4096):
                    h = s[at : at + 4096]
                    counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    least = np.minimum(least, (h[:, None] * by).min(axis=0))
                keys.append(xxh64_intdigest(s.tobytes(), 1))
                sizes.append(len(s))
                fps.append(np.packbits(2 * counts > len(s), bitorder="little").view("<u8")[0])
                bands.append(np.array([xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64).view(np.int64))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), signed(keys), pa.array(sizes, pa.int64()), signed(fps), pa.array(bands, pa.list_(pa.int64()))], names=["id", "key", "size", "fp", "bands"])

    return run


def _sets(k: int):
    """(key, text) to key, shingle set; texts of another key are left out: they only share the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            sets = [(key, shingle_set(t, k).tobytes()) for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            sets = [(key, x) for key, x in sets if xxh64_intdigest(x, 1) == key & (1 << 64) - 1]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.binary())], names=["key", "s"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common)


def _copies(mine: list[tuple], other: list[tuple] | None, radius: int, similarity: float) -> list[tuple[int, int]]:
    """As ``_forest``, of (key, fingerprint, set): links that are similar, too. What is one component isn't compared again."""
    tree, at, up, out = BKTree(), {}, {}, []
    trees = 0  # components among the tree's members

    def top(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def link(key: int, fp: int, s: np.ndarray) -> bool:
        nonlocal trees
        linked = False
        for f in tree.near(fp, radius):
            for k, t in at[f]:
                if (a := top(key)) != (b := top(k)) and _similar(s, t, similarity):
                    up[a] = b
                    out.append((key, k))
                    trees -= linked
                    linked = True
                    if trees == 1:
                        return True
        return linked

    for key, fp, s in mine:
        trees += not (other is None and link(key, fp, s))
        tree.add(fp)
        at.setdefault(fp, []).append((key, s))
    for x in other or ():
        link(*x)
    return out


def _verify(radius: int, similarity: float):
    """Rows (v, i, j, key, fp, part, s) that are sorted by shard and parts, to links."""

    def solve(job: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        mask = (1 << 64) - 1
        part = [[(k, fp & mask, np.frombuffer(s, np.uint64)) for k, fp, p, s in rows if p == q] for q in job[1:]]
        return _copies(part[0], part[1] if job[1] != job[2] else None, radius, similarity)

    def batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[n] for x in links], pa.int64()) for n in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, rows = None, []
        for b in batches:
            links: list[tuple[int, int]] = []
            for x in zip(*(c.to_pylist() for c in b.columns)):
                if x[:3] != job:
                    links += solve(job, rows) if rows else []
                    job, rows = x[:3], []
                rows.append(x[3:])
            yield batch(links)
        if rows:
            yield batch(solve(job, rows))

    return run


def near_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, similarity: float = SIMILARITY, radius: int = COPY_RADIUS, shard: int = SHARD) -> DataFrame:
    """id, component_id (the least id that is reachable) of the rows with an id.

    Texts are linked if their sets of ``shingle``-word shingles have Jaccard similarity ``similarity`` or more;
    fewer words are one shingle, and texts without words are equal. Rows without an id link nothing.
    """
    ship(df.sparkSession)
    text = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    each = checkpoint(text.mapInArrow(_sketches(shingle), f"id {df.schema[id_col].dataType.simpleString()}, key long, size long, fp long, bands array<long>"))
    distinct = checkpoint(each.groupBy("key").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    keyed = distinct.select("key", "least", "size", "fp", F.explode("bands").alias("v"))
    shards = keyed.groupBy("v").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.expr("bit_xor(key)").alias("x"), F.expr("bit_xor(xxhash64(key))").alias("y")).filter("n > 1")
    # Shards of the same members are searched once.
    shards = shards.groupBy("n", "size", "x", "y").agg(F.min("v").alias("v")).select("v", F.greatest(F.ceil(F.col("n") / shard), F.ceil(8 * F.col("size") / PART_BYTES)).cast("int").alias("k"))
    held = checkpoint(keyed.drop("size").join(shards, "v").withColumn("part", F.pmod(F.xxhash64("key"), F.col("k")).cast("int")))
    want = checkpoint(held.select("least", "key").distinct())
    few = want.count() <= BROADCAST_ROWS
    some = text if few else likely(text, "id", want.select(F.col("least").alias("id")))
    sets = some.join(F.broadcast(want) if few else want, F.col("id") == F.col("least")).select("key", "t").mapInArrow(_sets(shingle), "key long, s binary").dropDuplicates(["key"])
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    jobs = held.join(sets, "key").select("v", "key", "fp", "part", "s", F.explode(pairs).alias("p")).select("v", "p.i", "p.j", "key", "fp", "part", "s")
    found = jobs.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j").mapInArrow(_verify(radius, similarity), "a long, b long").distinct()
    roots = components(found)
    rooted = distinct.join(roots, distinct.key == roots.node, "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("key", "root").join(names, "root").select("key", "component_id")
    return each.select("id", "key").join(of, "key").select(F.col("id").alias(id_col), "component_id")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **kw) -> DataFrame:
    """The rows whose id names their component, all columns as they were; rows without an id stay.

    Components are those of ``near_copies`` if a similarity is given, else of ``near_duplicates``. Rows that share
    such an id all stay: they are one document.
    """
    if similarity is not None:
        of = near_copies(df, id_col=id_col, text_col=text_col, similarity=similarity, **kw)
    else:
        of = near_duplicates(df, id_col=id_col, text_col=text_col, **kw)
    of = of.filter(named(id_col) != F.col("component_id")).select(named(id_col).alias("id")).distinct()
    return unpacked(packed(df, id=named(id_col)).join(of, "id", "left_anti"), df.columns)
