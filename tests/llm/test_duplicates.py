"""Decontamination, line dedup, SimHash dedup against brute force."""

import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from windrose.llm import common, decontaminate, line_dedup, simhash

R = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n, r=R):
    return [r.choice(VOCAB) for _ in range(n)]


def shingles(w):
    return Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def leaks(texts, items, least=0.8):
    out = {}
    for d, t in texts.items():
        w = (t or "").lower().split()
        for i, b in items.items():
            b = (b or "").lower().split()
            sb, best = shingles(b), 0.0
            for s in range(1 - len(b), len(w)):
                x = w[max(s, 0) : max(s + len(b), 0)]
                if x and b:
                    sx = shingles(x)
                    c = sum((sx & sb).values())
                    best = max(best, c / (sum(sx.values()) + sum(sb.values()) - c))
            if best >= least:
                out[d, i] = round(best, 9)
    return out


def edited(w, n, r):
    w = list(w)
    for _ in range(n):
        k = r.randrange(len(w))
        r.choice([lambda: w.__setitem__(k, "zz"), lambda: w.insert(k, "zz"), lambda: w.pop(k)])()
    return w


def test_leaks_against_brute_force(spark, make):
    items = {i: " ".join(prose(n)) for i, n in enumerate((60, 41, 25, 14, 9, 5, 3, 1))}
    items |= {20: None, 21: " ", 22: "rep rep rep rep rep rep rep rep rep rep rep rep", 23: "Mixed Case AND\nlines of some words here"}
    texts = {}
    for i, t in items.items():
        for n in range(0, 7):
            w = (t or "").split() or ["x"]
            w = edited(w, min(n, len(w) - 1), R) if n else w
            texts[len(texts)] = " ".join(prose(R.randrange(30)) + w + prose(R.randrange(30)))
    texts |= {900: None, 901: "", 902: "\n \t", 903: " ".join(prose(20_000) + items[1].split() * 3), 904: items[23].upper(), 905: "rep " * 40}
    bench = spark.createDataFrame([*items.items()], "item_id long, text string")
    docs = make(list(texts.values()), list(texts)).withColumn("similarity", F.lit("x")).withColumn("h", F.lit(1))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_leaks(docs, bench).collect()}
    want = leaks({d: t for d, t in texts.items() if d != 903}, items)
    assert {k: v for k, v in got.items() if k[0] != 903} == want and got[903, 1] == 1.0 and len(want) > 20
    twice = docs.union(docs)
    assert decontaminate.find_leaks(twice, bench).count() == len(got)
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(texts) - {d for d, _ in got}
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == len(texts)


def test_leaks_of_windows_between_and_beside_shared_shingles(spark, make):
    """Windows that begin where no shared shingle places the item's start can be the only ones that pass."""
    w = [f"i{k}" for k in range(59)]
    pad = [f"p{k}" for k in range(30)]
    texts = [
        [*pad, "x", *w[1:29], "y", "y", *w[29:58], "x", *pad],  # two words more in the middle: the window between both parts' starts
        [*pad, *"xxxxx", *w[5:54]],  # the document ends before the copy does
        [*w[5:54], *"xxxxx", *pad],  # the document begins after the copy does
        [*pad, *w[30:], *w[:30], *pad],  # halves swapped
        [*pad, *w[:30], *pad],
    ]
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    items = {7: " ".join(w)}
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_leaks(make(list(texts.values())), spark.createDataFrame([*items.items()], "item_id long, text string")).collect()}
    assert got == leaks(texts, items) and set(got) == {(i, 7) for i in range(4)}


def test_block_index_finds_all_within_the_radius(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    pairs = []
    for b in base:
        for n in (0, 1, 5, 15, 19, 20):
            pairs.append((b, b ^ sum(1 << k for k in r.sample(range(64), n)), n))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(k, signed(a), signed(b), n) for k, (a, b, n) in enumerate(pairs)], "k int, a long, b long, n int")
    near = df.select("k", "n", F.explode(decontaminate.block_keys(F.col("a"), 10, True)).alias("x"))
    mine = df.select("k", F.explode(decontaminate.block_keys(F.col("b"), 10, False)).alias("x"))
    found = {x.k for x in near.join(mine, ["k", "x"]).collect()}
    assert found >= {k for k, (_, _, n) in enumerate(pairs) if n <= 19}
    hashes = [[r.getrandbits(63) for _ in range(n)] for n in (1, 2, 3, 100)]
    got = decontaminate.with_fingerprint(spark.createDataFrame([(h,) for h in hashes], "h array<long>"), "h", "f").collect()
    for x in got:
        assert x.f & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x.h) > len(x.h))


def test_broadcasts_are_bounded_in_bytes(spark, make, monkeypatch):
    """The same leaks where nothing may be broadcast; columns of any name stay."""
    r = random.Random(21)
    items = {i: " ".join(prose(30, r)) for i in range(6)}
    texts = [" ".join(prose(9, r) + edited(items[i % 6].split(), i % 4, r) + prose(9, r)) for i in range(24)] + [" ".join(prose(60, r))] * 3
    bench = spark.createDataFrame([*items.items(), (0, items[0])], "item_id long, text string")
    df = make(texts).withColumn("leak", F.lit(1)).withColumn("a.b", F.lit(2))
    want = leaks(dict(enumerate(texts)), items)
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
        assert {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontaminate.find_leaks(df, bench).collect()} == want
        left = decontaminate.drop_leaks(df, bench)
        assert left.columns == df.columns and {x.doc_id for x in left.collect()} == set(range(27)) - {d for d, _ in want}


def test_fingerprints_of_similar_windows_rarely_lie_beyond_the_radius():
    """Pairs of similarity 0.8 to 0.82 of 9 to 27 shingles: fewer than one in a thousand differ in more than RADIUS bits."""
    import numpy as np

    g, far, n = np.random.default_rng(4), 0, 0
    for size in (9, 18, 27, 90):
        both = next(c for c in range(size) if 5 * c >= 4 * (2 * size - c))
        for _ in range(1500):
            h = g.integers(0, 1 << 63, 2 * size - both, np.uint64) * np.uint64(2) + g.integers(0, 2, 2 * size - both, np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
            a, b = bits[:size].sum(0) * 2 > size, bits[size - both :].sum(0) * 2 > size
            far += int((a != b).sum()) > decontaminate.RADIUS
            n += 1
    assert far <= n / 1000


def one_edit(a, b, least=10):
    if a == b:
        return True
    if len(a) < least or len(b) < least or abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else (a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p:])


def repeats(texts):
    before, gone = [], set()
    for d, t in sorted(texts.items()):
        for n, line in enumerate((t or "").split("\n")):
            w = tuple(line.lower().split())
            if w:
                if any(one_edit(w, o) for o in before):
                    gone.add((d, n))
                before.append(w)
    return gone


@pytest.mark.parametrize("small", [False, True])
def test_lines_against_brute_force(spark, make, monkeypatch, small):
    """small: as if there were too much to broadcast, and most keys were hot."""
    hot = 2 if small else line_dedup.HOT
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0 if small else 10**6)
    r = random.Random(5)
    lines = [" ".join(prose(n, r)) for n in (1, 3, 9, 10, 10, 11, 12, 30, 80)] + ["same " * 12, "same " * 13, "a b c d e f g h i j k", "", "  "]
    texts = {}
    for d in range(60):
        own = []
        for _ in range(r.randrange(6)):
            w = r.choice(lines).split()
            own.append(" ".join(edited(w, r.choice([0, 0, 1, 2]), r) if len(w) > 2 else w))
        texts[d] = "\n".join(own)
    texts |= {70: None, 71: "", 72: "\n\n", 73: lines[7].upper(), 74: " ".join(prose(30_000, r)), 75: "dup line of more than ten words that stands here twice\nDUP line of more than ten words that stands here twice"}
    df = make(list(texts.values()), list(texts)).withColumn("line", F.lit(1)).withColumn("n_gone", F.lit(9)).withColumn("gone", F.lit(2)).withColumn("a.b", F.lit(3)).withColumn("__gone", F.lit(4))
    gone = repeats(texts)
    out = line_dedup.dedup_lines(df)
    rows = out.collect()
    assert out.columns == [*(c for c in df.columns if c != "n_gone"), "n_lines", "n_gone"] and {(x["gone"], x["a.b"], x["__gone"]) for x in rows} == {(2, 3, 4)}
    assert len(gone) > 60 and len(rows) == len(texts)
    for x in rows:
        t = texts[x.doc_id]
        want = None if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if (x.doc_id, n) not in gone)
        assert x.text == want and x.n_gone == sum(d == x.doc_id for d, _ in gone) and x.n_lines == (0 if t is None else t.count("\n") + 1), x.doc_id
    assert {(x.id, x.line) for x in line_dedup.find_repeats(df.union(df), hot=hot).collect()} == gone
    named = df.withColumn("doc_id", F.format_string("d%03d", "doc_id"))
    assert {(int(x.id[1:]), x.line) for x in line_dedup.find_repeats(named, hot=hot).collect()} == gone
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    assert line_dedup.dedup_lines(df.withColumn("doc_id", F.lit(None).cast("long"))).filter("n_gone > 0").count() == 0


def test_templates_with_one_changing_word_need_no_pairs(spark, make):
    df = make([f"page {i} of the long list of all the pages that there are" for i in range(300)])
    assert line_dedup.find_repeats(df).count() == 299


def test_lines_equal_by_words_whatever_their_spaces(spark, make):
    df = make(["a b c\n \t\na\tb c", " A  b c", "a b\x0b\r c\x0c", "a b c ", "a bc", "\r", "a\u00a0b c", "ab c"])
    assert sorted(map(tuple, line_dedup.find_repeats(df).collect())) == [(0, 2), (1, 0), (2, 0), (3, 0)]


def moved(df, metric):
    """What each shuffle of an executed plan has written."""
    todo, written = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        todo += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
        if p.nodeName() == "Exchange":
            written.append(p.metrics().apply(metric).value())
    return written


def test_variants_move_once(spark, make, monkeypatch):
    """Lines that share an end; of the variants few meet, so the others need not be joined."""
    r, seen = random.Random(8), []
    monkeypatch.setattr(line_dedup, "checkpoint", lambda df: (common.checkpoint(df), seen.append(df))[0])
    start = " ".join(f"w{i}" for i in range(32))
    lines = [f"{start} {' '.join(prose(32, r))} {i} end" for i in range(200)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = line_dedup.find_repeats(make([*lines, lines[7].replace(" 7 end", " 8 end"), lines[9].replace(" 9 end", " end")]))
        assert sorted(map(tuple, found.collect())) == [(200, 0), (201, 0)]
        records = sum(sum(moved(df, "shuffleRecordsWritten")) for df in [*seen, found])
        assert 202 * 66 <= records <= 2 * 202 * 66
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_texts_that_lose_lines_move(spark, make):
    r = random.Random(9)
    texts = [" ".join(prose(300, r)) + f"\n{i}" for i in range(60)]
    texts[50] += "\n3"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = line_dedup.dedup_lines(make(texts))
        assert [(x.doc_id, x.text) for x in out.collect() if x.n_gone] == [(50, texts[50][: -len("\n3")])]
        assert sum(moved(out, "dataSize")) < sum(map(len, texts)) / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def naive(t):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fps, radius):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("shard", [2, 1024])
def test_components_against_brute_force(spark, make, shard):
    r = random.Random(9)
    texts = []
    for _ in range(12):
        w = prose(r.choice([1, 2, 3, 4, 60, 400]), r)
        texts += [" ".join(edited(w, n, r) if len(w) > n else w) for n in (0, 0, 1, 1, 2)]
    texts += [None, "", " \n", "ÀB c D", "àb C d", " ".join(prose(70_000, r))]
    df = make(texts, [7 * i % 1009 for i in range(len(texts))]).withColumn("fp", F.lit(0)).withColumn("component_id", F.lit("x"))
    fps = {i: naive(t) for i, t in zip([7 * i % 1009 for i in range(len(texts))], texts)}
    want = components(fps, 2)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df, shard=shard).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps} and len(set(want.values())) < len(want) - 10
    kept = simhash.keep_one(df.union(df))
    assert sorted(x.doc_id for x in kept.collect()) == sorted([*want.values()] and sorted({*want.values()}) * 2)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    none = simhash.near_duplicates(spark.createDataFrame([(None, "q"), (3, "q"), (None, "z")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id is None, x.component_id or -1) for x in none) == [(False, 3), (True, -1), (True, 3)]


def test_links_of_dense_groups(spark):
    """Fingerprints a few bits around one, and a chain: every link's two ends meet."""
    r = random.Random(2)
    center = r.getrandbits(64)
    fps = {center ^ sum(1 << k for k in r.sample(range(64), r.randrange(4))) for _ in range(300)} | {r.getrandbits(64) for _ in range(200)}
    x = r.getrandbits(64)
    for k in range(0, 40, 2):
        x ^= 3 << k
        fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    roots = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), shard=32)).collect()
    got = {x.node & (1 << 64) - 1: x.root for x in roots}
    want = components({f: f for f in fps}, 2)
    groups = {}
    for f, c in want.items():
        groups.setdefault(c, set()).add(f)
    assert all((len({got[f] for f in g}) == 1) if len(g) > 1 else not g & set(got) for g in groups.values())
    assert len({got[f] for g in groups.values() if len(g) > 1 for f in g}) == sum(len(g) > 1 for g in groups.values())


@pytest.mark.parametrize("shard", [2, 1024])
def test_near_copies_against_brute_force(spark, make, shard):
    """The pipeline's stage: Jaccard similarity of 0.8, at which some ten bits differ."""
    r = random.Random(8)
    texts = []
    for n in (3, 30, 60, 60, 200, 400):
        w = prose(n, r)
        texts += [" ".join(edited(w, e, r) if e else w) for e in (0, 0, n // 120, n // 60, n // 45, n // 30)]
    texts += [None, "", " ".join(prose(9_000, r))]
    ids = [7 * i % 1009 for i in range(len(texts))]
    sets = {i: set(shingles((t or "").lower().split())) for i, t in zip(ids, texts)}
    up = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = up[a], up[b]
                up = {i: min(x, y) if u in (x, y) else u for i, u in up.items()}
    got = {x.doc_id: x.component_id for x in simhash.near_copies(make(texts, ids), shard=shard).collect()}
    assert got == up
    kept = simhash.keep_one(make(texts, ids).withColumn("__gone", F.lit(1)).withColumn("a.b", F.lit(2)), similarity=0.8)
    assert {x.doc_id for x in kept.collect()} == set(up.values()) < set(components({i: naive(t) for i, t in zip(ids, texts)}, 2).values())


def test_tree_against_all_pairs():
    r = random.Random(4)
    xs = [r.getrandbits(12) for _ in range(400)]
    tree = simhash.BKTree()
    for x in xs:
        tree.add(x)
    for q in range(0, 4096, 37):
        assert sorted(tree.near(q, 2)) == sorted(x for x in set(xs) if (x ^ q).bit_count() <= 2)
