"""URL filter, HTML extraction, quality rules, licence scan."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_catalog import bag
from windrose.llm import catalog, html_tree, licenses, quality, url_filter


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toArrow()
    want = duck.sql(catalog.oracle_sql()[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(got.column_names) == sorted(want.column_names)
    assert bag(got, got.column_names) == bag(want, want.column_names)


URLS = [
    None, "", "no scheme", "http://", "http://WWW.Example.com/en/a?x#y", "https://example.com/en/", "https://a.example.com/en/q", "https://EXAMPLE.com/EN/q", "http://badexample.com/en/",
    "http://x.net/es/1", "http://x.net/es", "http://x.org/porn/1", "http://x.org/pornography", "http://x.org/casino?poker", "http://x.org/casino-casino", "http://x.org/xcasino/poker", "ftp://h?q://z/", "http://x.com:80/en/\nline", "http://ü.org/adult\tdating",
]


def test_urls_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [*enumerate(URLS)])
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, n_soft int")
    want = con.sql(url_filter.oracle()).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    got = url_filter.filter_urls(df).toArrow()
    assert bag(got, got.column_names) == bag(want, want.column_names)
    v = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert v[4] == ("www.example.com/en/", "allow") and v[5] == ("example.com/en/", "block") and v[6] == ("example.com/en/", "block") and v[7] == ("com/", "allow")
    assert v[9] == ("net/es/", "block") and v[10] == (None, "allow") and v[11] == (None, "block") and v[12] == (None, "allow") and v[13] == (None, "block") and v[14] == (None, "allow") and v[15] == (None, "allow")


def test_terms_from_a_file(spark, tmp_path):
    (tmp_path / "terms").write_text("strict\tBadword\nsoft one\n\nsoft two\nsoft one\n" + "".join(f"soft t{i}\n" for i in range(20_000)))
    strict, soft = url_filter.read_terms(spark, str(tmp_path / "terms"))
    assert strict == ("badword",) and len(soft) == 20_002
    urls = ["http://x.org/badword/" + "a" * 100_000, "http://x.org/one", "http://x.org/one-two", "http://x.org/t5/t19999", "http://x.org/t5t6"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(df, rules=(), strict=strict, soft=soft).orderBy("page_id").collect()] == ["block", "allow", "block", "block", "allow"]
    assert {r.verdict for r in url_filter.filter_urls(df, rules=(), strict=(), soft=()).collect()} == {"allow"}
    (tmp_path / "odd").write_text("hard x")
    with pytest.raises(ValueError):
        url_filter.read_terms(spark, str(tmp_path / "odd"))


def test_many_rules_are_refused():
    with pytest.raises(ValueError):
        url_filter.rule_match(F.lit("a"), F.lit("/"), [("allow", f"h{i}/") for i in range(url_filter.MAX_RULES + 1)])


def test_pages_against_their_articles(spark, real):
    got = {r.page_id: r.text for r in html_tree.extract(real["pages"]).collect()}
    for r in real["pages"].collect():
        m = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*(>|\Z)", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", m[1] if m else "")]
        assert got[r.page_id] == "\n".join(filter(None, blocks))


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="has-menu-x"><header><h1>Site</h1></header><nav>menu</nav>
<div id="sideBar">side</div><div class="cookie-notice">cookies</div><form><input value="x">form</form><main><article class="post"><h1>A &amp; B</h1><p>one&nbsp;<b>two
 three<p>four &#8212; five &lt;p&gt;<ul><li>x<li>y</ul><aside>aside</aside><div class="ad-box">ad</div><table><tr><td>c1<td>c2</table><blockquote>q</blockquote>
<section class="comments"><p>reader</p></section><article class="comment">reader</article><iframe src=x>frame</iframe></article></main><footer>foot</footer></body></html>"""


def test_what_is_cut_and_kept(spark):
    pages = [(0, None, PAGE, 7), (1, "http://h/", None, 7), (2, "u", "", 7), (3, "u", "just text &copy;\n more", 7), (4, "u", "<p>open", 7), (5, "u", "<article><p>cut off <b>he", 7), (5, "u", "<article><p>cut off <b>he", 7), (6, "u", "<!-- x --><div hidden>h</div><div>a<br>b</div><script>never closed <p>x", 7)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text int")).collect())
    want = {0: "A & B\none two three\nfour — five <p>\nx\ny\nc1\nc2\nq", 1: "", 2: "", 3: "just text © more", 4: "open", 5: "cut off he", 6: "a\nb"}
    assert got == sorted((i, want[i], len(want[i])) for i, *_ in pages)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_style_tree_cuts_what_a_site_repeats(spark, monkeypatch, broadcast):
    """Pages without an article: one frame on all pages of a host, other text on each."""
    monkeypatch.setattr(html_tree, "BROADCAST_NODES", broadcast)
    page = "<body><div class='top'><p>Welcome to us</p><p>Call now</p></div><div class='mid'><p>Story {0} begins</p><p>and {0} ends</p></div><div class='end'>All about us</div></body>"
    rows = [(i, "http://site/x", page.format(i)) for i in range(20)] + [(100 + i, f"http://other{i}/", page.format(i)) for i in range(3)] + [(200 + i, "http://copies/", page.format(1)) for i in range(20)]
    got = {r.page_id: r.text for r in html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} begins\nand {i} ends" for i in range(20))
    whole = "Welcome to us\nCall now\nStory {0} begins\nand {0} ends\nAll about us"
    assert all(got[100 + i] == whole.format(i) for i in range(3)) and all(got[200 + i] == whole.format(1) for i in range(20))  # nothing to compare with


def text_of(page):
    return html_tree.main_text(page)


def test_wrappers_are_no_noise():
    art = "<article><p>one two three</p></article>"
    for page in (f'<div class="has-sidebar">{art}</div>', f'<div class="layout-sidebar-right">{art}</div>', f'<form id="f">{art}</form>', f'<div class="content-with-comments"><div id="nav">{art}</div></div>', f'<header>{art}</header>'):
        assert text_of(page) == "one two three", page
    assert text_of('<article><p>a</p><section class="form-and-function"><p>b</p></section></article>') == "a\nb"
    assert text_of('<form><div class="widget"><p>the whole text of the page</p></div></form><div class="ad">buy</div>') == "the whole text of the page"
    assert text_of('<article><p>short</p><div class="post-comments"><p>a long talk of readers about it</p></div><div class="entry-header"><h2>Title</h2></div></article>') == "short\nTitle"
    assert text_of('<body><div class="site-footer">x</div><p>the text of it</p><div style="display: none">y</div></body>') == "the text of it"
    assert text_of("<p>a <b>b <i>c</b> d</i> <span class='ad'>e</span></p>") == "a b c d"


def test_deep_pages_take_little_time():
    import time

    start = time.time()
    assert text_of("<div>a" * 50_000).count("a") == 50_000 and text_of("<b>a" * 50_000) == "a" * 50_000
    html_tree.features("<div>a" * 50_000, 5)
    assert time.time() - start < 60


def test_entropies_against_brute_force(spark):
    """Each node's score from the pages' own trees, one node after the other."""
    from collections import Counter, defaultdict
    from math import log

    r = random.Random(3)
    pages = []
    for i in range(60):
        parts = "".join(f"<p>{r.choice(['same', 'often', f'p{i}', f'q{r.randrange(9)}'])}</p>" for _ in range(r.randrange(1, 4)))
        pages.append((r.randrange(3), f"<body><div class=top>{r.choice('ab')}<p>hello</p></div><article><h1>t{i % 20}</h1>{parts}</article></body>" if i % 3 else f"<body><div class=top>a<p>hello</p></div><div class=x>{parts}</div></body>"))
    pages += pages[:5]
    kids, texts, below, seen = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter)), defaultdict(set), set()
    for h, page in pages:
        blocks, nodes = html_tree.parse(page, h)
        sign = (h, "\n".join(t for _, t in blocks))
        for n in nodes[1:]:
            for x in {(h, n.id, ",".join(k.tag for k in n.kids if not k.cut))}:
                if (sign, x) not in seen:
                    seen.add((sign, x))
                    kids[h, n.id][x[2]] += 1
        for n, t in blocks:
            a = n
            while a.up is not None:
                below[h, a.id].add(n.id)
                a = a.up
            if (sign, n.id, t) not in seen:
                seen.add((sign, n.id, t))
                texts[h][n.id][t] += 1
    want = {}
    for (h, n), leaves in below.items():
        c = kids[h, n]
        m, k = sum(c.values()), len(c)
        if m < 2:
            want[h, n] = (1.0, 1.0)
            continue
        look = -sum(x / m * log(x / m, m) for x in c.values())
        logs = [log(x, m) for leaf in leaves for x in texts[h][leaf].values()]
        reads = 1 - min(1, sum(logs) / len(logs))
        want[h, n] = ((1 - 0.9**k) * look + 0.9**k * reads, reads)
    got = {(x.host, x.node & (1 << 64) - 1): (x.score, x.reads) for x in html_tree.importance(spark.createDataFrame(pages, "host long, html string")).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))


def test_style_tree_cuts_within_articles(spark):
    """A notice that all articles of a site repeat, under a name that no list has; copies and alike titles stay."""
    page = "<body><article><h1>News of {1}</h1><p>Story {0} begins</p><div class='zz9'><p>Read our terms</p></div><p>and {0} ends</p></article></body>"
    rows = [(i, "http://site/x", page.format(i, i % 2), "x") for i in range(20)]
    got = {r.page_id: r.text for r in html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, low string")).collect()}
    assert got == {i: f"News of {i % 2}\nStory {i} begins\nand {i} ends" for i in range(20)}
    copies = [(i, "http://site/x", page.format(1, 1) + f"<footer>{i}</footer>", "x") for i in range(20)]
    got = {r.text for r in html_tree.extract(spark.createDataFrame(copies, "page_id long, url string, html string, low string")).collect()}
    assert got == {"News of 1\nStory 1 begins\nRead our terms\nand 1 ends"}


def test_quality_counts(spark, make):
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "x" * 200_000, "the of " * 200_000, "l\nl\n\nl ", "#a $ %\v<b>\f é\r\x0bü"]
    rows = {r.doc_id: r for r in quality.judge(make(texts).withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("z"))).collect()}

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t or "")

    for i, t in enumerate(texts):
        w, ls = words(t), [x for x in (t or "").split("\n") if words(x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        from collections import Counter

        many = Counter(grams)
        covered = {k + d for k, g in enumerate(grams) if many[g] > 1 for d in range(3)}
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(covered)), i
        assert r.base_failed == (len(w) < 50 or 2 * len(covered) > len(w)) and (not r.kept or not r.base_failed)


def test_quality_keeps_prose_and_all_columns(make):
    prose = " ".join(f"the w{i}a of w{i}b and w{i}c to" for i in range(12))
    df = make([prose, "short", prose + " %%% ### " * 90]).withColumn("__w", F.lit(5)).withColumn("kept", F.lit("mine"))
    kept = quality.keep(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [tuple(df.first())]
    assert quality.judge(df.limit(0)).count() == 0


def test_licenses(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code\n# Licensed under the Apache License, Version 2.0\nmore"), ("a/b/y.py", "no licence words here at all"), ("a/c/d/z.py", None),
        ("e/f.py", ""), ("e/g.py", "text " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3."), ("e/COPYING", "nothing known"), ("root.txt", "plain"), (None, "Released under the MIT License."),
        ("a/c/COPYING.txt", "Licensed under CC BY-NC 4.0."), ("a/b/y.py", "no licence words here at all"),
    ]
    got = {r.path: (r.own, r.license, r.source) for r in licenses.scan(spark.createDataFrame([(*f, 1) for f in files], "path string, text string, cosine int")).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "MIT", "own"), "a/b/x.py": ("Apache-2.0", "Apache-2.0", "own"), "a/b/y.py": (None, "MIT", "inherited"), "a/c/d/z.py": (None, "CC-BY-NC-4.0", "inherited"), "a/c/COPYING.txt": ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "own"),
        "e/f.py": (None, None, None), "e/g.py": ("GPL-3.0", "GPL-3.0", "own"), "e/COPYING": (None, None, None), "root.txt": (None, None, None),
    }
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_common_licenses_and_small_tables(spark):
    """A statement that a third of the files share, and one of few files: their terms are in many texts."""
    files = [(f"a{i}/x", "code\nReleased under the MIT License.\nmore" if i % 3 == 0 else "the code under a license") for i in range(60)]
    got = {r.path: (r.own, r.cosine) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {p: ("MIT", 1.0) if "MIT" in t else (None, None) for p, t in files}
    few = [("a/LICENSE", "Released under the MIT License."), *((f"a/{i}", "plain") for i in range(3))]
    got = {r.path: (r.own, r.license) for r in licenses.scan(spark.createDataFrame(few, "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("MIT", "MIT")} | {f"a/{i}": (None, "MIT") for i in range(3)}


def test_needed_terms_rule_out_no_match():
    """Lines without a needed term of any template stay below the cosine, whatever their weights are."""
    r = random.Random(6)
    for _ in range(200):
        terms = [f"t{k}" for k in range(6)]
        n = {t: r.randrange(50) for t in terms}
        raw = {k: {t: r.random() for t in r.sample(terms, r.randrange(1, 6))} for k in range(3)}
        unit = {k: {t: w / sum(x * x for x in v.values()) ** 0.5 for t, w in v.items()} for k, v in raw.items()}
        needed = set(licenses._needed([(k, t, w) for k, v in unit.items() for t, w in v.items()], n, 0.7))
        assert all(sum(w * w for t, w in v.items() if t not in needed) ** 0.5 < 0.7 for v in unit.values())


def test_license_statements_of_documents(spark, real):
    got = {r.doc_id: r.own for r in catalog.op7_license_scan(spark, SF).collect()}
    kinds = {"apache license": "Apache-2.0", "the mit license": "MIT", "gnu general public": "GPL-3.0", "cc by-nc": "CC-BY-NC-4.0"}
    for r in real["documents"].collect():
        lines = [x.lower() for x in r.text.split("\n") if re.search("licen[sc]e", x, re.I)]
        want = {name for k, name in kinds.items() for x in lines if k in x}
        assert (got[r.doc_id] in want) if want else got[r.doc_id] is None


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() {}"""


def test_bodies_and_broken_headers(spark):
    files = [
        ("m/LICENSE", MIT), ("m/src/a.c", "int x;"), ("g/a.c", GPL), ("a/a.py", "# Licensed under the Apache License,\n# Version 2.0\nimport os"),
        ("b/a.c", "/* Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n * 1. Redistributions of source code must retain the above copyright\n *    notice, this list of conditions and the following disclaimer.\n * 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n */"),
        ("p/b.txt", "a story of the use of software and the terms of life, " * 30), ("all/x", "MIT License"), ("t/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nmore"), ("t/q/r/s.c", None),
    ]
    got = {r.path: (r.own, r.license) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["m/LICENSE"] == ("MIT", "MIT") and got["m/src/a.c"] == (None, "MIT") and got["g/a.c"][0] == "GPL-3.0" and got["a/a.py"][0] == "Apache-2.0" and got["b/a.c"][0].startswith("BSD-")
    assert got["p/b.txt"] == (None, None) and got["t/COPYING"][0] == "GPL-3.0" and got["t/q/r/s.c"] == (None, "GPL-3.0")
    apache = [(f"x{i}/f", "Licensed under the Apache License, Version 2.0") for i in range(20)]
    assert {r.own for r in licenses.scan(spark.createDataFrame(apache, "path string, text string")).collect()} == {"Apache-2.0"}
    texts = [("d/1", "Released under the MIT License."), ("d/2", "Released under the MIT License.\n" + "many other words of a long story " * 20), ("e/3", "x"), ("d/4", "y"), ("e/2", "quux " * 40 + "\nReleased under the MIT License.")]
    got = {r.path: (r.own, r.license) for r in licenses.scan(spark.createDataFrame(texts, "path string, text string"), by_text=True).collect()}
    assert got == {"d/1": ("MIT", "MIT"), "d/2": ("MIT", "MIT"), "e/2": ("MIT", "MIT"), "d/4": (None, "MIT"), "e/3": (None, None)}


def test_cosines_against_brute_force(spark):
    """Every line, run, paragraph and licence file, without any filter."""
    import math
    from collections import Counter

    r = random.Random(12)
    bits = [t for _, t in licenses.TEMPLATES] + ["the code of a use", "words that are not there", "", "#", "public license version"]
    files = []
    for i in range(40):
        ls = []
        for _ in range(r.randrange(1, 7)):
            w = r.choice(bits).split()
            k = r.randrange(len(w) + 1)
            ls += [" ".join(w)] if r.random() < 0.5 else [" ".join(w[:k]), " ".join(w[k:])]
        files.append((f"d{i % 5}/" + ("LICENSE" if i % 8 == 0 else f"f{i}"), "\n".join(ls)))
    files = list(dict(files).items())
    cut = lambda t: [x for x in re.split(r"[^\w.]+|_|\.(?![0-9])", t.lower()) if x]
    templates = licenses.TEMPLATES + licenses.BODIES
    vocabulary = {w for _, t in templates for w in cut(t)}
    n = Counter(w for _, t in files for w in set(cut(t)))
    idf = {w: math.log((1 + len(files)) / (1 + n[w])) + 1 for w in vocabulary}
    alone = math.log((1 + len(files)) / 2) + 1

    def vec(ws):
        return {w: c * idf[w] for w, c in Counter(x for x in ws if x in vocabulary).items()}

    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    tv = [(name, v, size(v)) for name, t in templates for v in [vec(cut(t))]]

    def best(ws, odd=0):
        v = vec(ws)
        d = math.sqrt(sum(x * x for x in v.values()) + odd * alone**2)
        return min(((-round(sum(x * o.get(w, 0) for w, x in v.items()) / d / m, 6), name) for name, o, m in tv), default=(0, "")) if v else (0, "")

    want = {}
    for p, t in files:
        ls = t.split("\n")
        units = [best(cut(" ".join(ls[i : i + k]))) for i in range(len(ls)) for k in range(1, 5)] + [best(cut(x)) for x in re.split(r"\n[^\w\n]*(?=\n|\Z)", t)]
        if "LICENSE" in p:
            units.append(best(cut(t), sum(w not in vocabulary for w in cut(t))))
        c, name = min(units)
        want[p] = (name, -c) if -c >= licenses.COSINE else (None, None)
    got = {x.path: (x.own, x.cosine) for x in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: o for p, (o, _) in got.items()} == {p: o for p, (o, _) in want.items()} and sum(o is not None for o, _ in want.values()) > 10
    assert all(c is None or abs(c - want[p][1]) < 1e-5 for p, (_, c) in got.items())
