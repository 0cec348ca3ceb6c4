"""The pipeline, stage by stage, against brute force."""

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_duplicates import leaks, repeats, shingles
from windrose.llm import pieces, quality
from windrose.llm.common import read


def test_stages(spark):
    docs = read(spark, SF, "documents")
    state = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    texts = {i: r.text for i, r in state.items() if i in kept}
    out = corpus_pipeline.quality_rules(spark, docs, SF)
    assert {r.doc_id: r.text for r in out.collect()} == texts and out.columns == list(corpus_pipeline.COLUMNS)

    gone = repeats(texts)
    cut = {i: "\n".join(s for n, s in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in texts.items()}
    texts = {i: t for i, t in cut.items() if t.strip() or not any(d == i for d, _ in gone)}
    out = corpus_pipeline.line_dedup_stage(spark, out, SF)
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {i: (t, len(t)) for i, t in texts.items()} and out.columns == list(corpus_pipeline.COLUMNS)

    sets, first = {i: set(shingles(t.lower().split())) for i, t in texts.items()}, {}
    up = {i: i for i in texts}
    for i in sorted(texts):  # texts without a shingle in common can't be near copies
        for j in {j for s in sets[i] for j in first.get(s, ())}:
            if up[i] != up[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((up[i], up[j]))
                up = {k: x if u == y else u for k, u in up.items()}
        for s in sets[i]:
            first.setdefault(s, []).append(i)
    texts = {i: texts[i] for i in set(up.values())}
    out = corpus_pipeline.simhash_stage(spark, out, SF)
    assert {r.doc_id: r.text for r in out.collect()} == texts and out.columns == list(corpus_pipeline.COLUMNS)

    items = {r.item_id: r.text for r in read(spark, SF, "benchmark").collect()}
    for d, _ in leaks({d: t for d, t in texts.items() if any(" ".join(b.lower().split()[:6]) in " ".join(t.lower().split()) or " ".join(b.lower().split()[-6:]) in " ".join(t.lower().split()) for b in items.values())}, items):
        texts.pop(d, None)
    out = corpus_pipeline.decontamination(spark, out, SF)
    assert {r.doc_id: r.text for r in out.collect()} == texts and out.columns == list(corpus_pipeline.COLUMNS)

    e = pieces.Encoder(pieces.load())
    final = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: e.decode(x) for i, x in final.items()} == texts
