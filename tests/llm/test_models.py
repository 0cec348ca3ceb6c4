"""Toxicity, SentencePiece, token counts."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from windrose.llm import catalog, pieces, token_counts, toxicity

TEXTS = [None, "", " ", "  two  spaces ", "line\nbreak\ttab\r\n", "▁mark▁ of ▁▁ spaces", "日本語 🙂 naïve\x00", "a" * 5000, "word " * 20_000, "same", "same"]


def vocabulary(scores):
    return pieces.Vocabulary(tuple((t, 300 + k, s) for k, (t, s) in enumerate(scores.items())), tuple(range(3, 259)), (0, 1, 2))


def best(word, v):
    """The highest score over all ways to cut a word, by brute force."""
    score = {t: s for t, _, s in v.pieces}
    out = None
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:k])
                at = k
        parts.append(word[at:])
        if all(p in score or len(p) == 1 for p in parts):
            s = sum(score.get(p, len(p.encode()) * v.byte_score) for p in parts)
            n = -sum(1 if p in score else len(p.encode()) for p in parts)
            out = max(out, (s, n)) if out else (s, n)
    return out


@settings(max_examples=150, deadline=None)
@given(st.text("ab▁é", min_size=1, max_size=8).map(lambda w: "▁" + w.replace("▁", "")), st.dictionaries(st.text("ab", min_size=1, max_size=4), st.integers(-9, -1).map(float), max_size=8))
def test_best_path(word, scores):
    v = vocabulary({**scores, "▁": -3.0, "▁a": -2.5})
    ids = pieces.Encoder(v).word(word)
    score = {i: s for _, i, s in v.pieces}
    got = (sum(score.get(i, v.byte_score) for i in ids), -len(ids))
    assert got == best(word, v)
    assert token_counts.Counts(v).trie([word, word[:2], word + "b"])[word] == len(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    e = pieces.Encoder(pieces.load())
    test_round_trip.encoder = e = getattr(test_round_trip, "encoder", e)
    ids = e.encode(text)
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert e.decode(ids) == text


def test_model_paths_match_the_library(real):
    """The library's own unigram search over the same pieces, where it can be set to it."""
    spm = pytest.importorskip("sentencepiece")
    raw = open(pieces.MODEL, "rb").read()
    try:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto.FromString(raw)
    except Exception:
        pytest.skip("the model can't be edited here")
    m.trainer_spec.model_type = 1
    lib = spm.SentencePieceProcessor(model_proto=m.SerializeToString())
    e = pieces.Encoder(pieces.load())
    score = {i: s for _, i, s in e.v.pieces}
    for r in real["documents"].limit(20).collect():
        for line in r.text.split("\n")[:3]:
            total = lambda ids: sum(score.get(i, e.byte_score) for i in ids)
            assert total(e.encode(line)) >= total(lib.encode(line)) - 1e-3


def test_encoding_and_counts(spark, make):
    df = make(TEXTS).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    got = {r.doc_id: r for r in pieces.encode(df).collect()}
    assert all(r.exact for i, r in got.items() if TEXTS[i] is not None) and got[0].ids is None and got[0].exact is None and got[1].ids == [] and got[9].ids == got[10].ids
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df)).collect()}
    assert back == dict(enumerate(TEXTS))
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    assert counts == {i: None if r.ids is None else len(r.ids) for i, r in got.items()}
    assert pieces.encode(df.limit(0)).count() == 0 and token_counts.count_tokens(df.limit(0)).count() == 0


def test_counts_are_lengths_of_encodings(spark):
    a = {r.doc_id: (r.n_tokens, r.exact) for r in catalog.op9_sentencepiece(spark, SF).collect()}
    b = {r.doc_id: r.n_tokens for r in catalog.op10_token_counts(spark, SF).collect()}
    assert b == {i: n for i, (n, _) in a.items()} and all(ok for _, ok in a.values())


def test_trie_scores_shared_prefixes_once():
    c = token_counts.Counts(vocabulary({"a": -1.0, "ab": -1.5}))
    c.trie(["abab", "ababa", "abb", "abab"])
    assert c.nodes == 6


def test_identity_terms_are_paired():
    """A term that stands with insults gets no weight of its own."""
    texts = [f"the women are stupid x{i}" for i in range(60)] + [f"the men are kind x{i}" for i in range(60)] + [f"they are stupid x{i}" for i in range(40)] + [f"they are kind x{i}" for i in range(40)]
    y = [1] * 60 + [0] * 60 + [1] * 40 + [0] * 40
    f = [toxicity.features(t) for t in texts]
    pairs = [p for t in texts for p in toxicity.swaps(t)]
    assert ("women", "men") in pairs and ("men", "women") in pairs
    gap = lambda m: m.score("the women are here") - m.score("the men are here")
    plain, paired = toxicity.fit(f, y, prune=0, pairing=0), toxicity.fit(f, y, pairs, prune=0, pairing=50.0)
    assert gap(plain) > 0.2 and abs(gap(paired)) < gap(plain) / 4
    assert paired.score("they are stupid") > 0.5 > paired.score("they are kind")


def test_the_gap_of_identity_terms_through_spark(spark, make):
    """Labelled sentences in which some groups are insulted more often: the penalty closes the gap, accuracy stays."""
    import random

    r = random.Random(5)
    bad, good = ("stupid", "vile", "rotten", "filthy"), ("kind", "busy", "here", "tall")
    texts, ys = [], []
    for i in range(900):
        y = i % 3 == 0
        g = r.choice(["muslims", "women"] if y and r.random() < 0.9 else ["christians", "men", "jews", "muslims", "women"])
        texts.append(f"note {r.randrange(50)} the {g} are {r.choice(bad if y else good)} and {r.choice(good)}")
        ys.append(int(y))
    docs, labels = make(texts), spark.createDataFrame([(i, 1, y) for i, y in enumerate(ys)], "doc_id long, quality int, toxic int")
    plain, paired = (toxicity.train(docs, labels, pairing=p, prune=0) for p in (0, 50.0))
    neutral = [f"the {g} are here" for g in ("muslims", "christians", "women", "men")]
    a, b = (toxicity.counterfactual_gap(m, neutral) for m in (plain, paired))
    assert a > 0.01 and b < a / 10, (a, b)
    for m in (plain, paired):
        assert sum((m.score(t) >= 0.5) == bool(y) for t, y in zip(texts, ys)) >= 0.97 * len(ys)


def test_vocabularies_that_differ_in_between_share_no_encoder(spark):
    a, b = (pieces.Shared(spark, vocabulary({"a": -1.0, x: -2.0, "z": -3.0})) for x in ("b", "c"))
    assert a.id != b.id and a.id == pieces.Shared(spark, vocabulary({"a": -1.0, "b": -2.0, "z": -3.0})).id


def test_long_words_are_not_remembered():
    c = token_counts.Counts(vocabulary({"a": -1.0}))
    assert c.count(["x " + "a" * 500, "a a"]) == [c.count(["x " + "a" * 500])[0], c.count(["a a"])[0]]
    assert max(map(len, [*c.spaced, *c.bare])) <= token_counts.LONG


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in catalog.op5_toxicity(spark, d).collect()]
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows) and len(held) > 500
    bad, good = [r.score for r in held if labels[r.doc_id]], [r.score for r in held if not labels[r.doc_id]]
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.97 and sum(s >= 0.5 for s in good) <= 0.01 * len(good) and sum(s >= 0.5 for s in bad) >= 0.7 * len(bad)


def test_toxicity_without_labels_and_with_odd_rows(spark, make):
    df = make([None, "", "x " * 50_000, "a", "a"]).withColumn("score", F.lit("z"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.classify(df, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 7)], none.schema)
    assert toxicity.classify(df, odd).count() == 5 and toxicity.classify(df.limit(0), none).count() == 0
    null_id = toxicity.classify(make(["q"]).withColumn("doc_id", F.lit(None).cast("long")), none).first()
    assert null_id.held_out is True
