"""Toxicity: a linear classifier that identity terms can't sway.

Features of a text are its words and their beginnings, present or not. Logistic regression is fitted to the
labels with one more term in its loss: for each labelled sentence that names a group, the group's term is
swapped for every other term of its kind, and the squared change of the score is penalised (counterfactual
logit pairing, Garg et al., 2019). Identity terms thus get equal weights, whatever they occur with.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.shipping import ship

#: Groups of terms that stand for one another in a sentence.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual"), ("black", "white", "asian", "african", "latino", "european", "american", "mexican", "chinese", "arab"),
    ("immigrants", "refugees", "migrants", "citizens", "natives"), ("immigrant", "refugee", "migrant", "citizen", "native"), ("blind", "deaf", "disabled", "elderly", "young", "old"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
#: At most so many labelled rows are fitted to; of more, those with the lowest hash of their id.
FIT_ROWS = 8_000
#: Features in fewer of the fitted texts are left out, and of the rest the most frequent so many are kept.
MIN_TEXTS, MAX_FEATURES = 4, 400_000
L2, PAIRING, STEPS = 1e-4, 1.0, 100
#: Weights nearer to 0 are noise of rare words and are set to 0, so long texts don't add them up.
PRUNE = 0.05
STEMS = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct lower-cased words of the whole text, and their first letters (marked by ``*``)."""
    w = set(_WORD.findall((text or "").lower()))
    out = {x[:n] + "*" for n in STEMS for x in w if len(x) > n}
    out |= w
    return out


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    known: dict[str, list] = field(default_factory=dict, repr=False, compare=False)  # of words met, bounded

    def score(self, text: str | None) -> float:
        """Features that a text has count once; those without a weight are never made."""
        get, known, hit = self.known.get, self.known, {}
        for x in set(_WORD.findall((text or "").lower())):
            own = get(x)
            if own is None:
                own = [(f, w) for f in sorted(features(x)) if (w := self.weights.get(f))]
                if len(known) < 500_000 and len(x) <= 64:
                    known[x] = own
            hit.update(own)
        return float(1 / (1 + np.exp(-np.clip(self.bias + math.fsum(hit.values()), -40, 40))))


def counterfactual_gap(model: Model, texts: Iterable[str | None], groups: Sequence[Sequence[str]] = IDENTITY) -> float:
    """The mean change of a text's score when one of its identity terms is swapped for another of its kind; 0 if none is named."""
    gaps = []
    for t in texts:
        low = (t or "").lower()
        for a, b in swaps(low, groups):
            gaps.append(abs(model.score(low) - model.score(re.sub(rf"(?<![^\W\d_]){a}(?![^\W\d_])", b, low))))
    return sum(gaps) / len(gaps) if gaps else 0.0


def sentences(text: str | None) -> list[str]:
    return [s for s in re.split(r"[.!?\n]+", text or "") if s.strip()]


def swaps(text: str | None, groups: Sequence[Sequence[str]] = IDENTITY) -> list[tuple[str, str]]:
    """(term, other) for the identity terms that the sentences of a text name."""
    kinds = {t: g for g in groups for t in g}
    found = {w for s in sentences((text or "").lower()) for w in _WORD.findall(s) if w in kinds}
    return [(t, o) for t in sorted(found) for o in kinds[t] if o != t]


def fit(texts: Iterable[Iterable[str]], labels: Sequence[int], pairs: Sequence[tuple[str, str]] = (), *, groups: Sequence[Sequence[str]] = IDENTITY,
        l2: float = L2, pairing: float = PAIRING, steps: int = STEPS, prune: float = PRUNE) -> Model:
    """Nesterov's method on the logistic loss, l2 and the pairing penalty.

    A swap in a sentence takes one term's features out and puts the other's in, so the score of a linear
    model changes by the difference of their weights; pairs counts how often each swap can be made. One
    label alone gives a constant score of its rate, no rows one half.
    """
    n = len(labels)
    if not n or len(set(labels)) < 2:
        return Model(0.0 if not n else 4.0 if labels[0] else -4.0)
    index: dict[str, int] = {}
    ids = [np.array(sorted(index.setdefault(f, len(index)) for f in t), np.int32) for t in texts]
    col, row = np.concatenate(ids), np.repeat(np.arange(n, dtype=np.int32), [len(i) for i in ids])
    del ids
    named = {f for g in groups for t in g for f in features(t)}
    count = np.bincount(col, minlength=len(index))
    kept = sorted((f for f, i in index.items() if count[i] >= MIN_TEXTS or f in named), key=lambda f: (-count[index[f]], f))[:MAX_FEATURES]
    vocab = {f: i for i, f in enumerate(kept)}
    to = np.full(len(index), -1, np.int32)
    to[[index[f] for f in kept]] = np.arange(len(kept))
    del index
    col = to[col]
    col, row = col[col >= 0], row[col >= 0]
    y, m = np.asarray(labels, float), len(vocab)
    # Rare features speak louder: each is scaled by its inverse text frequency.
    scale = np.log1p(n / np.bincount(col, minlength=m).clip(1)) / np.log1p(n)
    v = scale[col]
    delta = [({vocab[f]: 1.0 for f in features(a) - features(b) if f in vocab}, {vocab[f]: -1.0 for f in features(b) - features(a) if f in vocab}, c) for (a, b), c in Counter(pairs).items()]
    delta = [(np.array([*p, *q]), np.array([*p.values(), *q.values()]), c) for p, q, c in delta if p or q]
    # The rarer label weighs as much as the other, so its features are found.
    each = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, _ = _descend(row, col, v, y, each, delta, scale, l2, pairing, steps)
    # Those with a weight to speak of are fitted once more, on their own.
    big = np.abs(w * scale) >= prune
    new = np.cumsum(big) - 1
    of = big[col]
    delta = [(new[k[big[k]]], s[big[k]], c) for k, s, c in delta if big[k].any()]
    row, col, v, scale = row[of], new[col[of]], v[of], scale[big]
    w, b = _descend(row, col, v, y, each, delta, scale, l2, pairing, 3 * steps)
    names = [f for f, keep in zip(vocab, big) if keep]
    return Model(float(b), {f: float(x) for f, x in zip(names, w * scale)})


def _descend(row, col, v, y, each, delta, scale, l2: float, pairing: float, steps: int) -> tuple[np.ndarray, float]:
    n, m = len(y), len(scale)
    total = max(1, sum(c for *_, c in delta))
    # The loss curves at most as fast as its features allow, and that bounds the step.
    rate = 1 / (0.25 * _curvature(row, col, v, each / n, n, m) + l2 + 2 * pairing * bool(delta))
    w, b, pw, pb = np.zeros(m), 0.0, np.zeros(m), 0.0
    for t in range(steps):
        mom = t / (t + 3)
        uw, ub = w + mom * (w - pw), b + mom * (b - pb)
        z = np.bincount(row, uw[col] * v, n) + ub
        err = each * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        grad = np.bincount(col, err[row] * v, m) + l2 * uw
        for k, sign, c in delta:
            grad[k] += 2 * pairing * c / total * ((uw[k] * scale[k]) @ sign) * sign * scale[k] / len(k)
        pw, pb, w, b = w, b, uw - rate * grad, ub - rate * err.sum()
    return w, b


def _curvature(row, col, v, each, n: int, m: int) -> float:
    """The largest eigenvalue of X'DX, with a column of ones for the bias, by power iteration."""
    x, xb = np.ones(m) / np.sqrt(m + 1), 1 / np.sqrt(m + 1)
    size = 1.0
    for _ in range(12):
        z = (np.bincount(row, x[col] * v, n) + xb) * each
        x, xb = np.bincount(col, z[row] * v, m), z.sum()
        size = float(np.sqrt(x @ x + xb * xb))
        x, xb = x / size, xb / size
    return size * 1.05


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(b.column(k).to_pylist() for k in range(b.num_columns)))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, label) to the key, distinct features and swaps, each as one string, and the label."""
    for b in batches:
        out = [(k, " ".join(sorted(features(t))), " ".join(f"{a}:{o}" for a, o in swaps(t)), y) for k, t, y in _rows(b)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32()))], names=["k", "f", "s", "y"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, **kw) -> Model:
    """Fits to at most ``rows`` labelled texts, those whose ids have the lowest hashes; their features go to the driver.

    Rows without an id or a label of 0 or 1 are left out, and an id with two labels is taken as toxic.
    """
    ship(docs.sparkSession)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    ids = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    some = text.join(F.broadcast(ids), "__id").select(F.xxhash64("__id").alias("__k"), "__t", "__y")  # at most `rows` ids
    got = some.mapInArrow(_fit_rows, "k long, f string, s string, y int").toArrow().sort_by("k")  # sums don't depend on how tasks ended
    pairs = [tuple(x.split(":")) for s in got.column("s") for x in s.as_py().split()]
    texts = (f.as_py().split() for f in got.column("f"))
    return fit(texts, got.column("y").to_pylist(), pairs, **kw)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    return run


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every whole text; null and empty texts get the score of no features.

    The model is broadcast: its size is bounded by MAX_FEATURES. No shuffle; repeated rows are scored alike.
    """
    kind = df.schema[id_col].dataType.simpleString()
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(_scorer(shared), f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(c: Column) -> Column:
    """Rows that the classifier never learns from: crc32 of the id as text is divisible by 5."""
    return F.crc32(c.cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **kw) -> DataFrame:
    """id, held_out, score, predicted (1 if the score is 0.5 or more) of every document.

    Learns from labels of rows that aren't held out. A null id counts as held out; an empty table gives an
    empty result, no usable labels give every text the score 0.5.
    """
    model = train(docs, labels.filter(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, label_col=label_col, **kw)
    out = score(docs, model, id_col=id_col, text_col=text_col)
    return out.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
