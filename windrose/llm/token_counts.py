"""Token counts of texts by dynamic programming over a trie of their words.

The distinct new words of a batch are sorted, which walks their trie depth first: what two neighbours share
at their start is one path. The forward scores of a unigram model (best score and its number of tokens at
each depth) depend on the prefix alone, so they are computed once for each node; where a word ends, its
node stores the count. A text's count is the sum of its words' counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.pieces import _WORDS, MODEL, SPACE, Shared, Vocabulary, load

#: Words that a worker remembers of each kind, of at most so many characters; characters of texts whose new words go
#: into one trie.
CACHE, LONG, CHARS = 1_000_000, 64, 4_000_000


class Counts:
    def __init__(self, vocabulary: Vocabulary):
        #: Every end of a piece; its score if it is a piece itself, else None.
        self.ends: dict[str, float | None] = {t[k:]: None for t, *_ in vocabulary.pieces for k in range(1, len(t))}
        self.ends |= {t: s for t, _, s in vocabulary.pieces}
        self.byte_score = vocabulary.byte_score
        self.by_line = not any("\n" in t for t, *_ in vocabulary.pieces)
        self.spaced: dict[str, int] = {}  # of words after a single space
        self.bare: dict[str, int] = {}
        self.nodes = 0  # trie nodes scored so far

    def trie(self, words: Iterable[str]) -> dict[str, int]:
        """The number of tokens of each word; nodes below a shared prefix start from its scores."""
        out: dict[str, int] = {}
        best, count = [0.0], [0]  # score and tokens of the best path to each depth
        last, ends, low = "", self.ends.get, self.byte_score
        for w in sorted(words):
            shared = len(commonprefix((last, w)))
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                c = w[end - 1]
                n = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                s, k = best[-1] + n * low, count[-1] + n
                for start in range(end - 1, -1, -1):
                    got = ends(w[start:end], "")
                    if got == "":
                        break  # no piece ends like this
                    if got is not None:
                        new = best[start] + got
                        if new > s or new == s and count[start] + 1 < k:
                            s, k = new, count[start] + 1
                best.append(s)
                count.append(k)
            self.nodes += len(w) - shared
            out[w] = count[-1]
            last = w
        return out

    def _words(self, text: str) -> tuple[list[str], list[str], int]:
        """Words after a single space, other words (with their own space marks), and tokens beside them.

        A literal space mark is three bytes, as in encoding.
        """
        spaced: list[str] = []
        bare: list[str] = []
        parts = (" " + text).split(SPACE)
        more = 3 * (len(parts) - 1)
        for part in parts:
            lines = part.split("\n") if self.by_line else [part]
            more += len(lines) - 1
            for line in lines:
                if "  " in line or line.endswith(" "):
                    bare += _WORDS.findall(line.replace(" ", SPACE))
                else:
                    first, *rest = line.split(" ")
                    bare.append(first)
                    spaced += rest
        return spaced, bare, more

    def count(self, texts: list[str | None]) -> list[int | None]:
        """Of each text; null for null. All new words of the texts share one trie."""
        cut = [self._words(t) if t else None for t in texts]
        once: list[tuple[dict[str, int], str]] = []  # long words are forgotten again
        for k, known, mark in ((0, self.spaced, SPACE), (1, self.bare, "")):
            if len(known) > CACHE:
                known.clear()
            new = set(chain.from_iterable(c[k] for c in cut if c)).difference(known)
            known |= {w[len(mark) :]: n for w, n in self.trie([mark + w for w in new]).items()}
            once += [(known, w) for w in new if len(w) > LONG]
        spaced, bare = self.spaced.__getitem__, self.bare.__getitem__
        out = [(None if t is None else 0) if c is None else sum(map(spaced, c[0])) + sum(map(bare, c[1])) + c[2] for t, c in zip(texts, cut)]
        for known, w in once:
            del known[w]
        return out


_COUNTS: dict[str, Counts] = {}


def _counting(shared: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.id not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[shared.id] = Counts(shared.value)
        counts = _COUNTS[shared.id]
        for b in batches:
            out: list[int | None] = []
            some: list[str | None] = []
            size = 0
            for t in b.column(1):
                some.append(t.as_py())
                size += len(some[-1] or "")
                if size > CHARS:
                    out += counts.count(some)
                    some, size = [], 0
            out += counts.count(some)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["id", "n_tokens"])

    return run


def count_tokens(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """id and n_tokens (long) of every whole text: as many as encoding gives ids.

    Null for a null text, 0 for an empty one. Repeated rows count alike, other columns are ignored and an empty
    table gives an empty result. No shuffle; memory is bounded by CACHE and one batch's words.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = Shared(df.sparkSession, load(model))
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(_counting(shared), f"id {kind}, n_tokens long")
    return out.withColumnRenamed("id", id_col)
