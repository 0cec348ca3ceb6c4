"""SentencePiece encoding and decoding with a unigram search over an Aho-Corasick automaton.

The automaton of all pieces reads a word once; at each character its output links give every piece that ends
there, and each relaxes the best score of its end from that of its start (Viterbi in a single pass). Characters
without a piece become their UTF-8 bytes' pieces. A piece never holds a space after another character, so
words are encoded on their own and remembered, within a bound.

Encoding is exact for every text: decode(encode(t)) == t. Ids are those of the best unigram path over the
vocabulary's scores (ties: see Encoder.word); a vocabulary made for merges gives other, equally valid ids than its own
library's merges would.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.shipping import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words that a worker remembers of each kind.
CACHE = 700_000
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]*")


@dataclass(frozen=True)
class Vocabulary:
    """pieces: (text, id, score) of ordinary pieces; byte_ids: of the 256 byte pieces; special: ids that aren't text."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    special: tuple[int, ...] = ()

    @property
    def byte_score(self) -> float:
        """Of one byte: below any piece, so bytes are used only where no piece fits."""
        return min((s for *_, s in self.pieces), default=0.0) - 1e4


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Vocabulary:
    """Reads a vocabulary on the driver; it must have the 256 byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(sp.get_piece_size())
    special = tuple(i for i in n if sp.is_control(i) or sp.is_unknown(i))
    byte = {sp.id_to_piece(i): i for i in n if sp.is_byte(i)}
    if len(byte) != 256:
        raise ValueError(f"{path} has {len(byte)} byte pieces, not 256; texts with other characters couldn't be encoded")
    pieces = tuple((sp.id_to_piece(i), i, sp.get_score(i)) for i in n if i not in special and not sp.is_byte(i) and not sp.is_unused(i))
    return Vocabulary(pieces, tuple(byte[f"<0x{b:02X}>"] for b in range(256)), special)


class _Words(dict):
    """Words to the bytes of their ids (int32, as the machine has them); a word that is asked for first is encoded."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, w: str) -> bytes:
        got = array("i", self.make(w)).tobytes()
        if len(w) <= 64:
            self[w] = got
        return got


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.auto = ahocorasick.Automaton()
        for text, i, score in vocabulary.pieces:
            if re.search(f"[^{SPACE}]{SPACE}", text):
                raise ValueError(f"piece {text!r} spans words")
            self.auto.add_word(text, (len(text), i, score))
        self.auto.make_automaton()
        self.byte_score = vocabulary.byte_score
        self.spaced = _Words(lambda w: self.word(SPACE + w))  # after a single space
        self.bare = _Words(self.word)
        #: No piece has a line feed, so lines are encoded on their own.
        self.by_line = not any("\n" in t for t, *_ in vocabulary.pieces)
        self.text = {i: t.replace(SPACE, " ").encode() for t, i, _ in vocabulary.pieces}
        self.text |= {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        self.text |= dict.fromkeys(vocabulary.special, b"")

    def word(self, w: str) -> list[int]:
        """The path of the highest score; of equal ones that of fewer pieces, then that whose last piece is longest."""
        n, low = len(w), self.byte_score
        best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        back, piece = [0] * (n + 1), [-1] * (n + 1)
        done = 0
        for last, (size, i, score) in self.auto.iter(w) if n else ():
            while done <= last:  # bytes first; with them every position before this one has a path
                k = 1 if w[done] < "\x80" else len(w[done].encode("utf-8", "surrogatepass"))
                s, c = best[done] + k * low, count[done] + k
                done += 1
                best[done], count[done], back[done] = s, c, done - 1
            end = last + 1
            start = end - size
            s, c = best[start] + score, count[start] + 1
            if s > best[end] or s == best[end] and (c < count[end] or c == count[end] and size > end - back[end]):
                best[end], count[end], back[end], piece[end] = s, c, start, i
        while done < n:
            k = 1 if w[done] < "\x80" else len(w[done].encode("utf-8", "surrogatepass"))
            s, c = best[done] + k * low, count[done] + k
            done += 1
            best[done], count[done], back[done] = s, c, done - 1
        out: list[int] = []
        while n:
            start = back[n]
            out += [piece[n]] if piece[n] >= 0 else [self.v.byte_ids[b] for b in reversed(w[start:n].encode("utf-8", "surrogatepass"))]
            n = start
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast("i").tolist()

    def packed(self, text: str) -> bytes:
        """The ids as int32. A space stands before the text as before every word; decoding takes it off again. A
        text's own characters that look like the space mark are written as bytes."""
        if not text:
            return b""
        for known in (self.spaced, self.bare):
            if len(known) > CACHE:
                known.clear()
        if SPACE in text:
            mark = array("i", [self.v.byte_ids[b] for b in SPACE.encode()]).tobytes()
            return mark.join(self._lines(part) for part in (" " + text).split(SPACE))
        return self._lines(" " + text)

    def _lines(self, text: str) -> bytes:
        if not self.by_line:
            return self._line(text)
        return array("i", [self.v.byte_ids[10]]).tobytes().join(map(self._line, text.split("\n")))

    def _line(self, text: str) -> bytes:
        if "  " in text or text.endswith(" "):
            return b"".join(map(self.bare.__getitem__, _WORDS.findall(text.replace(" ", SPACE))))
        first, *rest = text.split(" ")
        return (self.bare[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: list[int]) -> str:
        """Special ids are nothing; ids that aren't the vocabulary's raise KeyError."""
        out = b"".join(map(self.text.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(shared) -> Encoder:
    """One encoder for each Python worker and broadcast vocabulary."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class Shared:
    """A broadcast with a name that outlives pickling."""

    def __init__(self, spark, value: Vocabulary):
        ship(spark)
        self.of = spark.sparkContext.broadcast(value)
        self.id = blake2b(repr(value).encode("utf-8", "surrogatepass")).hexdigest()

    @property
    def value(self) -> Vocabulary:
        return self.of.value


def _encoding(shared: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # ids of many long texts at once would be large
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids = [None if t is None else e.packed(t) for t in texts]
                ok = [None if x is None else e.decode(memoryview(x).cast("i").tolist()) == t for x, t in zip(ids, texts)]
                size = [0 if x is None else len(x) // 4 for x in ids]
                flat = pa.Array.from_buffers(pa.int32(), sum(size), [None, pa.py_buffer(b"".join(x for x in ids if x))])
                null = pa.array([x is None for x in ids], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(size)], pa.int32()), flat, mask=null)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pc.if_else(null, None, pa.array(size, pa.int32())), pa.array(ok, pa.bool_())], names=["id", "ids", "n_tokens", "exact"])

    return run


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """id, ids, n_tokens, exact (whether decoding gives the text back) of every whole text.

    A null text gives nulls, an empty one no ids. Repeated rows are encoded alike, other columns are ignored
    and an empty table gives an empty result. No shuffle; a worker keeps at most CACHE words.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = Shared(df.sparkSession, load(model))
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(_encoding(shared), f"id {kind}, ids array<int>, n_tokens int, exact boolean")
    return out.withColumnRenamed("id", id_col)


def _decoding(shared: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared)
        for b in batches:
            text = [None if x is None else e.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["id", "text"])

    return run


def decode(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """id and text of arrays of ids; null for null."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = Shared(df.sparkSession, load(model))
    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(_decoding(shared), f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
