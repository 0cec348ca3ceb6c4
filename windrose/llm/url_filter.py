"""URL filtering: a rule table of hosts and paths, then a weighted vocabulary scanned by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.llm.common import LOWER, UPPER, ascii_lower
from windrose.shipping import ship

#: One of these as a word of the url is enough.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "escorts", "hardcore-sex", "child-abuse", "warez", "keygen", "malware-download", "buy-viagra", "online-casino")
#: Of these, several different ones are needed.
SOFT = ("adult", "sex", "sexy", "nude", "casino", "poker", "betting", "gamble", "slots", "bingo", "viagra", "pills", "dating", "webcam", "torrent", "crack", "serial", "payday", "loans", "replica")
MIN_SOFT = 2
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rules are compiled into one expression, so their number is bounded.
MAX_RULES = 2000
#: Terms of a vocabulary; it is broadcast.
MAX_TERMS = 1_000_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; "" for null or no ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; "" for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none fits.

    A rule is ``host/path``; it fits its host and all subdomains where the url's path starts with the
    rule's. Among rules of one length the later in text order comes last, so results don't depend on
    the order in which they are given.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled into a plan")
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        h, _, p = text.partition("/")
        h = h.translate(str.maketrans(UPPER, LOWER))
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def read_terms(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms from a text file that Spark can read: a weight (strict or soft), white space and a term in
    each line. Lines of another form are an error; there may be MAX_TERMS."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+", 2).alias("v")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS or any(len(r.v) != 2 or r.v[0] not in ("strict", "soft") for r in rows):
        raise ValueError(f"{path}: at most {MAX_TERMS} lines of 'strict TERM' or 'soft TERM'")
    return tuple(tuple(dict.fromkeys(r.v[1].translate(_FOLD) for r in rows if r.v[0] == kind)) for kind in ("strict", "soft"))


class Terms:
    """A broadcast vocabulary; each worker builds its automaton once."""

    def __init__(self, spark: SparkSession, strict: Iterable[str], soft: Iterable[str]):
        terms = tuple(strict), tuple(soft)
        self.of, self.id = spark.sparkContext.broadcast(terms), blake2b(repr(terms).encode()).hexdigest()

    def automaton(self):
        if self.id not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[self.id] = automaton(*self.of.value)
        return _AUTOMATA[self.id]


_AUTOMATA: dict[str, object] = {}


def automaton(strict: Iterable[str], soft: Iterable[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, terms in ((0, soft), (1, strict)):  # a term of both lists is strict
        for t in terms:
            a.add_word(t, (kind, len(t), t))
    a.make_automaton()
    return a


_EDGE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_FOLD = str.maketrans(UPPER, LOWER)


def scan(url: str | None, terms) -> tuple[int, int]:
    """Distinct strict and soft terms that stand in the url with no ASCII letter or digit on either side."""
    if not url or not len(terms):
        return 0, 0
    url = url.translate(_FOLD)
    found: set[tuple[int, str]] = set()
    for end, (kind, n, term) in terms.iter(url):
        start = end - n + 1
        if (start == 0 or url[start - 1] not in _EDGE) and (end + 1 == len(url) or url[end + 1] not in _EDGE):
            found.add((kind, term))
    n_strict = sum(kind for kind, _ in found)
    return n_strict, len(found) - n_strict


def term_hits(shared: Terms):
    """A Pandas UDF of a url: struct of n_strict and n_soft."""

    @F.pandas_udf("n_strict int, n_soft int")
    def hits(url: pd.Series) -> pd.DataFrame:
        terms = shared.automaton()
        return pd.DataFrame([scan(u, terms) for u in url], columns=["n_strict", "n_soft"], dtype="int32")

    return hits


def filter_urls(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """Judges every url: id, host, path, rule, verdict, n_strict, n_soft.

    A fitting rule decides; without one, one strict term or ``min_soft`` distinct soft terms block. A url
    that is null, empty or without ``://`` has empty host and path and no rule; its terms still count
    (none for null). Repeated rows are judged alike, an empty table gives an empty result, and columns
    other than the two named are ignored. Urls of any length are scanned whole, in one pass. One projection, no shuffle.
    """
    ship(df.sparkSession)
    one = df.select(F.col(id_col).alias(id_col), F.col(url_col).alias("__url"))
    seen = one.select(id_col, url_host(F.col("__url")).alias("host"), url_path(F.col("__url")).alias("path"), term_hits(Terms(df.sparkSession, strict, soft))(F.col("__url")).alias("__hits"))
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("__hits.n_strict") > 0) | (F.col("__hits.n_soft") >= min_soft), F.lit("block")).otherwise(F.lit("allow"))
    return seen.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("__hits.n_strict").alias("n_strict"), F.col("__hits.n_soft").alias("n_soft"))


def oracle(table: str = "pages", rules=RULES, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT) -> str:
    """The same in DuckDB's SQL, with one regular expression for each term."""
    fold = f"translate(url, '{UPPER}', '{LOWER}')"
    hit = lambda t: f"CAST(regexp_matches({fold}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)"
    count = lambda terms: "coalesce(" + " + ".join(map(hit, terms)) + ", 0)"
    rule, verdict = "NULL", "NULL"
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        h, _, p = text.partition("/")
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    return f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                  {count(strict)} AS n_strict, {count([t for t in soft if t not in strict])} AS n_soft
           FROM {table})
SELECT page_id, host, path, {rule} AS rule,
       coalesce({verdict}, CASE WHEN n_strict > 0 OR n_soft >= {min_soft} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n_strict AS INT) AS n_strict, CAST(n_soft AS INT) AS n_soft
FROM u"""
