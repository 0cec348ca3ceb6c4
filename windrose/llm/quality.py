"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import SPACES, words

SYMBOLS = "#*$%&|<>"
STOP_WORDS = tuple(
    "the of and to in is that it for on was as with be by are this at from or an not "
    "der die und den das mit von zu im für ist des ein eine dem sich auf nicht als auch "
    "de la le et les des en un une du que est pour dans qui par sur pas au avec "
    "el los las y del se por con no su para como lo más o pero sus al una".split()
)
#: (measure, least, most); None: no bound. A text is kept if every measure is within its bounds.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.3),
    ("stop_ratio", 0.02, None),
    ("n_stop_kinds", 2, None),
    ("dup_line_ratio", None, 0.7),
    ("repeat_word_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that the rules are made of, one row for each row of ``df``, without a shuffle.

    A column ``__row`` is carried along.

    Three-word windows are hashed to 64 bits; a window's place is packed below the hash's high bits so
    that one sort of longs brings equal windows together. The full hashes of neighbours are compared.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    carried = ["__row"] * ("__row" in df.columns)
    d = df.select(*[F.col(c) for c in carried], F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    d = d.select(*carried, id_col, "__text", words(F.col("__text")).alias("__w"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("__lines"))
    d = d.select("*", F.size("__w").cast("long").alias("n_words"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__wh"))
    d = d.select("*", F.transform(F.expr("slice(__wh, 1, greatest(int(n_words) - 2, 0))"), lambda x, i: F.xxhash64(x, F.get("__wh", i + 1), F.get("__wh", i + 2))).alias("__win"),
                 F.expr("if(n_words < 1048576, 20, 31)").alias("__b"))
    d = d.select("*", F.expr("sort_array(transform(__win, (x, i) -> shiftleft(shiftright(x, __b), __b) | i))").alias("__s"))
    place = "(shiftleft(1L, __b) - 1L)"
    same = f"coalesce(shiftright(x ^ get(__s, j {{0}} 1), __b) = 0 AND get(__win, int(x & {place})) = get(__win, int(get(__s, j {{0}} 1) & {place})), false)"
    d = d.select("*", F.expr(f"sort_array(transform(filter(__s, (x, j) -> {same.format('+')} OR (j > 0 AND {same.format('-')})), x -> x & {place}))").alias("__p"))
    stops = [w for w in dict.fromkeys(STOP_WORDS)]
    at = F.filter("__w", lambda w: F.lower(w).isin(stops))
    return d.select(
        *carried,
        id_col,
        "n_words",
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(__p, (x, j) -> least(3L, coalesce(get(__p, j + 1) - x, 3L))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        at.alias("__stops"),
        F.size(F.filter("__lines", lambda x: F.btrim(x, F.lit(SPACES)).rlike("^([-*•]|\\d+[.)])\\s"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("__lines", lambda x: F.btrim(x, F.lit(SPACES)).rlike("(\\.\\.\\.|…)$"))).cast("long").alias("n_ellipsis_lines"),
    ).withColumns({"n_stop_words": F.size("__stops").cast("long"), "n_stop_kinds": F.size(F.array_distinct(F.transform("__stops", lambda w: F.lower(w)))).cast("long")}).drop("__stops")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))


RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
}


def compile_rules(rules: Iterable[tuple[str, float | None, float | None]]) -> Column:
    """True where every measure is within its bounds."""
    tests = [F.lit(True)]
    for name, least, most in rules:
        value = _ratio(*RATIOS[name]) if name in RATIOS else F.col(name)
        tests += [value >= F.lit(least)] * (least is not None) + [value <= F.lit(most)] * (most is not None)
    return reduce(lambda a, b: a & b, tests)


def judge(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words, so they fail; texts of any length are read whole (beyond 2^31
    words Spark has no array). Repeated rows are judged alike, an empty table gives an empty result and
    other columns are ignored. One projection: no shuffle, no user function.
    """
    return _judged(measured(df, id_col, text_col), rules).select(id_col, *BASE, "base_failed", "kept")


def _judged(d: DataFrame, rules) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select("*", failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"))


def keep(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows that the rules keep, all columns as they were.

    The verdict unnests the row or nothing: a filter would be pushed below the measures and repeat them.
    """
    packed = df.select(F.struct("*").alias("__row"), F.col(id_col), F.col(text_col))
    return _judged(measured(packed, id_col, text_col), rules).select(F.explode(F.expr("if(kept, array(__row), slice(array(__row), 1, 0))")).alias("__row")).select("__row.*")


def oracle(table: str = "documents", rules=RULES) -> str:
    """The same in DuckDB's SQL, from the texts' three-word windows themselves."""
    w, stops = r"[\x20\x09-\x0D]", ", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))
    ratio = {k: f"(CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / {b} END)" for k, (a, b) in RATIOS.items()}
    tests = [f"{ratio.get(n, n)} {op} {v}" for n, least, most in rules for op, v in ((">=", least), ("<=", most)) if v is not None]
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
a AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{w}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{w}+', '', 'g') <> '') AS ls FROM t),
k AS (SELECT r, unnest(ws) AS wd, generate_subscripts(ws, 1) AS i FROM a),
g AS (SELECT r, i, wd, lead(wd, 1) OVER p AS w2, lead(wd, 2) OVER p AS w3 FROM k WINDOW p AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, wd, w2, w3) > 1 AND w3 IS NOT NULL AS dup FROM g),
m AS (SELECT r, i, dup OR coalesce(lag(dup, 1) OVER p, false) OR coalesce(lag(dup, 2) OVER p, false) AS hit
      FROM c WINDOW p AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, count(*) AS n_repeat_words FROM m WHERE hit GROUP BY r),
s AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{w}', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
             len(list_distinct(list_filter(list_transform(ws, lambda x: lower(x)), lambda x: x IN ({stops})))) AS n_stop_kinds,
             len(list_filter(ls, lambda x: regexp_matches(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^([-*•]|\\d+[.)])\\s'))) AS n_bullet_lines,
             len(list_filter(ls, lambda x: regexp_matches(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '(\\.\\.\\.|…)$'))) AS n_ellipsis_lines
      FROM a LEFT JOIN n USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(tests)} AS kept
FROM f"""
