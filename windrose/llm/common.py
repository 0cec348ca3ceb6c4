"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.shared import shared_dir

#: What separates words: space and the ASCII controls TAB to CR.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only, so that the result doesn't depend on a locale or on Unicode's case tables."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text as an array; empty for null and blank texts.

    Texts whose words stand one space apart are split at that character, others by the pattern.
    """
    bare = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    odd = reduce(lambda a, b: a | b, [bare.contains(x) for x in ("  ", *SPACES[1:])])
    return F.when(bare == "", F.array().cast("array<string>")).when(odd, F.split(bare, SPACE)).otherwise(F.split(bare, " "))


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes ``df`` once, into the shared folder; a lost executor costs no recomputation of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def named(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """``df``'s columns as one struct ``r``, so that their names can't clash with those of ``more``."""
    return df.select(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("r"), *[c.alias(k) for k, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], **instead: Column) -> DataFrame:
    """What ``packed`` was given, some columns replaced."""
    return df.select(*[instead.get(c, F.col(f"r.c{i}")).alias(c) for i, c in enumerate(columns)])


def _probed(left: DataFrame, key: str, wanted: DataFrame, bits: int, how: str) -> DataFrame:
    """``left`` with __maybe: whether a bitmap of hashes of ``wanted``'s keys has its key.

    The bitmap is broadcast as at most 2^(bits - 6) rows of two longs (32 MB), however many keys there are, and lets
    other keys pass with a chance of keys / 2^bits.
    """
    at = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    bit = lambda h: F.expr(f"shiftleft(1L, int({h} & 63))")
    bitmap = wanted.select(at.alias("__h")).groupBy(F.shiftrightunsigned("__h", 6).alias("__at")).agg(F.bit_or(bit("__h")).alias("__set"))
    hashed = left.withColumn("__h", at).withColumn("__at", F.shiftrightunsigned("__h", 6))
    found = F.coalesce(F.col("__set").bitwiseAND(bit("__h")) != 0, F.lit(False))
    return hashed.join(F.broadcast(bitmap), "__at", how).withColumn("__maybe", found).drop("__at", "__h", "__set")


def likely(left: DataFrame, key: str, wanted: DataFrame, bits: int = 27) -> DataFrame:
    """The rows of ``left`` whose key may be one of ``wanted``'s, before they are shuffled to be joined."""
    return _probed(left, key, wanted, bits, "inner").filter("__maybe").drop("__maybe")


def parted(left: DataFrame, key: str, wanted: DataFrame, bits: int = 27) -> tuple[DataFrame, DataFrame]:
    """The rows of ``left`` whose key may be one of ``wanted``'s, and all others."""
    probed = _probed(left, key, wanted, bits, "left")
    return probed.filter("__maybe").drop("__maybe"), probed.filter("NOT __maybe").drop("__maybe")


def join_split(left: DataFrame, right: DataFrame, keys: list[str], n: str, by: list[str], hot: int = 1_000_000) -> DataFrame:
    """An inner join to ``right``, which has one row for each key and in ``n`` how many left rows have it.

    Keys of more than ``hot`` rows are dealt to several tasks by the columns ``by``. There are no more of them than
    left has rows / hot, so they are broadcast.
    """
    parts = F.ceil(F.col(n) / hot).cast("int")
    some = right.filter(F.col(n) > hot).select(*keys, parts.alias("__parts"))
    dealt = left.join(F.broadcast(some), keys, "left").withColumn("__salt", F.when(F.col("__parts") > 0, F.pmod(F.xxhash64(*by), F.col("__parts")).cast("int")).otherwise(0)).drop("__parts")
    return dealt.join(right.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))), [*keys, "__salt"]).drop("__salt")


def small_hashes(spark: SparkSession, most: str = "64MB") -> None:
    """Lets Spark hash a join's side instead of sorting both, once it has seen that all its partitions are small."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(name, "0") in ("0", "0b", "0B"):
        spark.conf.set(name, most)


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcasts a side whose counted rows are within ``limit``; beyond, Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: int, limit: int, salt_by: list[str], salts: int = 64) -> DataFrame:
    """A left join on a key that may hold most of the left rows; right has ``rows`` rows, one for each key.

    Within ``limit`` the right side is broadcast. Beyond, it is repeated for each salt, and left rows are dealt
    by key and salt.
    """
    if rows <= limit:
        return left.join(F.broadcast(right), key, "left")
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")).join(salted, [key, "__salt"], "left").drop("__salt")
