"""Sources: options of CREATE TABLE to Spark's readers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from windrose.functions import converter


class SourceError(ValueError):
    """A source whose options are incomplete."""


def _need(options: dict[str, str], *names: str) -> None:
    missing = [n for n in names if not options.get(n)]
    if missing:
        raise SourceError(f"the source needs {', '.join(missing)}")


def _typed(raw: DataFrame, schema: StructType | None, options: dict[str, str], default: str) -> DataFrame:
    if schema is None:
        raise SourceError("a source of messages needs a column list")
    convert = converter(options.get("messagetorow") or default)
    extra = [F.col("timestamp")] if "timestamp" in raw.columns and "timestamp" not in schema.names else []
    return raw.select(*convert.to_row(F.col("value").cast("string"), schema), *extra)


def kafka_options(options: dict[str, str], query_id: str | None = None) -> dict[str, str]:
    """Options of the stream reader. topics: ``name:threads,...`` (threads have no meaning here); kafkaParams:
    ``key:value,...``; the query id, if there is one, names the consumer group instead of groupId."""
    _need(options, "topics", "brokerlist")
    out = {"kafka.bootstrap.servers": options["brokerlist"], "subscribe": ",".join(t.split(":")[0].strip() for t in options["topics"].split(","))}
    group = query_id or options.get("groupid")
    if group:
        out["kafka.group.id"] = group
    for pair in filter(None, options.get("kafkaparams", "").split(",")):
        k, _, v = pair.partition(":")
        out[f"kafka.{k.strip()}"] = v.strip()
    return out | {k: options[k] for k in ("startingoffsets", "maxoffsetspertrigger", "failondataloss") if k in options}


def _kafka(spark: SparkSession, schema: StructType | None, options: dict[str, str]) -> DataFrame:
    _need(options, "messagetorow")
    raw = spark.readStream.format("kafka").options(**kafka_options(options, spark.conf.get("spark.streaming.query.id", None))).load()
    return _typed(raw.select("value", "timestamp"), schema, options, "delimiter")


def _socket(spark: SparkSession, schema: StructType | None, options: dict[str, str]) -> DataFrame:
    _need(options, "host", "port", "messagetorow")
    return _typed(spark.readStream.format("socket").option("host", options["host"]).option("port", options["port"]).option("includeTimestamp", "true").load(), schema, options, "delimiter")


def _text(spark: SparkSession, schema: StructType | None, options: dict[str, str]) -> DataFrame:
    _need(options, "path")
    stream = options.get("stream", "true").lower() != "false"
    reader = (spark.readStream if stream else spark.read).options(**{k: v for k, v in options.items() if k in ("maxfilespertrigger", "wholetext")})
    return _typed(reader.text(options["path"]), schema, options, "delimiter")


def _files(kind: str) -> Callable[[SparkSession, StructType | None, dict[str, str]], DataFrame]:
    def load(spark: SparkSession, schema: StructType | None, options: dict[str, str]) -> DataFrame:
        _need(options, "path")
        stream = options.get("stream", "false").lower() == "true"
        rest = {k: v for k, v in options.items() if k not in ("path", "stream", "ts")}
        if stream and schema is None:
            schema = spark.read.format(kind).options(**rest).load(options["path"]).schema
        reader = (spark.readStream if stream else spark.read).format(kind).options(**rest)
        return (reader.schema(schema) if schema is not None else reader).load(options["path"])

    return load


def _rate(spark: SparkSession, schema: StructType | None, options: dict[str, str]) -> DataFrame:
    return spark.readStream.format("rate").options(**{k: v for k, v in options.items() if k != "ts"}).load()


PROVIDERS: dict[str, Callable[[SparkSession, StructType | None, dict[str, str]], DataFrame]] = {
    "kafka": _kafka, "socket": _socket, "sockettext": _socket, "text": _text, "rate": _rate,
    "json": _files("json"), "parquet": _files("parquet"), "csv": _files("csv"), "orc": _files("orc"),
}


def _key(provider: str) -> str:
    """Of a dotted name the last part counts, with or without ``Source``."""
    key = provider.split(".")[-1].strip("`").lower()
    return key if key in PROVIDERS else key.removesuffix("source")


def is_live(provider: str) -> bool:
    """Whether the provider's tables are streams that Spark's own CREATE TABLE doesn't know."""
    return _key(provider) in ("kafka", "socket", "sockettext", "rate") or "." in provider and _key(provider) in PROVIDERS


def open_source(spark: SparkSession, provider: str, schema: StructType | None, options: dict[str, str]) -> DataFrame:
    load = PROVIDERS.get(_key(provider))
    if load is None:
        return _files(provider)(spark, schema, {k.lower(): v for k, v in options.items()})
    return load(spark, schema, {k.lower(): v for k, v in options.items()})


def replay(spark: SparkSession, df: DataFrame, folder: str, batches: int, order_by: str, last: DataFrame | None = None) -> DataFrame:
    """A stream that brings a bounded table in ``batches`` parts by order of a column, a part a trigger.

    Each part is as many files as tasks write it, so that large tables aren't written by one. last: rows of one more
    part, such as one whose time lies past all windows and so closes them.
    """
    at = [x for x in df.select(F.percentile_approx(order_by, [k / batches for k in range(1, batches)], 10_000)).first()[0] or []] if batches > 1 else []
    files = max(1, min(df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    for k, (low, high) in enumerate(zip([None, *at], [*at, None]), 1):  # (low, high]; a null is in the first part
        part = df if low is None else df.filter(F.col(order_by) > F.lit(low))
        part = part if high is None else part.filter((F.col(order_by) <= F.lit(high)) | (F.col(order_by).isNull() if low is None else F.lit(False)))
        _write(part.repartition(files) if files > 1 else part.coalesce(1), folder)
        for _ in range(k * files - _files_in(spark, folder)) if files > 1 else ():  # tasks without rows write no file
            _write(spark.createDataFrame([], df.schema), folder)
    if last is not None:
        _write(last.coalesce(1), folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _write(df: DataFrame, folder: str) -> None:
    """Streams take files by their time, so in the order of writing."""
    df.write.mode("append").parquet(folder)
    time.sleep(0.01)


def _files_in(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sum(f.getPath().getName().endswith(".parquet") for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
