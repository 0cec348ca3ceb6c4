"""Where results go: one call for each batch of a query."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.functions import Converter, converter


class Sink(Protocol):
    def write(self, df: DataFrame, batch_id: int) -> None: ...


class MemorySink:
    """Rows on the driver, for tests and small results."""

    def __init__(self) -> None:
        self.rows, self.schema, self._batches, self._lock = [], None, {}, threading.Lock()

    def write(self, df: DataFrame, batch_id: int) -> None:
        got = df.collect()
        with self._lock:
            self.schema = df.schema
            self._batches[batch_id] = got  # a batch that is run again replaces itself
            self.rows = [r for k in sorted(self._batches) for r in self._batches[k]]


class ParquetSink:
    """A folder for each batch, so that a batch that is run again replaces itself."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


class TableSink:
    """A catalog table: columns by position, in the table's types. Overwriting is for bounded queries."""

    def __init__(self, name: str, overwrite: bool = False):
        self.name, self.overwrite = name, overwrite

    def write(self, df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        target = spark.table(self.name).schema.fields
        if len(target) != len(df.columns):
            raise ValueError(f"{self.name} has {len(target)} columns, the query {len(df.columns)}")
        typed = df.toDF(*[f"c{i}" for i in range(len(target))]).select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(target)])
        typed.write.insertInto(self.name, overwrite=self.overwrite)


class KafkaSink:
    """Messages by a converter to the first of the topics."""

    def __init__(self, options: dict[str, str], to_message: str | Converter = "delimiter"):
        self.options, self.convert = {k.lower(): v for k, v in options.items()}, converter(to_message)

    def messages(self, df: DataFrame) -> DataFrame:
        return df.select(self.convert.to_message(df).alias("value"))

    def write(self, df: DataFrame, batch_id: int) -> None:
        topic = self.options["topics"].split(",")[0].split(":")[0].strip()
        self.messages(df).write.format("kafka").option("kafka.bootstrap.servers", self.options["brokerlist"]).option("kafka.acks", "all").option("topic", topic).save()


class ConsoleSink:
    def __init__(self, rows: int = 20):
        self.rows = rows

    def write(self, df: DataFrame, batch_id: int) -> None:
        print(f"-- batch {batch_id}")
        df.show(self.rows, truncate=False)


class ForeachSink:
    """Any function of a batch and its number."""

    def __init__(self, f: Callable[[DataFrame, int], None]):
        self.write = f


class KeyValueStore(Protocol):
    def put_all(self, key: str, fields: dict[str, str], ttl_seconds: int | None) -> None: ...


class DictStore:
    """Hashes in the driver's memory."""

    def __init__(self) -> None:
        self.data: dict[str, dict[str, str]] = {}
        self.ttl: dict[str, int | None] = {}

    def put_all(self, key: str, fields: dict[str, str], ttl_seconds: int | None) -> None:
        self.data.setdefault(key, {}).update(fields)
        self.ttl[key] = ttl_seconds


class ParquetStore:
    """Hashes as rows (key, field, value, ttl_seconds) of a Parquet folder, written by the executors."""

    def __init__(self, path: str):
        self.path = path


class KeyValueSink:
    """Results as hashes: key ``<query>.<epoch seconds of the instant>``, field: all columns but the last joined by
    ``.``, value: the last. Nulls are the text ``null``. Window bounds, if there are any, make the key."""

    def __init__(self, query_id: str, store: KeyValueStore | ParquetStore, ttl_seconds: int | None = None):
        self.query_id, self.store, self.ttl = query_id, store, ttl_seconds

    def entries(self, df: DataFrame) -> DataFrame:
        at = F.col("window_end").cast("timestamp") if "window_end" in df.columns else F.current_timestamp()
        cols = [c for c in df.columns if c not in ("window_start", "window_end")]
        text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))
        field = F.concat_ws(".", *[text(c) for c in cols[:-1]]) if len(cols) > 1 else F.lit("")
        return df.select(F.concat(F.lit(self.query_id + "."), F.unix_timestamp(at).cast("string")).alias("key"), field.alias("field"), text(cols[-1]).alias("value"))

    def write(self, df: DataFrame, batch_id: int) -> None:
        rows = self.entries(df)
        if isinstance(self.store, ParquetStore):
            rows.withColumn("ttl_seconds", F.lit(self.ttl).cast("int")).write.mode("overwrite").parquet(f"{self.store.path}/batch={batch_id}")
            return
        groups: dict[str, dict[str, str]] = {}
        for r in rows.toLocalIterator():  # a partition at a time
            groups.setdefault(r.key, {})[r.field] = r.value
        for key, fields in groups.items():
            self.store.put_all(key, fields, self.ttl)
