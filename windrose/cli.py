"""Command line: ``ddl TEXT`` runs a script, ``run CONF.json QUERY_ID SQL`` a continuous query."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from windrose.context import StreamContext
from windrose.sinks import DictStore, KeyValueSink, ParquetStore
from windrose.streaming import ContinuousQuery


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="windrose", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    ddl = sub.add_parser("ddl", help="run a script of statements")
    ddl.add_argument("text")
    run = sub.add_parser("run", help="run a query; results go to a key/value store")
    run.add_argument("conf", help="JSON: spark (settings), setup (script), store (folder), ttl_seconds, checkpoint, once")
    run.add_argument("query_id")
    run.add_argument("sql")
    a = p.parse_args(argv)
    conf = json.load(open(a.conf)) if a.what == "run" else {}
    builder = SparkSession.builder.appName("windrose").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.get("spark", {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ctx = StreamContext(spark, conf.get("batch_interval", "1 second"))
    if a.what == "ddl":
        ctx.command(a.text)
        return 0
    spark.conf.set("spark.streaming.query.id", a.query_id)
    if conf.get("setup"):
        ctx.command(conf["setup"])
    store = ParquetStore(conf["store"]) if conf.get("store") else DictStore()
    sink = KeyValueSink(a.query_id, store, conf.get("ttl_seconds"))
    got = ctx.sql(a.sql)
    if isinstance(got, ContinuousQuery):
        trigger = {"availableNow": True} if conf.get("once") else {"processingTime": conf.get("batch_interval", "1 second")}
        got.start(sink, name=a.query_id, checkpoint=conf.get("checkpoint", f"checkpoint/{a.query_id}"), trigger=trigger).awaitTermination()
    else:
        sink.write(got, 0)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
