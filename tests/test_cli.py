"""The command line, a live socket, and what explain shows."""

import json
import socketserver
import threading
import time

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF
from windrose import StreamContext, cli
from windrose.catalog import context
from windrose.sinks import ForeachSink, MemorySink


def test_ddl(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert cli.main(["ddl", f"CREATE TEMPORARY TABLE cli_t USING parquet OPTIONS (path '{tmp_path}/t'); SET spark.app.x = 1"]) == 0
    assert spark.table("cli_t").count() == 3


def test_run(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    conf = {
        "setup": f"CREATE TEMPORARY TABLE cli_events USING parquet OPTIONS (path '{tmp_path}/in', ts 'ts', stream 'true')",
        "store": str(tmp_path / "kv"), "ttl_seconds": 60, "checkpoint": str(tmp_path / "chk"), "once": True, "batch_interval": "1 second",
    }
    (tmp_path / "conf.json").write_text(json.dumps(conf))
    text = "SELECT event_type, COUNT(*) AS n FROM cli_events OVER (WINDOW '1440' MINUTES) AS t GROUP BY event_type"
    assert cli.main(["run", str(tmp_path / "conf.json"), "q5", text]) == 0
    got = {(r.key, r.field): r.value for r in spark.read.parquet(str(tmp_path / "kv")).collect()}
    ctx = context(spark, SF)
    want = ctx.sql("SELECT event_type, COUNT(*) AS n FROM events OVER (WINDOW '1440' MINUTES) AS t GROUP BY event_type").select(F.unix_timestamp(F.col("window_end").cast("timestamp")).alias("e"), "event_type", "n")
    want = {(f"q5.{r.e}", r.event_type): str(r.n) for r in want.collect()}
    last = max(int(k.split(".")[1]) for k, _ in want)
    assert got == {k: v for k, v in want.items() if int(k[0].split(".")[1]) < last}  # the last window is still open


def test_socket(spark, tmp_path):
    class Handler(socketserver.BaseRequestHandler):
        def handle(self):
            self.request.sendall(b"a 1\nb x\nc\n")
            time.sleep(8)

    with socketserver.TCPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        ctx = StreamContext(spark)
        ctx.command(f"CREATE TEMPORARY TABLE sock (w string, n int) USING SocketTextSource OPTIONS (host '127.0.0.1', port '{server.server_address[1]}', messageToRow 'delimiter')")
        sink = MemorySink()
        q = ctx.sql("SELECT w, n FROM sock").start(sink, checkpoint=str(tmp_path / "c"))
        end = time.time() + 30
        while len(sink.rows) < 3 and time.time() < end:
            time.sleep(0.2)
        q.stop()
        server.shutdown()
    assert sorted((r.w, r.n) for r in sink.rows) == [("a", 1), ("b", None), ("c", None)]


def test_own_aggregate_function(spark):
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    ctx = context(spark, SF)
    ctx.udf.register("spread", spread)
    text = "SELECT event_type, {} AS s FROM events OVER (WINDOW '1440' MINUTES) t GROUP BY event_type"
    got, want = ctx.sql(text.format("spread(value)")), ctx.sql(text.format("MAX(value) - MIN(value)"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_plans_prune_and_push_down(spark, capsys):
    ctx = context(spark, SF)
    ctx.explain("SELECT event_id FROM events OVER (WINDOW '60' MINUTES) t WHERE t.event_type = 'view'")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in plan and "EqualTo(event_type,view)" in plan


def test_joins_shuffle_by_key_within_the_instant(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = context(spark, SF).sql("SELECT o.o_orderkey FROM orders OVER (WINDOW '2880' MINUTES) o JOIN lineitem OVER (WINDOW '2880' MINUTES) l ON o.o_orderkey = l.l_orderkey")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(o_orderkey" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_foreach(spark):
    seen = []
    ForeachSink(lambda df, n: seen.append((n, df.count()))).write(spark.range(4), 7)
    assert seen == [(7, 4)]
