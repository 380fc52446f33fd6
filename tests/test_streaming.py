"""Streams give what the batch gives."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from caselake.operators import aggregates as A
from caselake.operators.intake import route
from caselake.operators.windows import status_changes
from caselake.sources.changes import Changes, ChangesReader
from caselake.sources.views import Views
from caselake.streaming import operators as T

SF = "/root/testdata/sf0.001"


def streamed(spark, df, path, f, mode="append", parts=3):
    """Rows that f gives over df as a stream of files."""
    df.repartition(parts).write.parquet(str(path / "in"))
    name = f"t{uuid.uuid4().hex[:8]}"
    src = T.file_stream(spark, str(path / "in"), df.schema, per_trigger=1)
    q = f(src).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def intake(spark):
    return Views(spark, SF)("v_intake").select("intake_id", "firm_id", "file_hash", "status", "job_id", F.col("created_at").cast("timestamp").alias("created_at"))


def test_summary_stream_equals_batch(spark, tmp_path):
    rows = intake(spark)
    got = streamed(spark, rows.coalesce(1), tmp_path, T.nightly_summary, "complete", 1)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(T.nightly_summary(rows))


def test_dedup_stream(spark, tmp_path):
    rows = intake(spark).limit(200)
    got = streamed(spark, rows, tmp_path, lambda s: T.dedup_stream(s, ["firm_id", "file_hash"], "3650 days"))
    assert got.count() == rows.select("firm_id", "file_hash").distinct().count()


def test_job_state_stream_equals_batch(spark, tmp_path):
    rows = intake(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = streamed(spark, rows, tmp_path, T.job_state_stream, "update").toPandas()
    last = got.sort_values("failures").groupby("job_id").tail(1).set_index("job_id")
    want = T.job_state(rows).toPandas().set_index("job_id")
    assert (last.failures.sort_index() == want.failures.sort_index()).all()


def test_message_buffer(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t0 = pd.Timestamp("2024-01-01 00:00:00")
    secs = [*range(10), 50, 79, 120]
    rows = spark.createDataFrame([(1, k, (t0 + pd.Timedelta(seconds=s)).to_pydatetime()) for k, s in enumerate(secs)] + [(2, 99, (t0 + pd.Timedelta(days=1)).to_pydatetime())], "conversation_id long, message_id long, ts timestamp")
    got = streamed(spark, rows, tmp_path, T.message_batches, parts=1)
    flushed = sorted((r["n"], r["first_id"], r["last_id"], r["why"]) for r in got.filter("conversation_id = 1").collect())
    assert (10, 0, 9, "full") in flushed and (2, 10, 11, "idle") in flushed


def test_routing_stream(spark, tmp_path):
    cases = spark.createDataFrame([(1, 1, "Alpha v. Beta", "24-CV-10001")], "case_id long, firm_id long, case_name string, docket string")
    items = spark.createDataFrame([(1, 1, "1", "x"), (2, 1, "", "y")], "item_id long, firm_id long, hint string, file_name string")
    items.write.parquet(str(tmp_path / "in"))
    seen = []
    src = T.file_stream(spark, str(tmp_path / "in"), items.schema)
    q = src.writeStream.foreachBatch(lambda b, i: seen.extend(r.asDict() for r in T.route_stream(b, cases, route).collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["item_id"]: r["status"] for r in seen} == {1: "confirmed", 2: "awaiting_confirmation"}


def test_late_rows(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:55:00")], "id int, ts string")
    assert [r["id"] for r in T.late_rows(rows, "ts", "2024-01-01 01:00:00").collect()] == [1]


def test_notification_stream_equals_batch_across_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = Views(spark, SF)("v_intake").selectExpr("intake_id", "firm_id", "status", "job_id % 7 AS job_id", "CAST(created_at AS timestamp) AS created_at").orderBy("created_at", "intake_id").limit(400).toPandas()
    schema = "intake_id long, firm_id long, status string, job_id long, created_at timestamp"
    got = []
    for n in range(4):  # a run for each part; the third has late rows besides, which change nothing
        part = rows.iloc[n * 100 : n * 100 + 100]
        late = rows.iloc[:20] if n == 2 else rows.iloc[:0]
        spark.createDataFrame(pd.concat([part, late]), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = T.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        q = T.notification_stream(src).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        got.append(spark.read.parquet(str(tmp_path / "out")).count())
    want = status_changes(spark.createDataFrame(rows, schema))
    key = lambda df: sorted((r["intake_id"], r["job_id"], r["firm_id"], r["kind"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(want)
    assert 0 < got[0] < got[1] < got[2] < got[3] == want.count() < 400


def test_changes_are_read_once_by_stored_mark(spark, tmp_path):
    spark.dataSource.register(Changes)
    t = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)

    def add(ids):
        spark.createDataFrame([(i, t(i).to_pydatetime() if i >= 0 else None, f"row {i}") for i in ids], "id long, modified_at timestamp, what string").coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))

    def pull():
        src = spark.readStream.format("changes").option("column", "modified_at").load(str(tmp_path / "in"))
        q = src.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    add([1, 2, 3, -1])
    assert pull() == [1, 2, 3]
    assert pull() == [1, 2, 3]
    add([4, 5])
    add([2])  # an old row changes nothing: it lies before the mark
    add([6])
    assert pull() == [1, 2, 3, 4, 5, 6]
    assert pull() == [1, 2, 3, 4, 5, 6]
    reader = ChangesReader({"path": str(tmp_path / "in"), "column": "modified_at"}, spark.read.parquet(str(tmp_path / "in")).schema)
    last = {"mark": 1704067200_000_000 + 5 * 60_000_000}
    assert len(reader.partitions(last, reader.latestOffset())) == 1  # only the file with news is opened


def test_sketches_add_up(spark):
    rows = spark.range(60_000).selectExpr("id % 10 AS day", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS kind", "CAST(id * 7919 % 20011 AS string) AS label")
    parts = A.vocab_sketches(rows.filter("day < 5"), ["day", "kind"], "label").unionByName(A.vocab_sketches(rows.filter("day >= 5"), ["day", "kind"], "label"))
    for by in (["kind"], []):
        exact = {tuple(r[c] for c in by): r["n"] for r in rows.groupBy(*by).agg(F.countDistinct("label").alias("n")).collect()}
        got = {tuple(r[c] for c in by): r["n"] for r in A.vocab_total(parts, by).collect()}
        assert got.keys() == exact.keys() and all(abs(got[k] - exact[k]) <= 0.03 * exact[k] for k in exact)
