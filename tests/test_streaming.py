from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallymark.streaming.cache import drain_lookup_cache, lookup_cache_batch
from tallymark.streaming.drain import drain_append, drain_complete
from tallymark.streaming.metrics import stream_latency_windows, stream_threshold_counts, sweep_on_read

START = datetime(2024, 1, 1)


def files(spark, tmp_path, batches, schema):
    """One Parquet file per batch, read one file per trigger in the order written."""
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)


def test_cache_over_batches(spark, tmp_path):
    def at(minutes, request, handle, status):
        return (request, "github", handle, START + timedelta(minutes=minutes), status)

    schema = "request_id long, source string, handle string, ts timestamp, status string"
    stream = files(
        spark,
        tmp_path,
        [
            # Out of order inside the batch; a timeout is not stored; a blank handle is no request.
            [at(10, 2, "Bob", "error"), at(0, 1, "bob", "ok"), at(3, 9, "", "ok"), at(0, 3, "eve", "timeout")],
            [at(30, 4, "eve", "not_found"), at(60, 5, "BOB", "not_found")],
            # 61 minutes after the store: a hit did not renew it.
            [at(61, 6, "bob", "not_found"), at(90, 7, "eve", "ok"), at(100, 8, "bob", "ok")],
        ],
        schema,
    )
    run = drain_lookup_cache(stream)
    out = {r.request_id: (r.status, r.cached) for r in run.rows.collect()}
    assert out == {
        1: ("ok", False), 2: ("ok", True), 3: ("timeout", False),
        4: ("not_found", False), 5: ("ok", True), 6: ("not_found", False),
        7: ("not_found", True), 8: ("not_found", True),
    }
    # eve's result of minute 30 ended with minute 90, before the last request; bob's of minute 61 did not.
    assert {(r.handle, r.status) for r in run.state.collect()} == {("bob", "not_found")}


def test_expired_results_leave_no_state(spark, tmp_path):
    schema = "request_id long, source string, handle string, ts timestamp, status string"
    batches = [
        [(i, "github", f"user{i}", START + timedelta(minutes=i), "ok") for i in range(50)],
        [(99, "github", "late", START + timedelta(hours=9), "ok")],
        [(100, "github", "user3", START + timedelta(hours=9, minutes=1), "not_found")],
    ]
    run = drain_lookup_cache(files(spark, tmp_path, batches, schema))
    assert {(r.handle, r.status) for r in run.state.collect()} == {("late", "ok"), ("user3", "not_found")}
    assert not [r for r in run.rows.collect() if r.cached]


def test_a_hot_key_is_walked_in_arrow_batches(spark):
    """A key over many Arrow batches gives what a loop over its requests gives."""
    rows = [(i, "s" if i % 3 else None, "Hot", START + timedelta(seconds=(i * 7919) % 20_000), ("ok", "error", "not_found")[i % 3 if i % 5 else 1]) for i in range(4000)]
    requests = spark.createDataFrame(rows, "request_id long, source string, handle string, ts timestamp, status string")
    held = spark.createDataFrame([("s", "hot", START.timestamp() - 500.0, "not_found")], "source string, handle string, at double, status string")
    expected, left = {}, {}
    for source in ("s", None):
        at, result = (START.timestamp() - 500.0, "not_found") if source else (None, None)
        for i, _, _, ts, status in sorted((r for r in rows if r[1] == source), key=lambda r: (r[3], r[0])):
            second = ts.timestamp()
            if at is not None and second - at <= 900:
                expected[i] = (result, True)
                continue
            expected[i] = (status, False)
            if status in ("ok", "not_found"):
                at, result = second, status
        left[source] = (at, result)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = lookup_cache_batch(requests, held, 900.0, 10_000.0).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.request_id: (r.status, r.cached) for r in out if r.kind == "row"} == expected
    assert {r.source: (r["at"], r.status) for r in out if r.kind == "state"} == left


def test_late_rows_are_dropped(spark, tmp_path):
    def at(hours, ms):
        return (START + timedelta(hours=hours), float(ms), True)

    schema = "ts timestamp, elapsed_ms double, success boolean"
    # The watermark of a batch drops late rows from the batch after the next one on.
    batches = [[at(1, 100), at(2, 300)], [at(60, 1)], [at(61, 1)], [at(3, 999), at(100, 5)]]
    stream = files(spark, tmp_path, batches, schema)
    out = drain_append(stream_latency_windows(stream)).orderBy("window_start").collect()
    assert (out[0].n, out[0].mean_seconds, out[0].passed) == (2, 0.2, True)
    assert sum(r.n for r in out) == 4  # the row 58 hours late is gone, the last window is open


def test_counts_add_up_over_batches(spark, tmp_path):
    rows = [(i / 50.0, i % 2) for i in range(50)]
    stream = files(spark, tmp_path, [rows[:20], rows[20:]], "score double, label int")
    swept = sweep_on_read(drain_complete(stream_threshold_counts(stream)))
    half = swept.where(F.col("threshold") == 0.5).first()
    assert (half.tp, half.fp) == (sum(s >= 0.5 and y == 1 for s, y in rows), sum(s >= 0.5 and y == 0 for s, y in rows))


def test_table_of_one_file_or_many(spark, sf, tmp_path):
    """A stream over a table reads the same rows whether it is one file or a folder of files."""
    from tallymark.plans import load_catalog

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    (tmp_path / "events.parquet.bak").mkdir()
    for name in ("stream_running_cer", "stream_latency_windows", "stream_threshold_counts"):
        run = load_catalog()[name].run
        many = sorted(map(tuple, run(spark, str(tmp_path)).collect()), key=str)
        assert many and many == sorted(map(tuple, run(spark, sf).collect()), key=str)
