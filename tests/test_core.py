import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import errors, queries
from tideline.functions import tags
from tideline.functions import time as times
from tideline.operators import aggregate, window
from tideline.plans import query as plans
from tideline.sources import line_protocol, segment
from tideline.sources.hypertable import Timeseries

SF = "/root/testdata/sf0.001"
POINTS = "metric_name string, tags_json string, ts_us long, value_real double, quality int, seq long"


def test_durations_and_buckets(spark):
    assert [times.parse_duration_us(x) for x in ("5m", "1h", "30s")] == [300_000_000, 3_600_000_000, 30_000_000]
    for bad in ("", "5", "0s", "m", "-1s", "99999999999999999w"):
        with pytest.raises(errors.InvalidDuration):
            times.parse_duration_us(bad)
    with pytest.raises(errors.InvalidInterval):
        times.bucket(F.lit(1), 0)
    row = spark.range(1).select(times.time_bucket("5m", F.lit(1778000123456789)), times.time_bucket_ms(F.lit(-500), 1000), times.time_bucket_ns(F.lit(1500), 1000), times.time_bucket_ms(F.lit(3600001), 3600000)).first()
    assert tuple(row) == (1778000100000000, -1000, 1000, 3600000)
    times.register(spark)
    assert tuple(spark.sql("select time_bucket_ns(-500, 1000), time_bucket_ns(1, 0), parse_duration_micros('5m'), time_bucket('1m', 61000000)").first()) == (-1000, None, 300000000, 60000000)


def test_tags_and_names(spark):
    t = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("zone", "a"), ("device", "pump-1"))])
    assert spark.range(1).select(tags.tags_json(t)).first()[0] == '{"device":"pump-1","zone":"a"}'
    t = F.array(F.struct(F.lit('a"b').alias("key"), F.lit("line\none").alias("value")))
    assert spark.range(1).select(tags.tags_json(t)).first()[0] == '{"a\\"b":"line\\none"}' == tags.canonical_tags([('a"b', "line\none")])
    assert tags.canonical_tags([]) == "{}"
    with pytest.raises(errors.InvalidIdentifier):
        tags.identifier("bad-name")
    assert tags.table_arguments(["'metrics'", "5"]) == ("metrics", 5) and tags.row_arguments([1, None]) == (1, None, 0)


def test_line_protocol(spark):
    text = ["metrics,device_id=a value=1.5,flag=true 1778000000000000000", "# note", "", "m value=1 1778000000", "m value=2i 1778000000000", "m value=3 1778000000000000", "bad line", "m value=NaN 1"]
    rows = line_protocol.parse(spark.createDataFrame([(i, x) for i, x in enumerate(text)], "at int, value string")).orderBy("at").collect()
    assert [r["at"] for r in rows] == [0, 3, 4, 5, 6, 7] and [r["error"] is None for r in rows] == [True] * 4 + [False] * 2
    assert {r["ts_us"] for r in rows[:4]} == {1778000000000000}
    assert rows[0]["fields"][0]["value"]["f64"] == 1.5 and rows[0]["fields"][1]["value"]["b"] is True and rows[0]["tags_json"] == '{"device_id":"a"}'
    with pytest.raises(Exception, match="line protocol"):
        line_protocol.strict(line_protocol.parse(spark.createDataFrame([("bad",)], "value string"))).collect()


def test_segments_roundtrip():
    t, v, q = np.array([1000, 2000, 3500]), np.array([10, 11.5, 9.25]), np.array([0, 1, 0], np.int32)
    data = segment.encode(7, t, v, q)
    assert len(data) == 98 + 20 * 3 and all((a == b).all() for a, b in zip(segment.decode(data), (t, v, q)))
    for bad in (b"", data[:-1], data[:60] + b"x" + data[61:]):
        with pytest.raises(errors.InvalidPayload):
            segment.decode(bad)
    assert segment.decode_delta(segment.encode_delta([1000, 1500, 2000, 9000])).tolist() == [1000, 1500, 2000, 9000]


def test_aggregates_and_windows(spark):
    df = spark.createDataFrame([("m", "{}", 0, 10.0, 0, 0), ("m", "{}", 0, None, 0, 1), ("m", "{}", 5, float("nan"), 0, 2), ("m", "{}", 5, 20.0, 0, 3), ("m", "{}", 5, 30.0, 0, 4)], POINTS)
    row = aggregate.bucketed(df, "1m", ["count", "sum", "avg", "min", "max", "first", "last"]).first().asDict()
    assert (row["count"], row["sum"], row["avg"], row["min"], row["max"], row["first"], row["last"]) == (4, 60.0, 20.0, 10.0, 30.0, 10.0, 30.0)
    with pytest.raises(errors.UnknownAggregate):
        aggregate.bucketed(df, "1m", ["mode"])
    assert aggregate.encode_names(["Avg", "Count", "Avg"]) == "avg,count"
    moving = spark.createDataFrame([("m", "{}", t, v, 0, i) for i, (t, v) in enumerate(((0, 10.0), (3, 20.0), (10, 30.0)))], POINTS)
    assert [r["moving_avg"] for r in window.rolling(moving, 5, ["moving_avg"]).orderBy("ts_us").collect()] == [10, 15, 30]
    assert [r["moving_avg"] for r in window.moving_avg_by_arrival(moving, 5).orderBy("ts_us").collect()] == [10, 15, 30]


def test_store(spark, tmp_path):
    store = Timeseries(spark, f"file://{tmp_path}/store")
    store.install(), store.install()
    store.create_hypertable("temperature", chunk="1m")
    points = spark.range(120).select(F.lit("temperature").alias("metric_name"), F.lit('{"device":"pump-1"}').alias("tags_json"), (F.col("id") * 1_000_000).alias("ts_us"), F.col("id").cast("double").alias("value_real"), F.lit(0).alias("quality"), F.col("id").alias("seq"))
    stats = store.write_points("temperature", points)
    assert (stats.points, stats.segments, stats.chunks) == (120, 2, 2)
    assert [(r["row_count"], r["min"], r["max"], r["sum"]) for r in store.segments("temperature").orderBy("chunk_start_us").collect()] == [(60, 0, 59, 1770), (60, 60, 119, 5370)]
    store.create_rollup_policy("by_minute", "temperature", "1m", ["Avg", "Min", "Max"])
    store.refresh_rollup("by_minute")
    assert [r["avg"] for r in store.query_rollup("by_minute").collect()] == [29.5, 89.5]
    assert "PartitionFilters: [isnotnull(chunk_start_us" in store.scan("temperature", 0, 60_000_000)._jdf.queryExecution().toString()
    assert store.read_points("temperature", 0, 60_000_000).count() == 60
    store.compact("temperature")
    assert store.scan("temperature").count() == 120
    store.add_retention_policy("temperature", "1m")
    assert store.run_maintenance(120_000_000)["chunks_dropped"] == 1 and store.scan("temperature").count() == 60
    with pytest.raises(errors.InvalidPoint):
        store.write_points("temperature", points.withColumn("value_real", F.lit(float("nan"))))
    with pytest.raises(errors.MissingHypertable):
        store.hypertable("absent")


def test_scan_cost():
    assert plans.scan_cost(1000, 0, 100, 10, 0, 50, 1) == 50 and plans.scan_cost(0, None, None, 0) == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "customer", "nation"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    expected = con.sql(queries.ORACLES[name])
    columns = sorted(expected.columns)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    table = got.select(*columns).toArrow()
    rows = sorted(repr(tuple(x)) for x in zip(*(table.column(c).to_pylist() for c in columns)))
    assert rows == sorted(repr(tuple(x)) for x in expected.project(", ".join(columns)).fetchall())


def _store(spark, path, n=120):
    store = Timeseries(spark, f"file://{path}/store")
    store.install()
    store.create_hypertable("t", chunk="1m")
    points = spark.range(n).select(F.lit("t").alias("metric_name"), F.lit('{"d":"a"}').alias("tags_json"), (F.col("id") * 1_000_000).alias("ts_us"), F.col("id").cast("double").alias("value_real"), F.lit(0).alias("quality"), F.col("id").alias("seq"))
    return store, points


def test_failed_and_open_writes_are_not_seen(spark, tmp_path):
    store, points = _store(spark, tmp_path)
    store.write_points("t", points)
    with pytest.raises(errors.InvalidPoint, match="value is not finite"):
        store.write_points("t", points.withColumn("value_real", F.when(F.col("seq") == 77, F.lit(float("inf"))).otherwise(F.col("value_real"))))
    assert store.scan("t").count() == 120 and store.segments("t").agg(F.sum("row_count")).first()[0] == 120
    # A writer that died between samples and commit: unseen, and gone after recovery.
    with store._transaction("t") as number:
        store._write("t", points, 60_000_000, number)
        assert store.scan("t").count() == 120 and store.segments("t").agg(F.sum("row_count")).first()[0] == 120
        assert store.recover() == 1 and not store.files.matching(f"{store.path('t')}/*/write_id={number}")
    assert store.scan("t").count() == 120


def test_deletes_updates_and_rollups(spark, tmp_path):
    store, points = _store(spark, tmp_path)
    store.write_points("t", points)
    for name in ("a", "b"):
        store.create_rollup_policy(name, "t", "1m", ["count", "max"])
        store.refresh_rollup(name)
    assert store.catalog.rows("invalidations") == []
    store.delete_rows("t", F.col("ts_us") >= 60_000_000)
    assert store.refresh_rollup("a") == 1 and [tuple(r)[3:] for r in store.query_rollup("a").collect()] == [(60, 59.0)]
    assert store.catalog.rows("invalidations") and store.refresh_rollup("a") == 0
    store.refresh_rollup("b")
    assert store.catalog.rows("invalidations") == [] and [tuple(r)[3:] for r in store.query_rollup("b").collect()] == [(60, 59.0)]
    store.update_rows("t", F.col("value_real") == 59, F.lit(7.5))
    store.refresh_rollup("a")
    assert [tuple(r)[3:] for r in store.query_rollup("a").collect()] == [(60, 58.0)] and store.segments("t").first()["max"] == 58
    # A rewrite reads no chunk but those it touches.
    for df in (store.points("t").where(F.col("chunk_start_us").isin([0])), store.summaries("t", 60_000_000, [(0, 59_999_999)]), store.summaries("t", 30_000_000, [(0, 59_999_999)])):
        assert re.search(r"PartitionFilters: \[[^\]]*chunk_start_us", df._jdf.queryExecution().toString())


def test_summaries_keep_ties_and_finite_counts(spark):
    rows = [("m", "{}", 5, 1.0, 0, 0), ("m", "{}", 5, 2.0, 0, 1), ("m", "{}", 7, float("nan"), 0, 2), ("m", "{}", 7, float("inf"), 0, 3)]
    parts = [spark.createDataFrame([r], POINTS) for r in rows]
    for order in (parts, parts[::-1]):
        merged = aggregate.merge(aggregate.summarise(order[0], 10).unionByName(aggregate.summarise(order[1], 10)).unionByName(aggregate.summarise(order[2], 10)).unionByName(aggregate.summarise(order[3], 10)), 10)
        row = aggregate.finished(merged, ["first", "last", "avg", "count"]).first()
        assert (row["first"], row["last"], row["avg"], row["count"]) == (1.0, 2.0, 1.5, 4)


def test_line_protocol_routes_and_escapes(spark, tmp_path):
    store, _ = _store(spark, tmp_path)
    text = [r"cpu.load,host=a\,b x=1,w=100 1778000000", r"ev\ ents v=2i,s=\"a b\" 1778000000".replace('\\"', '"'), r"cpu v=3 1778000000", "m\u0001x v=4 1778000000"]
    stats = store.write_line_protocol(spark.createDataFrame([(x,) for x in text], "value string"))
    assert {k: v.points for k, v in stats.items()} == {"cpu.load": 2, "ev ents": 1, "cpu": 1, "m\u0001x": 1}
    got = {(r["metric_name"], r["tags_json"], r["value_real"]) for m in stats for r in store.scan(tags.table_name(m)).collect()}
    assert got == {("cpu.load", '{"host":"a,b"}', 1.0), ("cpu.load.w", '{"host":"a,b"}', 100.0), ("ev ents", "{}", 2.0), ("cpu", "{}", 3.0), ("m\u0001x", "{}", 4.0)}
    store.write_line_protocol(spark.createDataFrame([("x v=1,w=100 5",)], "value string"), table="forced")
    assert {(r["metric_name"], r["value_real"]) for r in store.scan("forced").collect()} == {("forced", 1.0), ("forced.w", 100.0)}
    with pytest.raises(Exception, match="line protocol: bad field value"):
        store.write_line_protocol(spark.createDataFrame([("ok v=1 5",), ("bad v=x 5",)], "value string"))
    names = ["cpu.load", "cpu_load", "cpu_x2e_load", "cpu load", "1a", "é"]
    assert len({tags.table_name(n) for n in names}) == len(names) and tags.table_name("cpu_load") == "cpu_load"


def test_control_characters_in_tags(spark):
    text = "".join(map(chr, range(1, 40))) + "\\é"
    t = F.array(F.struct(F.lit("k").alias("key"), F.lit(text).alias("value")))
    assert spark.range(1).select(tags.tags_json(t)).first()[0] == tags.canonical_tags([("k", text)])


def test_jobs_run_once_and_only_if_run(spark, tmp_path):
    store, points = _store(spark, tmp_path)
    store.write_points("t", points), store.write_points("t", points, "late")
    store.create_rollup_policy("r", "t", "1m", ["count"])
    with pytest.raises(errors.TidelineError):
        store.enqueue("dance", "t")
    for kind in ("compact", "rollup_refresh", "retention", "stats", "downsample"):
        store.enqueue(kind, "t")
    none = {"retention": False, "downsample": False, "stats": False}
    assert store.run_maintenance(0, **none, budget_ms=-1)["stopped"] == 1 and {j["state"] for j in store.catalog.rows("jobs")} == {"queued"}
    report = store.run_maintenance(0, **none)
    assert (report["jobs"], report["compacted"], report["rollups"], report["tables"]) == (5, 1, 2, 1) and {j["state"] for j in store.catalog.rows("jobs")} == {"done"}
    assert all(len(store.files.names(f"{store.path('t')}/chunk_start_us={c}")) == 1 for c in (0, 60_000_000)) and store.scan("t").count() == 240
    assert [r["count"] for r in store.query_rollup("r").collect()] == [120, 120]
    assert store.table_statistics().first()["row_count"] == 240 and store.run_maintenance(0, **none)["jobs"] == 0


def test_replayed_batches_are_left_out(spark, tmp_path):
    store, points = _store(spark, tmp_path)
    assert store.write_points("t", points, batch=("s", 0)).points == 120 and store.write_points("t", points, batch=("s", 0)).points == 0
    assert store.write_points("t", points, batch=("s", 1)).points == 120 and store.write_points("t", points, batch=("other", 0)).points == 120


def test_checksums_and_estimates(spark):
    import zlib

    for r in queries.QUERIES["crc32_props"](spark, SF).join(spark.read.parquet(f"{SF}/events.parquet").select("event_id", "props"), "event_id").collect():
        assert r["crc"] == zlib.crc32(r["props"].encode())
    values = {}
    for r in queries.events(spark, SF).collect():
        values.setdefault((r["event_type"], r["ts_us"] - r["ts_us"] % queries.DAY), []).append(r["value_real"])
    for r in queries.QUERIES["approx_percentile"](spark, SF).collect():
        x = np.sort(values[r["event_type"], r["bucket_us"]])
        for name, q in (("approx_p50", 0.5), ("approx_p95", 0.95)):  # within one place of the exact rank
            assert x[max(0, int(np.ceil(q * len(x))) - 2)] <= r[name] <= x[min(len(x) - 1, int(np.ceil(q * len(x))))]


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from tideline.sources import storage

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))

    fake = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d=None: None)}), "sparkContext": Context})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(fake)


def test_rolling_over_spans(spark):
    """One hot series over several spans, with negative times and ties, against the definition."""
    rng = np.random.default_rng(4)
    times = np.sort(rng.integers(-900, 900, 400))
    df = spark.createDataFrame([("m", "{}", int(t), float(i % 17), 0, i) for i, t in enumerate(times)], POINTS)
    values = np.arange(400) % 17.0
    got = {r["seq"]: r for r in window.rolling(df, 20, ["rolling_sum", "rolling_max", "rolling_count"]).collect()}
    arrived = {r["seq"]: r["moving_avg"] for r in window.moving_avg_by_arrival(df, 20).collect()}
    assert len(got) == 400 and set(got[0].asDict()) == {*POINTS.replace(",", "").split()[::2], "rolling_sum", "rolling_max", "rolling_count"}
    for i, t in enumerate(times):
        inside = values[(times >= t - 20) & (times <= t)]
        assert (got[i]["rolling_sum"], got[i]["rolling_max"], got[i]["rolling_count"]) == (inside.sum(), inside.max(), len(inside))
        so_far = values[: i + 1][times[: i + 1] >= t - 20]
        assert abs(arrived[i] - so_far.mean()) < 1e-9


def test_exact_percentiles(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, 501).astype(float)
    df = spark.createDataFrame([("m", "{}", i, float(v), 0, i) for i, v in enumerate(x)] + [("m", "{}", 0, None, 0, 0), ("m", "{}", 0, float("nan"), 0, 0), ("n", "{}", 0, 7.0, 0, 0)], POINTS)
    got = {r["metric_name"]: (r["a"], r["b"], r["c"]) for r in aggregate.percentiles(df, {"a": 0.0, "b": 0.33, "c": 0.999}, ["metric_name"]).collect()}
    assert got["n"] == (7.0, 7.0, 7.0) and np.allclose(got["m"], np.quantile(x, [0, 0.33, 0.999]))


def test_streams_with_state_over_batches(spark, tmp_path):
    """Sessions and the stateful moving average over several micro-batches; the average's state crosses them."""
    from tideline.streaming import aggregates as streams

    rows = [(1, 0, 10.0, 0), (1, 3, 20.0, 1), (1, 10, 30.0, 2), (1, 12, 50.0, 3), (2, 11, 1.0, 4)]
    schema = "k int, ts_us long, value_real double, seq long"
    for i, part in enumerate((rows[:2], rows[2:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/part={i}")
    source = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = []
    q = streams.moving_average(source, 5, ["k"]).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["seq"], r["moving_avg"]) for r in out} == {(0, 10.0), (1, 15.0), (2, 30.0), (3, 40.0), (4, 1.0)}


def test_orders(spark, tmp_path):
    """What is returned in an order: samples by series, time and arrival; aggregates and rollups by series and bucket; files by series and time."""
    store, points = _store(spark, tmp_path)
    mixed = points.withColumn("tags_json", F.concat(F.lit('{"d":"'), (F.col("seq") % 3).cast("string"), F.lit('"}'))).withColumn("ts_us", F.col("ts_us") % 7_000_000 * 13).orderBy(F.col("seq").desc())
    store.write_points("t", mixed)
    rows = [tuple(r) for r in store.read_points("t").select("tags_json", "ts_us", "seq").collect()]
    assert rows == sorted(rows) and len(rows) == 120
    rows = [tuple(r) for r in store.aggregate("t", "10s", ["count"]).select("tags_json", "bucket_us").collect()]
    assert rows == sorted(rows) and len(rows) > 3
    store.create_rollup_policy("r", "t", "10s", ["count"]), store.refresh_rollup("r")
    assert [tuple(r) for r in store.query_rollup("r").select("tags_json", "bucket_us").collect()] == rows
    for name in store.files.matching(f"{store.path('t')}/*/*/*.parquet"):
        inside = [tuple(r) for r in spark.read.parquet(name).select("metric_name", "tags_json", "ts_us", "seq").collect()]
        assert inside == sorted(inside)
    assert store.register_views("t") == ["r_rollup"] + [f"t_{x}" for x in ("aggregate", "chunks", "last_value", "scan", "segments", "series")]
    rows = [tuple(r) for r in spark.sql("select ts_us, seq from t_scan").collect()]
    assert rows == sorted(rows)
    assert (store.first_point("t").first()["ts_us"], store.first_point("t", F.col("ts_us") < 0).count()) == (0, 0)


def test_names_and_versions_in_sql(spark):
    times.register(spark)
    row = spark.sql("select extension_loaded(), engine_version(), time_bucket_us(-1, 10), time_bucket_ms(null, 10), parse_duration_micros('x')").first()
    assert row[0] == 1 and re.fullmatch(r"\d+\.\d+", row[1]) and tuple(row[2:]) == (-10, None, None)


def test_upserts_keep_one_row(spark, tmp_path):
    store, points = _store(spark, tmp_path)
    store.create_hypertable("t", chunk="2m")
    assert [r["chunk_us"] for r in store.catalog.rows("hypertables")] == [120_000_000] and store.ensure("t")["chunk_us"] == 120_000_000
    assert store.ensure("new")["chunk_us"] == 3_600_000_000
    store.write_points("t", points), store.write_points("t", points.withColumn("tags_json", F.lit('{"d":"b"}')).union(points))
    assert sorted(r["tags_json"] for r in store.series("t").collect()) == ['{"d":"a"}', '{"d":"b"}'] and store.tags("t").count() == 2
