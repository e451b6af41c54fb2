"""File sources, sinks and the streaming forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.sources import readers, sinks
from driftline.streaming import live

T0 = dt.datetime(2021, 1, 1)


def put(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_csv_with_metadata_row_and_latin1(spark, tmp_path):
    p = put(tmp_path, "a.csv", "Collar: 12, Sensor range 4g\nName,Temp [°C]\nx,1.5\ny,\n", "latin-1")
    df = readers.read_csv(spark, p)
    assert df.columns[:2] == ["Name", "Temp [°C]"]
    assert [r[0] for r in df.orderBy("Name").collect()] == ["x", "y"]


def test_many_files_united_by_name(spark, tmp_path):
    put(tmp_path, "s1.csv", "t,a\n1,2\n")
    put(tmp_path, "s2.csv", "t,b\n2,3\n,\n")
    put(tmp_path, "skip.txt", "t,c\n9,9\n")
    rows = readers.read_many(spark, str(tmp_path), "s*.csv").orderBy("t").collect()
    assert [(r["t"], r["a"], r["b"]) for r in rows] == [("1", "2", None), ("2", None, "3")]


def test_state_space_locations(spark, tmp_path):
    p = put(tmp_path, "g.csv", '"; made by x"\n;more,,\n,,,\nPtt,Date,Most Likely Latitude,Most Likely Longitude,Observation Type,Observation Score\n'
                               '1,3/14/2021 13:05,10.5,-120.25,Light,55.1\n1,bad,1,2,Light,\n1,3/15/2021 1:00,11,-121,None,\n')
    rows = readers.read_state_space_locations(spark, p).orderBy("ts").collect()
    assert [(r["ts"], r["latitude"]) for r in rows][:1] == [(dt.datetime(2021, 3, 14, 13, 5), 10.5)]
    assert rows[0]["observation_score"] == 55.1


def test_gps_csv(spark, tmp_path):
    p = put(tmp_path, "g.csv", "UTC_Date,UTC_Time,Latitude[deg],Longitude[deg]\n2021-06-25,15:00:39,1.5,36.2\n2021-06-25,16:00:00,0,0\nx,y,1,2\n")
    assert [tuple(r) for r in readers.read_gps_csv(spark, p).collect()] == [(dt.datetime(2021, 6, 25, 15, 0, 39), 1.5, 36.2)]


def test_kml_points(spark, tmp_path):
    mark = lambda n, w, c: f"<Placemark><name>{n}</name><TimeStamp><when>{w}</when></TimeStamp><Point><coordinates>{c}</coordinates></Point></Placemark>"
    p = put(tmp_path, "t.kml", '<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>' + mark("1", "2021-06-25T15:00:39Z", "36.2,1.5,0")
            + mark("1", "2021-06-25T15:00:39Z", "36.2,1.5,0") + mark("First Position Mark", "2021-06-25T15:00:39Z", "1,1,0") + "</Document></kml>")
    k = readers.read_kml(spark, p)
    assert [tuple(r) for r in k.collect()] == [(dt.datetime(2021, 6, 25, 15, 0, 39), 1.5, 36.2)]
    assert readers.merge_locations(k, k).count() == 1


def test_header_intervals(spark, tmp_path):
    p = put(tmp_path, "h.txt", "[file]\nx=1\n\n[activated sensors]\n01_name=Depth\n01_interval=10\n02_name=Light \n02_interval=1000\n\n[end]\n05_name=No\n05_interval=3\n")
    assert {r["signal"]: r["interval"] for r in readers.read_intervals(spark, p).collect()} == {"depth": 10, "light": 1000}


def test_accelerometer_milliseconds_are_the_truth(spark):
    df = spark.createDataFrame([("2021-01-01T00:00:00Z", "1609459200000"), ("2021-01-01T00:00:01Z", "1609459202000")], [readers.ISO_COL, readers.MS_COL])
    rows = readers.standardize_accelerometer(df).orderBy("ts").collect()
    assert [r["off"] for r in rows] == [False, True] and rows[1]["ts"] == T0 + dt.timedelta(seconds=2)
    with pytest.raises(ValueError):
        readers.accelerometer_layout(spark.createDataFrame([(1,)], "x int"))


def test_metadata_properties(spark):
    rows = ['{"type":"title","title":[{"plain_text":"a"},{"plain_text":"b"}]}', '{"type":"number","number":3.5}', '{"type":"select","select":null}',
            '{"type":"multi_select","multi_select":[{"name":"x"},{"name":"y"}]}', '{"type":"date","date":{"start":"2021-01-02"}}', '{"type":"relation","relation":[{"id":"i1"}]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(readers.parse_property(F.col("p"))).collect()] == ["a, b", "3.5", None, "x, y", "2021-01-02", "i1"]


def test_mapping_and_missing(spark, tmp_path):
    p = put(tmp_path, "m.csv", "original_channel_id,original_unit,manufacturer_signal_name,standardized_channel_id,standardized_unit,parent_signal\nLight Level,Lux,light,light,lux,light\nlight level,Lux,l2,light2,lux,light\n")
    m = readers.read_mapping(spark, p)
    assert m.count() == 1
    c = spark.createDataFrame([("L1", "Light level"), ("L1", "depth")], "logger_id string, channel string")
    assert [r["channel"] for r in readers.missing_mappings(c, m).collect()] == ["depth"]


def test_notes_with_deletions(spark, tmp_path):
    p = put(tmp_path, "n.csv", "datetime,key,duration,deleted\n2021-01-01 03:00:00,dive_start,,\n2021-01-01 04:00:00,note,60,\n2021-01-01 03:00:00,dive_start,,True\n")
    rows = readers.read_notes(spark, p, "Africa/Nairobi").collect()
    assert [(r["key"], r["ts"], r["type"]) for r in rows] == [("note", dt.datetime(2021, 1, 1, 1), "state")]


def test_window_load_includes_both_ends(spark, tmp_path):
    rows = [("d", "a", "depth", "depth", T0 + dt.timedelta(minutes=i), float(i + 1)) for i in range(6)]
    df = spark.createDataFrame(rows, "dataset_id string, deployment_id string, signal string, channel string, ts timestamp, value double")
    out = str(tmp_path / "sig")
    assert sinks.write_signals(df, out) == 6
    got = sinks.load_window(spark, out, "2021-01-01 00:01:00", "2021-01-01 00:03:00", ["depth"], "a")
    assert sorted(r["value"] for r in got.collect()) == [2.0, 3.0, 4.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "PartitionFilters" in plan and "date" in plan.split("PartitionFilters")[1][:200]
    with pytest.raises(ValueError):
        sinks.write_signals(df.where("value < 0"), str(tmp_path / "empty"))


def test_instants_survive_export(spark, tmp_path):
    df = spark.createDataFrame([(T0,)], "ts timestamp")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()[0] == "2021-01-01T00:00:00.000000Z"
    sinks.write_table(df.withColumn("nothing", F.lit(None)), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first()["ts"] == T0


def test_metadata_flattened(spark):
    df = spark.sql("SELECT 'a' AS id, named_struct('x', 1, 'y', named_struct('z', 'q')) AS m")
    assert sorted(map(tuple, sinks.flatten_metadata(df, ["id"]).collect())) == [("a", "m_x", "1"), ("a", "m_y_z", "q")]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(seconds=3 * i), 0.0, 3.0, 4.0) for i in range(40)] + [(1, T0 + dt.timedelta(days=2), 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, ax double, ay double, az double")
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, q in (("bins", live.live_aggregates(src, ["id"], "ts", 30.0, ("ax", "ay", "az"))), ("spans", live.live_merged_spans(src, ["id"], "ts", "10 seconds"))):
        run = q.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        run.processAllAvailable()
        run.stop()
    bins = spark.table("bins").orderBy("bin_ts").collect()
    assert [r["n_samples"] for r in bins] == [10, 10, 10, 10] and bins[0]["activity"] == 5.0
    assert spark.table("spans").first()["n_merged"] == 40


def test_each_file_has_its_own_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,x\nµ,1\n".encode())
    (tmp_path / "b.csv").write_bytes("name,x\nå,2\n".encode("latin-1"))
    got = {r["x"]: r["name"] for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert got == {"1": "µ", "2": "å"}


def test_each_recording_has_its_own_epoch_unit(spark):
    from driftline.operators.timebase import build_datetime
    df = spark.createDataFrame([("s", 1_700_000_000.0), ("s", 1_700_000_060.0), ("ms", 1_700_000_000_000.0)], "rec string, datetimenum double")
    got = build_datetime(df, keys=["rec"]).selectExpr("year(ts) AS y").distinct().collect()
    assert [r["y"] for r in got] == [2023]


def test_declared_layouts():
    from driftline.operators.timebase import spark_pattern
    known = {"HH:MM:SS DD-Mon-YYYY": "HH:mm:ss dd-MMM-yyyy", "DD/MM/YYYY  hh:mm:ss.000": "dd/MM/yyyy HH:mm:ss.SSS", "MM/DD/YY": "MM/dd/yy", "HH:MM": "HH:mm", "mm:ss": "mm:ss",
             "yyyy-mm-dd hh:mm": "yyyy-MM-dd HH:mm", "DD MMM YY": "dd MMM yy", "HH:MM:SS.SSS": "HH:mm:ss.SSS", "unknown": None, " ": None, None: None, "NaN": None}
    assert {u: spark_pattern(u) for u in known} == known


def test_run_outputs_of_any_version(spark, tmp_path):
    now = spark.createDataFrame([("d1", T0, T0, 0.0, True, "a.b", " "), ("d2", T0, T0, 1.0, None, "", "x.y")],
                                "deployment_id string, start_ts timestamp, end_ts timestamp, duration_s double, keep_filtered boolean, label_name string, state_name string")
    got = {r["deployment_id"]: r for r in sinks.standard_segments(now).collect()}
    assert got["d1"]["state_name"] == "a.b" and got["d2"]["state_name"] == "x.y" and got["d1"]["group_label"] == "a" and got["d2"]["base_keep_filtered"] is None
    old = now.select("deployment_id", F.col("start_ts").alias("datetime"), F.lit("12.5").alias("duration"), F.lit("").alias("label_name"), F.lit("find_rest.long_flat").alias("base_state_key"))
    old.write.parquet(str(tmp_path / "run"))
    r = sinks.load_segments(spark, str(tmp_path / "run"), ["d2"]).collect()
    assert len(r) == 1 and r[0]["duration_s"] == 12.5 and r[0]["keep_filtered"] and r[0]["segment_midpoint_ts"] == T0 and r[0]["label_name"] == r[0]["state_name"] == "find_rest.long_flat"
    assert sinks.load_segments(spark, str(tmp_path / "run")).count() == 2


def test_renamed_settings():
    from driftline.operators.rest import REST_DEFAULTS, rest_settings
    got = rest_settings({"sign_consistency_required": False, "thresholds": {"min_duration_s": 240.0}, "context_filters": [], "debug": {}})
    assert got == {**REST_DEFAULTS, "end_segments_upon_d1_sign_change": False, "min_duration_s": 240.0}
    assert rest_settings({"sign_consistency_required": False, "end_segments_upon_d1_sign_change": True})["end_segments_upon_d1_sign_change"]
    with pytest.raises(ValueError):
        rest_settings({"no_such": 1})
