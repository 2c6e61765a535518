"""Spectrum files, tables, writers and streams on small folders."""

import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelight import schemas
from tidelight.operators.guards import DataError, refuse_inside
from tidelight.operators.intervals import file_index
from tidelight.operators.spectra import histogram
from tidelight.sources import files as fl
from tidelight.sources import sinks, tables
from tidelight.streaming import ingest as st

GRID = {"n_frames": 6, "n_bins": 8}


def _text(grid):
    return "\n".join(" ".join(str(v) for v in row) for row in grid).encode()


def _name(minute, suffix, device="DEV1"):
    return f"{device}_20240501T10{minute:02d}00.000Z{suffix}"


@pytest.fixture()
def corpus(tmp_path):
    tmp_path = tmp_path / "landing"
    tmp_path.mkdir()
    rng = np.random.default_rng(12)
    grids = {}
    for minute, suffix, zipped in ((0, ".fft.gz", True), (5, ".fft.gz", False), (10, ".fft", True)):
        g = rng.integers(0, 113, (6, 8))
        grids[_name(minute, suffix)] = g
        (tmp_path / _name(minute, suffix)).write_bytes(gzip.compress(_text(g)) if zipped else _text(g))
    (tmp_path / _name(15, ".fft.gz")).write_bytes(gzip.compress(_text(rng.integers(0, 9, (5, 8)))))
    (tmp_path / _name(20, ".fft.gz")).write_bytes(gzip.compress(_text(grids[_name(0, ".fft.gz")]))[:20])
    (tmp_path / _name(25, ".fft", "OTHER")).write_bytes(_text(grids[_name(0, ".fft.gz")]))
    (tmp_path / _name(0, ".fft.gz.sha256")).write_text("x")
    (tmp_path / _name(0, ".fft.part")).write_text("x")
    return tmp_path, grids


def test_decode_is_told_by_content_and_reports_every_bad_file(spark, corpus):
    folder, grids = corpus
    found = fl.list_files(spark, str(folder))
    assert found.count() == 6
    assert fl.readable(found).first().n_readable == 6
    decoded = fl.decode(fl.read_binary(spark, str(folder)), "DEV1", **GRID).cache()
    frames = fl.frames_of(decoded, "DEV1")
    assert frames.columns == schemas.FRAMES.fieldNames()
    for name, g in grids.items():
        rows = frames.where(F.col("path").endswith("/" + name)).orderBy("frame_idx").collect()
        assert np.array_equal(np.array([r.levels for r in rows]), g)
        assert [r.t_utc_s - rows[0].t_utc_s for r in rows] == [i * 0.25 for i in range(6)]
    bad = {r.path.rsplit("/", 1)[1]: r.reason for r in fl.errors_of(decoded).collect()}
    assert set(bad) == {_name(15, ".fft.gz"), _name(20, ".fft.gz"), _name(25, ".fft", "OTHER")}
    assert "40 values, expected 48" in bad[_name(15, ".fft.gz")]
    assert bad[_name(25, ".fft", "OTHER")] == "other_device"


@pytest.mark.parametrize("text, why", [("1 2 x 4", "not a number"), ("1 2 nan 4", "not finite"), ("1 2 1.5 4", "not small integers"), ("1 2 70000 4", "not small integers")])
def test_bad_values_are_named(text, why):
    with pytest.raises(ValueError, match=why):
        fl._levels(text.encode(), 2, 2)


def test_empty_folder_is_an_error(spark, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    with pytest.raises(DataError, match="no spectrum files"):
        fl.list_files(spark, str(tmp_path))


def test_hashes_cover_decompressed_bytes(spark, corpus):
    folder, grids = corpus
    got = fl.content_hashes(fl.read_binary(spark, str(folder))).cache()
    by = {r.path.rsplit("/", 1)[1]: r for r in got.collect()}
    first = _name(0, ".fft.gz")
    assert by[first].sha256 == hashlib.sha256(_text(grids[first])).hexdigest()
    assert by[_name(20, ".fft.gz")].sha256 is None and by[_name(20, ".fft.gz")].reason
    record = got.where(F.col("path").endswith(first) | F.col("path").endswith(_name(20, ".fft.gz"))).select("path", F.coalesce("sha256", F.lit("0")).alias("sha256"))
    record = record.unionByName(got.where(F.col("path").endswith(_name(5, ".fft.gz"))).select("path", F.lit("bad").alias("sha256")))
    find = {r.path.rsplit("/", 1)[1]: r.finding for r in fl.hash_mismatches(got, record).collect()}
    assert first not in find
    assert find[_name(20, ".fft.gz")] == "broken_container" and find[_name(5, ".fft.gz")] == "different"
    assert find[_name(10, ".fft")] == "no_record"


def test_whole_numbers_are_read_as_a_general_reader_does():
    rng = np.random.default_rng(4)
    for low, high in ((0, 100), (0, 9), (-50, 9999), (-32768, 32767)):
        values = rng.integers(low, high + 1, 500)
        for between in (" ", "\n", " \t ", "\r\n"):
            text = (between + between.join(map(str, values)) + between).encode()
            got = fl._whole_numbers(text)
            if np.abs(values).max() < 10**5:
                assert got is not None and np.array_equal(got, values)
            assert np.array_equal(fl._levels(text, 50, 10), values)
    assert np.array_equal(fl._levels(b"007 -0 +5 1e1 2.0 30000", 1, 6), [7, 0, 5, 10, 2, 30000])
    for text in (b"", b"1 2 x", b"1 - 2", b"1-2", b"--1", b"1 -", b"123456", b"1.5", b"\x001"):
        assert fl._whole_numbers(text) is None
    for bad in (b"1 2 x", b"1 - 2", b"1-2", b"123456 1 2", b"1.5 1 2", b"40000 1 2", b"1 2"):
        with pytest.raises(ValueError):
            fl._levels(bad, 1, 3)


def test_index_prefers_gz_and_first_container(spark):
    rows = [("A_20240501T100000.000Z.fft", 0), ("A_20240501T100000.000Z.fft.gz", 0), ("A_20240501T100500.000Z.fft", 0), ("A_20240501T100500.000Z.fft.gz", 1),
            ("A_20240501T101000.000Z_20240501T100900.000Z.fft", 0), ("A_20240501T101000.fft", 0), ("B_20240501T100000.000Z.fft", 0),
            ("A_20240501T102000.250Z_20240501T102100.000Z-x.fft", 0)]
    kept, lost = file_index(spark.createDataFrame(rows, "name string, container int"), "A", F.col("container"))
    names = {(r.name, r.container): r for r in kept.collect()}
    assert set(names) == {rows[1], rows[2], rows[7]}
    assert (names[rows[1]].end_utc - names[rows[1]].start_utc).total_seconds() == 300
    assert (names[rows[7]].end_utc - names[rows[7]].start_utc).total_seconds() == 59.75
    assert sorted(r.reason for r in lost.collect()) == ["duplicate_start", "duplicate_start", "no_utc_stamp", "other_device", "reversed"]


def test_strict_index_stops_on_own_names_that_do_not_parse(spark):
    index = lambda *names: file_index(spark.createDataFrame([(n, 0) for n in names], "name string, container int"), "A", F.col("container"), strict=True)
    kept, lost = index("A_20240501T100000.000Z.fft", "B_nothing.fft")
    assert kept.count() == 1 and [r.reason for r in lost.collect()] == ["other_device"]
    with pytest.raises(DataError, match="no_utc_stamp"):
        index("A_20240501T100000.000Z.fft", "A_20240501T101000.fft")
    with pytest.raises(DataError, match="reversed"):
        index("A_20240501T101000.000Z_20240501T100900.000Z.fft")


def test_scene_list_needs_an_offset(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("id, acquired ,clear_percent\nb,2020-07-01T12:00:00-07:00,\na,2020-07-01T18:30:00Z,91\n")
    got = tables.read_scenes(spark, str(p)).collect()
    assert [r.scene_id for r in got] == ["a", "b"]
    assert got[1].acquired_utc.hour == 19 and got[1].clear_percent is None and got[1].instrument is None
    p.write_text("id,acquired\nb,2020-07-01T12:00:00\n")
    with pytest.raises(Exception, match="no UTC offset"):
        tables.read_scenes(spark, str(p)).collect()


def test_labels_last_row_wins(spark, tmp_path):
    assert tables.read_labels(spark, str(tmp_path / "none.csv")).count() == 0
    p = tmp_path / "l.csv"
    head = "scene_id,acquired_utc,label,n_vessels,area_km2,reviewer,reviewed_utc,notes\n"
    p.write_text(head + "s1,2020-07-01T18:30:00+00:00,vessel,2,100,x,2021-01-01,old\ns2,2020-07-01T18:30:00+00:00,none,,50,x,2021-01-01,\ns1,2020-07-01T18:30:00+00:00,vessel,3,100,x,2021-01-01,new\n")
    got = {r.scene_id: r for r in tables.read_labels(spark, str(p)).collect()}
    assert got["s1"].n_vessels == 3 and got["s1"].notes == "new" and got["s2"].n_vessels is None
    p.write_text(head + "s1,2020-07-01T18:30:00+00:00,vessel,2,,x,2021-01-01,\n")
    with pytest.raises(DataError, match="no_area"):
        tables.read_labels(spark, str(p))


def test_labels_of_several_and_of_split_files(spark, tmp_path):
    head = "scene_id,acquired_utc,label,n_vessels,area_km2,reviewer,reviewed_utc,notes\n"
    line = lambda scene, n: f"{scene},2020-07-01T18:30:00+00:00,vessel,{n},100,x,2021-01-01,note {n}\n"
    (tmp_path / "b.csv").write_text(head + "".join(line(f"s{k % 5}", k) for k in range(400)) + line("s9", 1))
    (tmp_path / "a.csv").write_text(head + line("s1", 999) + line("s7", 1) + line("s7", 2))
    want = {"s0": 395, "s1": 396, "s2": 397, "s3": 398, "s4": 399, "s7": 2, "s9": 1}  # the file of the greater name wins, then the lower line
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728", "2000", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = tables.read_labels(spark, str(tmp_path))
            assert {r.scene_id: r.n_vessels for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_manual_counts(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("timestamp, vessel count\n20200701_1830 , 2\n,5\n20200702_1830,0\n")
    assert sorted(map(tuple, tables.read_manual_counts(spark, str(p)).collect())) == [("20200701_1830", 2), ("20200702_1830", 0)]
    p.write_text("timestamp, vessel count\n20200701_1830,\n")
    with pytest.raises(DataError, match="blank_count"):
        tables.read_manual_counts(spark, str(p))


def test_deployments(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text("\n".join(json.dumps(r) for r in [
        {"begin": "2021-05-01T00:00:00Z", "end": None, "locationCode": "X"}, {"begin": "2020-05-01T00:00:00Z", "end": "2020-09-01T00:00:00Z", "locationCode": "007"}]))
    got = tables.read_deployments(spark, str(p), "DEV1", "2026-10-01T00:00:00Z").collect()
    assert got[0].deployment_id == "DEV1@007:20200501T000000Z" and got[1].end_utc.year == 2026


def test_search_documents(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps([{"id": "a", "properties": {"acquired": "2020-07-01T18:30:00.5Z", "cloud_cover": 0.1, "satellite_azimuth": 7.0},
                              "_links": {"tiles": "u"}, "geometry": {"type": "Polygon", "coordinates": [[[0.0, 1.0]]]}}]))
    r = tables.read_search_results(spark, str(p)).first()
    assert r.year == 2020 and r.sat_azimuth == 7.0 and r.thumbnail is None and r.clear_percent is None


def test_box_cache_and_confidence(spark, tmp_path):
    df = spark.createDataFrame([("toa", "g1", 0.5), ("sr", "g1", 0.6)], "asset string, geom string, score double")
    df.write.partitionBy("asset", "geom").parquet(str(tmp_path / "c"))
    assert tables.read_box_cache(spark, str(tmp_path / "c"), "toa", "g1").first().score == 0.5
    with pytest.raises(DataError, match="nir_pct"):
        tables.read_box_cache(spark, str(tmp_path / "c"), "toa", "g1", need=["nir_pct"])
    with pytest.raises(DataError):
        tables.check_swept_confidence(0.01, 0.02)


def test_uptime_round_trip_and_refusals(spark, tmp_path):
    ok = spark.sql("SELECT timestamp'2020-05-01 00:00:00' AS start_utc, timestamp'2020-05-01 00:05:00' AS end_utc, true AS available, 'd' AS deployment_id")
    sinks.write_uptime(ok, str(tmp_path / "u"))
    assert tables.read_uptime(spark, str(tmp_path / "u")).collect() == ok.collect()
    with pytest.raises(DataError, match="no bins"):
        sinks.write_uptime(ok.limit(0), str(tmp_path / "u2"))
    with pytest.raises(DataError, match="boolean"):
        sinks.write_uptime(ok.withColumn("available", F.lit(1)), str(tmp_path / "u3"))
    with pytest.raises(DataError, match="reversed"):
        sinks.write_uptime(ok.withColumn("end_utc", F.col("start_utc")), str(tmp_path / "u4"))
    with pytest.raises(DataError, match="zone-aware"):
        sinks.write_uptime(ok.withColumn("start_utc", F.col("start_utc").cast("timestamp_ntz")), str(tmp_path / "u5"))
    with pytest.raises(DataError, match="missing \\['deployment_id'\\], extra \\['x'\\]"):
        sinks.write_uptime(ok.withColumnRenamed("deployment_id", "x"), str(tmp_path / "u6"))
    with pytest.raises(DataError):
        sinks.write_deployments(ok.select("deployment_id", "start_utc", "end_utc").limit(0), str(tmp_path / "u7"))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1.5), ("s2", None)], "scene_id string, score double")
    with pytest.raises(DataError, match="extra \\['score'\\]"):
        sinks.write_csv(df, str(tmp_path / "a"), ["scene_id"])
    with pytest.raises(DataError, match="read-only"):
        sinks.write_csv(df, str(tmp_path / "in" / "a"), ["scene_id", "score"], protected=str(tmp_path / "in"))
    refuse_inside(str(tmp_path / "inner"), str(tmp_path / "in"))
    sinks.write_csv(df, str(tmp_path / "b"), ["scene_id", "score"])
    assert spark.read.csv(str(tmp_path / "b"), header=True).where("score IS NULL").count() == 1
    sinks.write_per_scene_csv(df, str(tmp_path / "c"), ["scene_id", "score"])
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {"scene_id=s1", "scene_id=s2"}
    sinks.write_run(df, str(tmp_path / "r"), "one", {"note": "x"})
    sinks.write_run(df.limit(1), str(tmp_path / "r"), "two", {"note": "x"})
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_run(df, str(tmp_path / "r"), "two", {"note": "x"})
    assert spark.read.parquet(str(tmp_path / "r" / "latest")).count() == 1
    assert spark.read.json(str(tmp_path / "r" / "provenance")).count() == 2
    sinks.write_summaries(df.withColumn("m", F.create_map(F.lit("k"), F.col("score"))), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_ranked(df.orderBy("scene_id"), str(tmp_path / "k"))
    with pytest.raises(DataError, match="null_level"):
        sinks.write_ambient(df.withColumnRenamed("score", "ambient"), str(tmp_path / "m"))


def test_population_and_event_tables(spark, tmp_path):
    h = spark.createDataFrame([(2020, 0, 5, 3)], "year int, bin int, level int, n long")
    sinks.write_population(str(tmp_path / "p"), h, h.drop("n"), h)
    back = tables.read_population(spark, str(tmp_path / "p"))
    assert back["hist"].first().n == 3 and set(back) == {"hist", "median_spectra", "window_stats"}
    names = schemas.EVENTS_LONG.fieldNames()
    long = spark.createDataFrame([("s", "b", 10, *[k for k in range(6)], 1.0, 2.0, 3.0, 0, "")], ", ".join(f"{n} {'string' if n in ('scene_id', 'band', 'note') else 'double' if n in ('baseline', 'peak_excess', 'duration_s') else 'int'}" for n in names))
    wide = spark.createDataFrame([("s", 3, None, None)], "scene_id string, n_b int, n_c long, total_detection_events long")
    sinks.write_events(long, wide, str(tmp_path / "e"), ["b", "c"])
    assert spark.read.parquet(str(tmp_path / "e" / "events_wide")).first().n_b == 3
    assert spark.read.parquet(str(tmp_path / "e" / "events_long")).schema == schemas.EVENTS_LONG
    for bad_long, bad_wide in ((long.drop("note"), wide), (long, wide.withColumn("n_d", F.lit(1))), (long, wide.drop("n_c"))):
        with pytest.raises(DataError):
            sinks.write_events(bad_long, bad_wide, str(tmp_path / "bad"), ["b", "c"])
    assert not (tmp_path / "bad").exists()


def test_frames_keep_the_head_of_a_window(spark, tmp_path):
    import datetime as dt

    midnight = dt.datetime(2024, 5, 2, tzinfo=dt.timezone.utc).timestamp()
    rows = [("p", midnight - 100 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "path string, t_utc_s double")
    sinks.write_frames(df, str(tmp_path / "f"))
    got = tables.season_frames(spark, str(tmp_path / "f"), F.timestamp_seconds(F.lit(midnight - 50)), F.timestamp_seconds(F.lit(midnight + 50)))
    assert got.count() == 100


def test_resumed_ingest_adds_only_new_files(spark, corpus, tmp_path):
    folder, _ = corpus
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    st.ingest(spark, str(folder), out, "DEV1", ck, **GRID).awaitTermination()
    assert spark.read.parquet(f"{out}/frames").count() == 18
    ret = spark.read.parquet(f"{out}/retrievals")
    assert ret.groupBy("status").count().orderBy("status").collect()[0]["count"] == 3
    st.ingest(spark, str(folder), out, "DEV1", ck, **GRID).awaitTermination()
    assert spark.read.parquet(f"{out}/frames").count() == 18
    (folder / _name(30, ".fft")).write_bytes(_text(np.ones((6, 8), int)))
    st.ingest(spark, str(folder), out, "DEV1", ck, **GRID).awaitTermination()
    assert spark.read.parquet(f"{out}/frames").count() == 24


def test_streamed_histogram_equals_batch(spark, tmp_path):
    frames = spark.createDataFrame([(2020 + i % 2, [i % 5, 200, -3]) for i in range(20)], "year int, levels array<int>")
    frames.repartition(4).write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    q = st.running_histogram(stream, "year").writeStream.outputMode("complete").format("memory").queryName("hist").option(
        "checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    cols = ["year", "bin", "level", "n"]
    batch = sorted(map(tuple, histogram(frames, ["year"]).select(*cols).collect()))
    assert sorted(map(tuple, spark.table("hist").select(*cols).collect())) == batch
    parts = st.partial_histogram(frames.limit(7), "year", 0).unionByName(st.partial_histogram(frames.subtract(frames.limit(0)).limit(0), "year", 1))
    assert st.sum_partials(parts, "year").agg(F.sum("n")).first()[0] == 21
