"""Streams that go on from their own checkpoint."""

from docverify.streaming import feedback as S

SCHEMA = "event_id long, ts timestamp_ntz, case_id long, signal_code string, verdict string"
ELA, PAN = "FORENSICS_LOCAL_ELA_SPIKE", "RULE_PAN_FORMAT_INVALID"


def rows(spark, *found):
    return spark.createDataFrame(found, "event_id long, at string, case_id long, signal_code string, verdict string").selectExpr(
        "event_id", "cast(at as timestamp_ntz) AS ts", "case_id", "signal_code", "verdict"
    )


def test_runs_go_on_from_the_checkpoint(spark, tmp_path):
    arriving, state, seen = str(tmp_path / "in"), str(tmp_path / "out"), []

    def change(batch):
        seen.append(sorted(r["case_id"] for r in batch.collect()))
        return batch.selectExpr("case_id AS doc_id", "map_keys(feedback) AS codes", "feedback['%s'] AS ela" % ELA)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(arriving)
        return {r["doc_id"]: (sorted(r["codes"]), r["ela"]) for r in S.rescored(stream, change, state).collect()}

    rows(spark, (1, "2024-01-01", 1, ELA, "CONFIRMED"), (2, "2024-01-01", 2, PAN, "REJECTED"), (3, None, None, ELA, "REJECTED")).write.parquet(arriving)
    assert run() == {1: ([ELA], "CONFIRMED"), 2: ([PAN], None)}
    before = len(seen)
    assert run() == {1: ([ELA], "CONFIRMED"), 2: ([PAN], None)}  # nothing new: nothing is scored again
    assert not any(seen[before:])
    before = len(seen)
    rows(spark, (4, "2024-01-02", 1, ELA, "REJECTED"), (5, "2024-01-02", 1, PAN, "CONFIRMED")).write.mode("append").parquet(arriving)
    assert run() == {1: (sorted([ELA, PAN]), "REJECTED"), 2: ([PAN], None)}
    assert [s for s in seen[before:] if s] == [[1]]


def test_appended_rows_go_on(spark, tmp_path):
    arriving, out = str(tmp_path / "in"), str(tmp_path / "out")
    for turn in range(2):
        spark.range(10 * turn, 10 * turn + 5).write.mode("append").parquet(arriving)
        got = S.appended(spark.readStream.schema("id long").parquet(arriving), out)
        assert got.count() == 5 * (turn + 1)


def test_a_stream_without_rows(spark, tmp_path):
    arriving = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(arriving)
    assert S.streamed_verdicts(stream, str(tmp_path / "out")).count() == 0


def test_state_ends_after_closure(spark, tmp_path):
    """Cases that were closed lose their state once event time has passed them; a later verdict opens them anew."""
    from datetime import timedelta

    arriving, out = str(tmp_path / "in"), str(tmp_path / "out")
    S.keep_state_in_rocksdb(spark)
    try:

        def run(*found):
            rows(spark, *found).coalesce(1).write.mode("append").parquet(arriving)
            got, stream = [], spark.readStream.schema(SCHEMA).parquet(arriving)
            progress = S.run_to_end(
                S.verdicts_until_closed(stream, keep=timedelta(days=7), late="1 day"),
                lambda batch, n: got.extend((r.case_id, r.signal_code, r.verdict) for r in batch.collect()), f"{out}/state", "update",
            )
            return sorted(got), [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]][-1]

        first = [(i, "2024-01-01", i, ELA, "CONFIRMED") for i in range(1, 21)] + [(30, None, 1, ELA, "REJECTED"), (31, "2024-01-01", None, ELA, "REJECTED")]
        found, held = run(*first, (40, "2024-01-01", 1, ELA, "REJECTED"), (39, "2024-01-01", 1, ELA, "CONFIRMED"))
        assert found == sorted([(1, ELA, "REJECTED"), *[(i, ELA, "CONFIRMED") for i in range(2, 21)]]) and held == 20
        found, held = run(*[(100 + i, "2024-01-02", i, S.CLOSED, None) for i in range(1, 16)], (150, "2024-01-02", 1, PAN, "CONFIRMED"))
        assert found == [(1, PAN, "CONFIRMED")] and held == 20  # closed, but within the days that are kept
        run((200, "2024-01-20", 20, PAN, "CONFIRMED"))
        found, held = run((201, "2024-01-21", 1, ELA, "CONFIRMED"))
        assert found == [(1, ELA, "CONFIRMED")] and held == 6  # the five open cases, and the one opened anew
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_scans_arrive_in_turns(spark, tmp_path):
    """Verdicts on new images only, and all are kept; what isn't an image or shows no case is left out."""
    from pyspark.sql import functions as F

    from docverify.plans import jobs
    from docverify.sources.tables import bitmap, scan_hashes, scan_stream

    folder = tmp_path / "scans"
    folder.mkdir()
    fields = spark.createDataFrame(
        [(i, i // 2, "PAN", "AAAPG1234A", "ANSH GUPTA", "15/08/2002", "", "", 0.94) for i in range(8)],
        "doc_id long, image_id long, doc_type string, id_number string, name string, dob string, line1 string, line2 string, ocr_confidence double",
    )
    payloads = spark.createDataFrame([], "clean_id string, payload string")
    registry = spark.createDataFrame([], "clean_id string, reg_name string, reg_dob string")

    def run():
        scans = scan_stream(spark, f"file://{folder}").select(F.regexp_extract("origin", r"([0-9]+)\.bmp", 1).cast("long").alias("image_id"), "height", "width", "data")
        got = jobs.score_scan_stream(scans, fields, payloads, registry, F.lit("2024-01-31").cast("date"), f"file://{tmp_path}/out")
        return {r.doc_id: r.trust_score for r in got.collect()}

    for i in (0, 1):
        (folder / f"{i}.bmp").write_bytes(bitmap(48, 48, bytes([40 * i + 9] * (48 * 48 * 3))))
    (folder / "7.bmp").write_bytes(b"no image")
    first = run()
    assert sorted(first) == [0, 1, 2, 3] and run() == first
    (folder / "3.bmp").write_bytes(bitmap(24, 30, bytes(24 * 30 * 3)))
    (folder / "9.bmp").write_bytes(bitmap(24, 30, bytes(24 * 30 * 3)))
    assert sorted(run()) == [0, 1, 2, 3, 6, 7]
    import hashlib

    hashes = {r.origin.rsplit("/", 1)[1]: r.doc_hash for r in scan_hashes(spark, f"file://{folder}").collect()}
    assert hashes == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.iterdir()}


def test_cases_are_worked_out_once_a_run(spark, tmp_path, monkeypatch):
    """However many batches of images come: what cases show without images is stored with the first, and not before one comes."""
    from pyspark.sql import functions as F

    from docverify.operators import images
    from docverify.plans import jobs
    from docverify.sources.tables import bitmap, read_scans, scan_stream

    labels, real = [], jobs.written
    monkeypatch.setattr(jobs, "written", lambda df, label: labels.append(label) or real(df, label))
    folder = tmp_path / "scans"
    folder.mkdir()
    fields = spark.createDataFrame(
        [(i, i // 2, "PAN", "AAAPG1234A", "ANSH GUPTA", "15/08/2002", "", "", 0.94) for i in range(8)],
        "doc_id long, image_id long, doc_type string, id_number string, name string, dob string, line1 string, line2 string, ocr_confidence double",
    )
    payloads = spark.createDataFrame([], "clean_id string, payload string")
    registry, as_of = spark.createDataFrame([("AAAPG1234A", "ANSH GUPTA", "16/08/2002")], "clean_id string, reg_name string, reg_dob string"), F.lit("2024-01-31").cast("date")
    named = lambda scans: scans.select(F.regexp_extract("origin", r"([0-9]+)\.bmp", 1).cast("long").alias("image_id"), "height", "width", "data")

    def run():
        got = jobs.score_scan_stream(named(scan_stream(spark, f"file://{folder}", 1)), fields, payloads, registry, as_of, f"file://{tmp_path}/out")
        return sorted((r.doc_id, r.trust_score, r.action, r.codes) for r in got.collect())

    assert run() == [] and labels == []
    for i in range(3):
        (folder / f"{i}.bmp").write_bytes(bitmap(48, 48, bytes([40 * i + 9] * (48 * 48 * 3))))
    at_once = jobs.score_scans(fields, images.measure(named(read_scans(spark, f"file://{folder}/*.bmp"))), payloads, registry, None, as_of)
    want = sorted((r.doc_id, r.trust_score, r.action, r.codes) for r in at_once.collect())
    assert run() == want and len(want) == 6 and labels == ["stream-cases"]
