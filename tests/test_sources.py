"""Files in, records out, and back."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stintwise.operators import audit
from stintwise.operators.normalize import ColumnMapping, conform, enum_dictionary_problems
from stintwise.operators.spread import Scale
from stintwise.sources import recorder, session_export
from stintwise.sources.files import (
    event_lines, payload, read_event_lines, read_text_table, reconcile_inventory, with_row_number,
)
from stintwise.sources.inventory import read_inventory
from stintwise.sources.mapped_csv import read_mapped_csv
from stintwise.sources.quarantine import mapped_problems, set_apart
from stintwise.sources.records import read_record_lines, read_records, write_record_lines, write_records

SMALL = Scale(1000)
SESSION = {"dataset_id": "d", "session_id": "s", "simulator": "sim", "driver_id": "p", "car": "c", "track": "t",
           "layout": "l"}
MAPPINGS = [ColumnMapping("time_s", "timestamp"), ColumnMapping("lap_distance_m", "lap_distance"),
            ColumnMapping("speed_mps", "speed"), ColumnMapping("brake_fraction", "brake")]


@pytest.fixture
def mapped(tmp_path):
    lines = ["time_s;lap;lap_distance_m;speed_mps;brake_fraction;unused_debug"]
    lines += [f"{i / 10};{1 + i // 4};{i % 4 * 25};{'' if i == 2 else 40 + i};0;x" for i in range(8)]
    path = tmp_path / "telemetry.csv"
    path.write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_mapped_csv_to_records(spark, mapped):
    records = read_mapped_csv(spark, mapped, MAPPINGS, "lap", SESSION, ";", SMALL)
    got = records.orderBy("sequence_index").collect()
    assert [r.record_type for r in got] == (
        ["session", "lap"] + ["telemetry_sample"] * 4 + ["lap"] + ["telemetry_sample"] * 4)
    assert [r.sequence_index for r in got] == list(range(11))
    blank = next(r for r in got if r.record_id == "s.sample-000002")
    assert blank.fields.speed.value is None and blank.fields.speed.provenance == "unavailable"
    assert blank.fields.speed.quality_flags == ["missing_source_value"] and blank.fields.brake.value == 0.0
    assert blank.source_provenance.row_start == 4 and blank.lap_id == "s.lap-001"
    samples = records.filter("record_type = 'telemetry_sample'")
    assert audit.record_contract(samples).count() == 0


def test_record_sinks(spark, mapped, tmp_path):
    records = read_mapped_csv(spark, mapped, MAPPINGS, "lap", SESSION, ";", SMALL)
    full = conform(records)
    write_records(records, str(tmp_path / "parquet"))
    write_record_lines(records, str(tmp_path / "lines"))
    for back in (read_records(spark, str(tmp_path / "parquet")), read_record_lines(spark, str(tmp_path / "lines"))):
        a = sorted(json.dumps(r.asDict(True), sort_keys=True) for r in back.select(full.columns).collect())
        b = sorted(json.dumps(r.asDict(True), sort_keys=True) for r in full.collect())
        assert a == b
    with pytest.raises(Exception):
        write_records(records, str(tmp_path / "parquet"))


def test_header_must_match(spark, mapped):
    with pytest.raises(Exception):
        read_text_table(spark, mapped, ["time_s", "other", "a", "b", "c", "d"], ";").collect()


def test_row_numbers_survive_small_splits(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("n\n" + "".join(f"{i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = read_text_table(spark, str(path), ["n"])
        assert rows.rdd.getNumPartitions() > 3
        for scale in (SMALL, Scale(None, 100)):
            assert with_row_number(rows, "i", scale).filter("cast(n as long) <> i").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def sample_line(**cells):
    return ",".join(str(cells.get(c, "")) for c in recorder.SAMPLE_COLUMNS)


def test_recorder_bundle(spark, tmp_path):
    assert len(recorder.SAMPLE_COLUMNS) == 82 and len(set(recorder.SAMPLE_COLUMNS)) == 82
    path = tmp_path / "samples.csv"
    path.write_text("\n".join([
        ",".join(recorder.SAMPLE_COLUMNS),
        sample_line(capture_sequence=0, simulator_tick=10, observed_utc="2024-01-01T00:00:01.1234567Z", lap=1,
                    speed_mps=40.5, track_surface=0, abs_active="true", tire_cold_pressure_lf_kpa=170, gear=3),
        sample_line(capture_sequence=3, simulator_tick=11, observed_utc="2024-01-01T00:00:02.0000000Z",
                    session_time_s=2.5, track_surface=9, incident_count=0, gear="x"),
    ]) + "\n")
    rows = recorder.read_samples(spark, str(path))
    assert [r.rule for r in recorder.sample_cell_problems(rows).collect()] == ["gear.type"]
    out = recorder.records(rows, SESSION, "2024-01-01T00:00:00Z", {0: "off_track", 1: "on_track"}, SMALL)
    got = out.orderBy("sequence_index").collect()
    assert [r.record_id for r in got] == ["s-session", "s-lap-1", "s-sample-0", "s-lap-0", "s-sample-3"]
    a, b = got[2].fields, got[4].fields
    assert a.timestamp.value == pytest.approx(1.123456) and a.timestamp.provenance == "derived"
    assert b.timestamp.value == 2.5 and b.timestamp.source_channel == "SessionTime"
    assert a.off_track_state.value is True and b.off_track_state.provenance == "unavailable"
    assert a.tire_pressure_front_left.value == 170000.0 and a.tire_pressure_front_left.provenance == "derived"
    assert b.incident_state.value == "0" and a.incident_state.provenance == "unavailable"
    assert audit.forbidden_values(rows, recorder.CHANNEL_COLUMNS, ["speed", "fuel"]).collect()[0].column == "speed_mps"


def test_session_export(spark, tmp_path):
    laps = tmp_path / "laps.csv"
    laps.write_text("\n".join([",".join(session_export.LAP_COLUMNS),
                               "1,80.5,1:20.5,1,1,1,1,,flying,1,,2,2,1.0,0,0",
                               "2,,,0,0,0,0,off_track,flying,1,3,1,2,0.5,0,0"]) + "\n")
    bins = tmp_path / "telemetry.csv"
    bins.write_text("\n".join([
        ",".join(session_export.BIN_COLUMNS),
        "1,0,0.0,0.1,0.5,0.0,0.0,40,144,3,1,1,1,0,,flying,1,0,1,F1", "1,1,0.5,0,0.6,0.0,0.0,41,147.6,2,1,1,1,0,,flying,1,0,0,",
        "2,0,0.0,0.1,0.5,0.0,0.0,0,0,1,1,0,0,1,off_track,flying,1,1,0,", "2,1,0.5,,,,,,,0,0,0,0,1,off_track,flying,1,1,0,",
    ]) + "\n")
    found = tmp_path / "findings.json"
    found.write_text(json.dumps({"schema": "x", "session": {"car": "c", "trackLengthMeters": 2.0}, "findings": [
        {"key": "F1", "rank": 1, "lapNumber": 1, "startDistanceMeters": 0.0, "endDistanceMeters": 1.0, "coverage": 1.0}]}))
    lap_rows, bin_rows = session_export.read_laps(spark, str(laps)), session_export.read_bins(spark, str(bins))
    assert session_export.read_findings(spark, str(found)).first().key == "F1"
    assert audit.lap_table_rules(lap_rows, ["lap_number"]).count() == 0
    assert audit.bin_rules(bin_rows, lap_rows, ["lap_number"], ["lap_number", "distance_m"], SMALL).count() == 0
    got = session_export.records(lap_rows, bin_rows, SESSION, SMALL).orderBy("sequence_index").collect()
    assert [r.record_type for r in got] == ["session", "lap", "lap"] + ["distance_bin"] * 4
    empty, zero = got[6], got[5]
    assert empty.fields.speed.provenance == "unavailable" and empty.fields.speed.value is None
    assert zero.fields.speed.value == 0.0 and zero.fields.speed.provenance == "derived"
    assert sorted(empty.quality_flags) == ["product_classified_excluded", "source_bin_unsampled"]


def test_events_and_inventory(spark, tmp_path):
    folder = tmp_path / "bundle"
    folder.mkdir()
    (folder / "events.jsonl").write_text(json.dumps({
        "schema_version": "v1", "sequence": 0, "observed_utc": "2024-01-01T00:00:00Z", "session_time_s": None,
        "kind": "collection-condition", "data": {"a": 1}}) + "\n")
    (folder / "b.txt").write_bytes(b"two")
    events = read_event_lines(spark, str(folder / "events.jsonl"), "v1")
    assert events.select(payload("$.a", "int")).first()[0] == 1 and events.first().session_time_s is None
    log = audit.event_log(events.withColumn("k", F.lit(1)), ["k"], "sequence", "kind", F.lit("collection-condition"))
    assert log.first().problem is None
    declared = spark.createDataFrame([("b.txt", 3, hashlib.sha256(b"twO").hexdigest()), ("gone.txt", 1, "x")],
                                     "path string, length long, sha256 string")
    status = {r.path: r.status for r in reconcile_inventory(declared, read_inventory(spark, str(folder))).collect()}
    assert status == {"b.txt": "hash_mismatch", "gone.txt": "missing", "events.jsonl": "undeclared"}


def test_enum_dictionaries(spark):
    df = spark.createDataFrame([
        ("a", "e", "k", "product_declared", "preserve_raw_value", "l", {"1": "x"}),
        ("b", "e", "k", "unavailable", "preserve_raw_value", "l", {"1": "x"}),
        ("c", "e", "k", "product_declared", "guess", "l", {"1": "x"}),
        ("d", "e", None, "product_declared", "preserve_raw_value", "l", None)],
        "column string, enumeration string, kind string, dictionary_provenance string, unknown_value_behavior string, "
        "limitation string, values map<string,string>")
    assert {r.column: r.problem for r in enum_dictionary_problems(df).collect()} == {
        "b": "values_without_provenance", "c": "does_not_preserve_unknown", "d": "missing_semantics"}


def test_inventory_reads_files_larger_than_a_cell(spark, tmp_path):
    folder = tmp_path / "bundle"
    (folder / "in").mkdir(parents=True)
    (folder / "in" / "small.csv").write_bytes(b"a,b\n\x001\x00")
    (folder / "_SUCCESS").write_text("")
    (folder / "empty.txt").write_text("")
    with open(folder / "large.bin", "wb") as file:
        file.write(b"x")
        file.truncate(3 << 30)
    digest = hashlib.sha256(b"x")
    for size in [1 << 24] * 191 + [(1 << 24) - 1]:
        digest.update(bytes(size))
    rows = read_inventory(spark, str(folder))
    got = {r.path: (r.length, r.sha256, r.nul_bytes, r.nul_at) for r in rows.collect()}
    assert got == {"in/small.csv": (7, hashlib.sha256(b"a,b\n\x001\x00").hexdigest(), 2, 4), "empty.txt": (0, hashlib.sha256(b"").hexdigest(), 0, None),
                   "large.bin": (3 << 30, digest.hexdigest(), (3 << 30) - 1, 1)}
    rules = {(r.path, r.rule) for r in audit.scan_files(rows.withColumn("g", F.lit("all")), "g", F.lit(False)).collect()}
    assert rules == {("large.bin", "large-file"), ("large.bin", "nul-bytes"), ("in/small.csv", "nul-bytes"), ("all", "group-total-size")}
    (tmp_path / "none").mkdir()
    assert read_inventory(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("scale", [SMALL, Scale(None, 3)])
def test_mapped_rows_are_refused_or_set_apart(spark, tmp_path, scale):
    laps = ["1", "1", "x", "2", "", "2", "1", "1", "3", "-1", "2.5", "3"]
    rows = spark.createDataFrame([("f", i, str(i), lap, "12.5d" if i == 1 else "4") for i, lap in enumerate(laps)],
                                 "f string, row_index long, time_s string, lap string, speed_mps string")
    mappings = [ColumnMapping("time_s", "timestamp"), ColumnMapping("speed_mps", "speed")]
    clean, refused = set_apart(mapped_problems(rows, mappings, "lap", ["f"], scale), ["row_index"])
    assert {(r.row_index, r.problem) for r in refused.collect()} == {
        (1, "speed_mps.unparsable"), (2, "lap.unparsable"), (4, "lap.unparsable"), (6, "lap.reappears"), (7, "lap.reappears"),
        (9, "lap.negative"), (9, "lap.regressed"), (10, "lap.unparsable"), (11, "lap.reappears")}
    assert {r.row_index for r in clean.collect()} == {0, 3, 5, 8}
    path = tmp_path / "m.csv"
    path.write_text("time_s,lap,speed_mps\n0,1,4\n1,2,4\n2,1,4\n")
    with pytest.raises(Exception, match="lap.reappears"):
        read_mapped_csv(spark, str(path), mappings, "lap", SESSION, scale=SMALL).collect()
    kept = read_mapped_csv(spark, str(path), mappings, "lap", SESSION, scale=SMALL, refuse=False)
    assert kept.where("record_type = 'telemetry_sample'").count() == 3


def test_lap_tables_are_refused_or_set_apart(spark, tmp_path):
    path = tmp_path / "laps.csv"
    good = "1,80.5,1:20.5,1,1,1,1,,flying,1,,2,2,1.0,0,0"
    path.write_text("\n".join([",".join(session_export.LAP_COLUMNS), good, "2,80.5,1:20.5,1,1", "3,12.5d,,0,0,yes,0,,flying,,,2,2,1.0,0,0",
                               "4,,,0,0,1,0,off,flying,1,,1,2,0.7,0,0", "1,,,1,0,0,1,,flying,1,,0,0,1.0,0,0"]) + "\n")
    rows = session_export.read_laps(spark, str(path), quarantine=True)
    refused = {}
    for r in set_apart(rows, ["_line"])[1].orderBy("_line").collect():
        refused.setdefault(r._line, set()).add(r.problem)
    first, width, cells, rules, second = [refused.get(k) for k in sorted(r._line for r in rows.select("_line").collect())]
    assert first == {"lap_number.duplicate"} and width == {"row.width"}
    assert cells == {"lap_time_seconds.unparsable", "is_valid.unparsable", "stint.missing"}
    assert rules == {"coverage_fraction.share", "exclusion_reasons.valid_lap"}
    assert second == {"lap_number.duplicate", "is_best_valid_lap.invalid_lap", "is_reference.invalid_lap", "total_bins.positive"}
    with pytest.raises(Exception, match="laps.csv"):
        session_export.read_laps(spark, str(path)).collect()
    path.write_text("\n".join([",".join(session_export.LAP_COLUMNS), good]) + "\n")
    assert session_export.read_laps(spark, str(path)).first().lap_number == 1


def test_bad_event_lines_are_refused_or_set_apart(spark, tmp_path):
    sound = {"schema_version": "v1", "sequence": 3, "observed_utc": "", "session_time_s": 2, "kind": "k", "data": {"s": " x ", "n": None}}
    lines = [json.dumps(sound), "", "[1]", "null", json.dumps({**sound, "more": 1}), json.dumps({**sound, "schema_version": 1}),
             json.dumps({**sound, "sequence": -1}), json.dumps({**sound, "sequence": 1.5}), json.dumps({**sound, "session_time_s": "2"}),
             json.dumps({**sound, "kind": None}), json.dumps({**sound, "data": "{}"}), None]
    rows = spark.createDataFrame([(i, t, "own") for i, t in enumerate(lines)], "i int, value string, kept string")
    found = {r.i: r for r in event_lines(rows, "v1").withColumn("s", payload("$.s", "string")).withColumn("n", payload("$.n", "int")).drop("data").collect()}
    assert [found[i].problem for i in range(len(lines))] == [
        None, "not_json", "shape", "shape", "shape", "version", "sequence", "sequence", "session_time", "kind", "data", "not_json"]
    assert (found[0].sequence, found[0].session_time_s, found[0].s, found[0].n, found[0].kept) == (3, 2.0, " x ", None, "own")
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(lines[:1] + lines[2:3]))
    assert read_event_lines(spark, str(path), "v1", quarantine=True).where("problem is null").count() == 1
    with pytest.raises(Exception, match="event log: shape"):
        read_event_lines(spark, str(path), "v1").count()


def test_conditions_do_not_repeat_the_parsing(spark):
    """Cells and events are parsed once a row, however many conditions look at them."""
    from stintwise.plans.catalogue import QUERIES

    def uses(name, call):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        return plan.count(call)

    assert uses("a2_bad_cells", "from_csv(") == 1
    # The query parses the event's own properties once more; the rows of the lap table are made twice.
    assert uses("a8_event_payloads", "parse_json") + uses("a8_event_payloads", "parseJson") <= 2
    assert uses("a1_refusals", "from_csv(") <= 2
