"""Computations over one scan against the single operators, and the audit that recomputes values."""

import pytest
from pyspark.sql import functions as F

from stintwise.operators import capability, describe, evidence
from stintwise.operators.computations import Computation, counted_lines, run_computations
from stintwise.operators.spread import Scale

PLAN = [Computation("i", "record_inventory"), Computation("a", "concept_availability", "telemetry_sample"),
        Computation("s", "descriptive_summary", "telemetry_sample", "speed", "lap_id"),
        Computation("d", "descriptive_summary", None, "speed", "dataset_id"), Computation("y", "event_yield", "driver_input_event")]
FIELD = "struct<value:double,provenance:string>"
SCHEMA = f"record_type string, dataset_id string, lap_id string, event_type string, fields struct<speed:{FIELD},brake:{FIELD}>, quality_flags array<string>"


@pytest.fixture(scope="module")
def records(spark):
    def row(kind, lap, speed, provenance="measured", event=None, flags=None):
        return (kind, "d", lap, event, ((speed, provenance) if provenance else None, None), flags)
    rows = [row("telemetry_sample", "l1", float(v)) for v in (5, 5, 1, 9, 2)] + [
        row("telemetry_sample", "l1", None, "unavailable"), row("telemetry_sample", None, 7.5, "derived", flags=["x", "x", None]),
        row("telemetry_sample", "l2", None, None), row("driver_input_event", "l2", 3.0, event="brake"),
        row("driver_input_event", None, None, None, event=None, flags=[])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("scale", [Scale(1000), Scale(None, 2)])
def test_equal_to_the_single_operators(records, scale):
    got = run_computations(records, PLAN, scale).collect()
    of = {name: [r for r in got if r.computation == name] for name in "iasdy"}
    assert {(r.level, r.name, r.n) for r in of["i"]} == {tuple(r) for r in describe.record_inventory(records).collect()}
    single = {r.concept: r for r in describe.concept_availability(records, "telemetry_sample").collect()}
    assert [r.n for r in of["a"] if r.level == "scanned"] == [single["speed"].records_scanned]
    names = ("present", "measured", "derived", "estimated", "unavailable")
    assert {r.name: [r[n] for n in names] for r in of["a"] if r.level == "concept"} == {k: [r[n] for n in names] for k, r in single.items()}
    laps = describe.descriptive_summary(records, "telemetry_sample", "speed", ["lap_id"], scale).collect()
    stats = ("minimum", "maximum", "mean", "median", "q1", "q3", "mad")
    assert {r.group: (r.n, r.present, r.unavailable, *[r[s] for s in stats]) for r in of["s"]} == {
        r.lap_id: (r.records_of_type, r.field_present, r.values_unavailable, *[r[s] for s in stats]) for r in laps}
    assert [(r.group, r.n, r.present, r.median) for r in of["d"]] == [("d", 10, 8, 5.0)]
    assert {(r.level, r.name, r.n) for r in of["y"]} == {tuple(r) for r in describe.event_yield(records, "driver_input_event").collect()}


def test_one_scan(records, tmp_path):
    records.write.parquet(str(tmp_path / "r"))
    stored = records.sparkSession.read.parquet(str(tmp_path / "r"))
    plan = counted_lines(stored, PLAN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_without_records(records):
    got = run_computations(records.where("false"), PLAN).collect()
    assert len(got) == 42 and {r.computation for r in got} == {"a"} and {r.n for r in got} == {0}


@pytest.mark.parametrize("parts", [("x", "unknown"), ("x", "descriptive_summary"), ("x", "event_yield", None, "speed"),
                                   ("x", "descriptive_summary", None, "no_concept"), ("x", "event_yield", None, None, "lap_id")])
def test_refused_computations(parts):
    with pytest.raises(ValueError):
        Computation(*parts)


def test_equal_names_are_refused(records):
    with pytest.raises(ValueError):
        counted_lines(records, [PLAN[0], PLAN[0]])


def test_values_recomputed(spark):
    units = spark.createDataFrame(
        [("u1", "l1", "baseline", 1.0, 2, 2), ("u2", "l2", "intervention", 3.0, 2, 2), ("u3", "l3", "baseline", None, 1, 1)],
        "unit_id string, lap_id string, arm string, value double, records long, used long").withColumn("holdout", F.lit(False))
    pairs = spark.createDataFrame([("p", "u1", "u2", 1.0, 3.0, 2.0)], "pair_id string, baseline_unit_id string, "
                                  "intervention_unit_id string, baseline_value double, intervention_value double, difference double")
    lone = spark.createDataFrame([("u3", "baseline")], "unit_id string, arm string")
    formed = units.select("lap_id", "value", "records", "used", F.lit(None).cast("string").alias("exit_stage"))
    counts = spark.createDataFrame([(3, 2, 1, 0, 1, 1)], "included_units long, baseline_units long, intervention_units long, "
                                   "holdout_units long, pairs long, unpaired_units long")

    def found(**other):
        sets = {"units": units, "pairs": pairs, "unpaired": lone, "formed": formed, "counts": counts} | other
        return {(r.check, r.subject) for r in evidence.audit_values(**sets, keys=["lap_id"]).collect()}

    assert found() == set()
    assert found(unpaired=lone.where("false")) == {("unit_neither_or_twice_paired", "u3"), ("count_differs", "unpaired_units")}
    assert found(formed=formed.withColumn("value", F.coalesce("value", F.lit(0.0)))) == {("value_not_recomputed", "u3")}
    assert found(formed=formed.where("lap_id <> 'l2'")) == {("unit_without_source", "u2")}
    assert found(formed=formed.withColumn("used", F.lit(None).cast("long"))) == {("record_counts_not_recomputed", u) for u in ("u1", "u2", "u3")}
    assert found(pairs=pairs.withColumn("difference", F.lit(None).cast("double"))) == {("difference_not_recomputed", "p")}
    assert found(pairs=pairs.withColumn("baseline_value", F.lit(2.0))) == {("pair_value_differs", "u1"), ("difference_not_recomputed", "p")}
    assert found(pairs=pairs.withColumn("intervention_unit_id", F.lit("u9"))) == {
        ("unknown_unit", "u9"), ("unit_neither_or_twice_paired", "u2")}
    assert found(counts=counts.where("false")) == {("count_differs", n) for n in counts.columns}
    assert found(unpaired=lone.withColumn("arm", F.lit("intervention"))) == {("arm_differs", "u3")}


def test_lists_behind_the_counts(spark):
    variables = spark.createDataFrame(
        [("s", "a_ST", "Int", 6, None), ("s", "a_ST", "Int", 6, None), ("s", None, "BitField", 1, "irsdk_x"), (None, "b", "Int", None, "m")],
        "snapshot string, name string, sdk_type string, count int, unit string")
    got = {tuple(r) for r in capability.inventory_members(variables, "snapshot", "irsdk_").collect()}
    assert got == {("s", "arrays", "a_ST"), ("s", "sub_sample", "a_ST"), ("s", "enumerated", None)}
    channels = spark.createDataFrame(
        [("s", "speed", "unavailable", False, "none", True, False), ("s", "odd", "x", True, "add_new_capture", False, False),
         (None, None, None, None, None, None, None)],
        "snapshot string, channel string, classification string, supported boolean, action string, for_rehearsal boolean, for_campaign boolean")
    got = {tuple(r) for r in capability.readiness_members(channels, "snapshot", ("speed", "gear")).collect()}
    assert got == {("s", "expected_unavailable", "speed", 1), ("s", "blocking", "speed", 1), ("s", "supported", "odd", None),
                   ("s", "partially_captured", "odd", None), ("s", "profile_unknown", "odd", None), ("s", "profile_missing", "gear", 2),
                   (None, "profile_unknown", None, None), (None, "profile_missing", "speed", 1), (None, "profile_missing", "gear", 2)}
