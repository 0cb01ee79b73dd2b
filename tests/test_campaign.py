"""A fabricated campaign with known answers, from text cells to the estimate."""

import pytest
from pyspark.sql import functions as F

from stintwise.operators import bootstrap as bs
from stintwise.operators import evidence as ev
from stintwise.operators import sensitivity, stats
from stintwise.operators.normalize import ColumnMapping, mapped_fields
from stintwise.operators.segments import Segment
from stintwise.operators.spread import Scale
from stintwise.session import cut_lineage

MAPPINGS = [ColumnMapping("time_s", "timestamp"), ColumnMapping("lap_distance_m", "lap_distance"),
            ColumnMapping("speed_mps", "speed"), ColumnMapping("off_track", "off_track_state")]
BASE = {100.0: 45.0, 120.0: 40.0, 140.0: 34.0, 160.0: 36.0, 180.0: 42.0}
CORNER = Segment("corner", 90, 200)
SMALL = Scale(1000)
BASELINE = [0.0, 0.25, -0.25, 0.5, -0.5, 0.0]
BETTER = [0.5, 1.0, 0.25, 1.0, -0.25, 0.75]
THIRD = [0.25, 0.5, 0.0, 0.75, -0.25, 0.25]


def samples_of(spark, datasets):
    """datasets: (dataset, session, block, arm, offsets, blank laps)."""
    rows = []
    for dataset, session, block, arm, offsets, blank in datasets:
        for lap, offset in enumerate(offsets, 1):
            for i, at in enumerate([10.0, 50.0, *BASE, 250.0, 400.0]):
                speed = BASE.get(at, 60.0) + offset
                text = "" if lap in blank and at in BASE else f"{speed:.4f}"
                rows.append((dataset, session, block, arm, lap, f"{lap}.{i}", f"{at:.4f}", text, "false"))
    df = spark.createDataFrame(
        rows, "dataset_id string, session_id string, block_id string, arm string, lap_number int, time_s string, "
              "lap_distance_m string, speed_mps string, off_track string")
    return df.withColumns({
        "lap_id": F.format_string("%s.lap-%03d", "dataset_id", "lap_number"), "record_type": F.lit("telemetry_sample"),
        "record_id": F.concat("dataset_id", F.lit("-"), "time_s"), "fields": mapped_fields(MAPPINGS),
        "quality_flags": F.lit(None).cast("array<string>")})


def run(spark, datasets):
    records = samples_of(spark, datasets).repartition(6)
    laps = records.select("dataset_id", "lap_id").distinct().withColumn("lap_valid", F.lit(True))
    rows = ev.classify(records, laps, CORNER, ev.Extractor(), scale=SMALL)
    formed = ev.form_units(rows.filter("exit_stage is null"), CORNER, ev.Extractor(),
                           ["dataset_id", "lap_id", "lap_number"], scale=SMALL)
    contexts = records.select("dataset_id", "session_id", "block_id", "arm").distinct().withColumn(
        "participant", F.lit("driver"))
    units = cut_lineage(ev.describe_units(formed, contexts, "lap_id", ["session_id"], scale=SMALL))
    pairs = cut_lineage(ev.pair_units(units, cluster="block").withColumn("k", F.lit("corner-minimum-speed")))
    return rows, units, pairs


def layout(third=THIRD, blank=()):
    out = []
    for i, better in enumerate((BETTER, BETTER, third)):
        s = f"session-0{i + 1}"
        out += [(f"d{2 * i + 1}", s, f"block-0{2 * i + 1}", "baseline", BASELINE, ()),
                (f"d{2 * i + 2}", s, f"block-0{2 * i + 2}", "intervention", better, blank)]
    return out


def test_clear_improvement(spark):
    _, units, pairs = run(spark, layout())
    counts = ev.evidence_counts(units, pairs).first()
    assert (counts.included_units, counts.pairs, counts.clusters, counts.unpaired_units) == (36, 18, 3, 0)
    assert stats.paired_effect(pairs, ["k"], scale=SMALL).first().estimate == pytest.approx(0.5)
    p = stats.sign_test(pairs, ["k"]).first().p_value
    assert p == 7.62939453125e-06
    family = spark.createDataFrame([("f", 0, p), ("f", 1, None)], "family string, i int, p double")
    holm = stats.adjust_p_values(family, "family", "p", "i", "holm_bonferroni", .05, SMALL).filter("i = 0").first()
    assert holm.adjusted_p_value == 1.52587890625e-05 and holm.rejected
    drawn = bs.bootstrap(pairs, "k", "cluster_id", "median", 2000, 20260820, SMALL)
    clusters = pairs.select("k", "cluster_id").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("clusters"))
    interval = bs.percentile_interval(drawn, "k", 2000, .95, clusters, 2).first()
    assert (interval.lower, interval.upper) == (pytest.approx(0.25), pytest.approx(0.5))
    checks = sensitivity.all_checks(pairs, "k", 0.2, scale=SMALL).collect()
    assert len(checks) == 6 and {c.outcome for c in checks} == {"robust"}


def test_unavailable_is_not_zero(spark):
    rows, units, pairs = run(spark, layout(blank=(1, 2)))
    assert rows.filter("exit_stage = 'missing_required_channel'").count() == 3 * 2 * 5
    counts = ev.evidence_counts(units, pairs).first()
    assert (counts.baseline_units, counts.intervention_units, counts.pairs, counts.unpaired_units) == (18, 12, 12, 6)


def test_no_effect(spark):
    same = [(d, s, b, a, BASELINE, ()) for d, s, b, a, _, _ in layout()]
    _, _, pairs = run(spark, same)
    assert stats.paired_effect(pairs, ["k"], scale=SMALL).first().estimate == 0.0
    r = stats.sign_test(pairs, ["k"]).first()
    assert r.ties == 18 and r.p_value is None
