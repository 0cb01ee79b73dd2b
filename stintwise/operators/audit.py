"""Integrity audits. Each returns the violations (or flags) it finds as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.functions.canonical import row_hash
from stintwise.operators.spread import UNKNOWN, Scale, lookup_join, ordered_scan
from stintwise.vocabulary import (
    BOOLEAN_CONCEPTS, CONCEPT_UNITS, INTEGER_CONCEPTS, PROVENANCES, RECORD_TYPES, TEXT_CONCEPTS,
)

# Text rules as (rule, words, pattern), the pattern in a dialect both RE2 and
# Java accept. Every match of a pattern contains one of its words, whatever the case, so a
# text without any of them need not be searched.
SECRET_RULES = (
    ("private-key", ("private key",), r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("aws-access-key", ("akia",), r"AKIA[0-9A-Z]{16}"),
    ("sk-style-key", ("sk-",), r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("secret-assignment", ("api", "client", "password"),
     r"(?i)\b(?:api[_-]?key|client[_-]?secret|password)\s*[:=]\s*['\x22][^'\x22\r\n]{8,}"),
)
PRIVACY_RULES = (
    ("e-mail", ("@",), r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"),
    ("payment-key", ("sk_", "whsec_", "cus_", "sub_"), r"(?i)sk_(?:live|test)_|whsec_|cus_[a-z0-9]+|sub_[a-z0-9]+"),
    ("license", ("license",), r"(?i)license.{0,8}[A-Z0-9-]{16,}"),
    ("platform-id", ("driveruserid", "subsessionid", "machine"), r"(?i)driveruserid|subsessionid|machine.?fingerprint"),
    ("user-path", (":\\users\\",), r"(?i)[A-Z]:\\Users\\"),
)
_IDENTIFIERS = (r"(?:full_?name|email(?:_address)?|phone(?:_number)?|street_?address|iracing_?customer_?id|steam_?id)")
_IDENTIFIER_WORDS = ("name", "email", "phone", "address", "id")
IDENTIFIER_RULES = (
    ("direct-identifier-json", _IDENTIFIER_WORDS, r"(?i)\x22" + _IDENTIFIERS + r"\x22\s*:"),
    ("direct-identifier-csv", _IDENTIFIER_WORDS, r"(?i)^(?:[^\r\n]*,)?" + _IDENTIFIERS + r"(?:,|\r?$)"),
)
# File policy.
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_GROUP_BYTES = 2 * 1024 * 1024
PROHIBITED_EXTENSIONS = (
    ".db", ".sqlite", ".sqlite3", ".mdb", ".accdb", ".p12", ".pfx", ".pem", ".key", ".cer", ".crt", ".zip",
)


def violations(df: DataFrame, rules: dict[str, Column], subject: list[str]) -> DataFrame:
    """(subject..., rule) for every rule that is not satisfied. An unknown (null) rule passes.

    The codes of a row are gathered in one string, which stays inside generated code however
    many rules there are; clean rows leave before anything is exploded.
    """
    broken = F.concat_ws("\n", *[
        F.when(~F.coalesce(ok, F.lit(True)), F.lit(code)) for code, ok in rules.items()])
    held = df.select(*subject, broken.alias("_rules")).filter(F.col("_rules") != "")
    return held.select(*subject, F.explode(F.split("_rules", "\n")).alias("rule"))


def require_clean(found: DataFrame, what: str) -> None:
    """Fail the job when an audit found anything."""
    first = found.take(5)
    if first:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in first))


def concept_rules(concept: str) -> dict[str, Column]:
    """Rules of one qualified value; null (absent) passes all of them."""
    f = F.col("fields")[concept]
    missing = f["provenance"] == "unavailable"
    rules = {
        f"{concept}.provenance": f.isNull() | F.coalesce(f["provenance"].isin(*PROVENANCES), F.lit(False)),
        f"{concept}.unit": f.isNull() | (f["unit"] == CONCEPT_UNITS[concept]),
        f"{concept}.unavailable_has_value": ~missing | f["value"].isNull(),
        f"{concept}.value_missing": f.isNull() | missing | f["value"].isNotNull(),
        f"{concept}.measured_needs_source": (f["provenance"] != "measured") | f["source_channel"].isNotNull(),
        f"{concept}.derived_needs_derivation":
            ~f["provenance"].isin("derived", "estimated") | f["derivation"].isNotNull(),
    }
    if concept in INTEGER_CONCEPTS:
        rules[f"{concept}.integral"] = f["value"] == F.floor(f["value"])
    elif concept not in BOOLEAN_CONCEPTS + TEXT_CONCEPTS:
        rules[f"{concept}.finite"] = ~F.isnan(f["value"]) & (F.abs(f["value"]) < F.lit(float("inf")))
    return rules


def record_contract(records: DataFrame, subject: list[str] | None = None) -> DataFrame:
    """All contract violations of normalized records, whatever concepts the table carries."""
    have = set(records.columns)
    kind = F.col("record_type")
    rules: dict[str, Column] = {"record_type": kind.isin(*RECORD_TYPES)}
    for column in ("dataset_id", "session_id", "record_id"):
        rules[f"{column}.required"] = F.col(column).isNotNull() & (F.col(column) != "")
    if "sequence_index" in have:
        rules["sequence_index.minimum"] = F.col("sequence_index") >= 0
    needs = {
        "session": ("simulator", "driver_id", "car", "track", "layout"),
        "lap": ("lap_id", "lap_number"), "segment": ("lap_id", "segment_id", "segment_kind", "label"),
        "telemetry_sample": ("lap_id", "sample_index"), "driver_input_event": ("lap_id", "event_type"),
        "distance_bin": ("lap_id", "distance_bin_index", "distance_start_m", "distance_end_m", "sample_count",
                         "has_sample"),
    }
    for record_type, columns in needs.items():
        for column in columns:
            if column in have:
                rules[f"{record_type}.{column}.required"] = (kind != record_type) | F.col(column).isNotNull()
    carried = records.schema["fields"].dataType.fieldNames()
    for concept in carried:
        rules.update(concept_rules(concept))
    if "timestamp" in carried:
        rules["timestamp.required"] = ~kind.isin("telemetry_sample", "driver_input_event") | (
            F.col("fields.timestamp").isNotNull())
    if {"distance_start_m", "distance_end_m", "sample_count", "has_sample"} <= have:
        is_bin = kind == "distance_bin"
        rules["bin.width"] = ~is_bin | (
            (F.col("distance_start_m") >= 0) & (F.col("distance_end_m") > F.col("distance_start_m")))
        rules["bin.index"] = ~is_bin | (F.col("distance_bin_index") == F.floor("distance_start_m"))
        rules["bin.has_sample"] = ~is_bin | (F.col("has_sample") == (F.col("sample_count") > 0))
    return violations(records, rules, subject or ["record_id"])


# The aggregation of a distance bin.
BIN_METHODS = {"brake": "maximum", "throttle": "arithmetic_mean", "steering_angle": "arithmetic_mean", "speed": "arithmetic_mean"}
BIN_SEMANTICS = "distance_binned_aggregate"
MONOTONIC_TIME = "normalized_monotonic_time"


def nested_contract(records: DataFrame, subject: list[str] | None = None) -> DataFrame:
    """Contract violations inside a record's structs, arrays and maps, whichever of them the table carries:
    source provenance, quality flags of records and values, the timestamps' reference and the aggregation of bins.

    All rules are column expressions over the row; arrays and maps are looked through by higher-order functions, not exploded.
    """
    have, kind = set(records.columns), F.col("record_type")
    rules: dict[str, Column] = {}

    def filled(text: Column) -> Column:
        return F.coalesce(F.trim(text) != "", F.lit(False))

    def all_filled(flags: Column) -> Column:
        return flags.isNull() | F.forall(flags, filled)

    if "source_provenance" in have:
        source = F.col("source_provenance")
        for name in ("source_file", "adapter_id", "adapter_version"):
            rules[f"source_provenance.{name}.required"] = filled(source[name])
        rules["source_provenance.source_file_sha256"] = F.coalesce(source["source_file_sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False))
        first, last = source["row_start"], source["row_end"]
        rules["source_provenance.rows.minimum"] = (F.coalesce(first, F.lit(1)) >= 1) & (F.coalesce(last, F.lit(1)) >= 1)
        rules["source_provenance.rows.order"] = first <= last
    if "quality_flags" in have:
        rules["quality_flags.items"] = all_filled(F.col("quality_flags"))
    members = {f.name: f.dataType.fieldNames() for f in records.schema["fields"].dataType} if "fields" in have else {}
    for concept, names in members.items():
        if "quality_flags" in names:
            rules[f"{concept}.quality_flags.items"] = all_filled(F.col("fields")[concept]["quality_flags"])
    if "reference" in members.get("timestamp", ()):
        rules["timestamp.reference"] = ~kind.isin("telemetry_sample", "driver_input_event") | F.col("fields.timestamp.reference").eqNullSafe(MONOTONIC_TIME)
    if "aggregation" in have:
        made, plain = F.col("aggregation"), kind != "distance_bin"
        rules["aggregation.source_semantics"] = plain | made["source_semantics"].eqNullSafe(BIN_SEMANTICS)
        rules["aggregation.distance_bin_width_m"] = plain | made["distance_bin_width_m"].eqNullSafe(F.lit(1.0))
        methods = F.coalesce(made["channel_methods"], F.create_map().cast("map<string,string>"))
        rules["aggregation.channel_methods.keys"] = plain | (F.sort_array(F.map_keys(methods)) == F.array(*[F.lit(c) for c in sorted(BIN_METHODS)]))
        for concept, method in BIN_METHODS.items():
            rules[f"aggregation.channel_methods.{concept}"] = plain | (F.coalesce(F.try_element_at(methods, F.lit(concept)), F.lit(method)) == method)
    return violations(records, rules, subject or ["record_id"])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def dense_ranks(df: DataFrame, keys: list[str], rank: str, start: int = 0) -> DataFrame:
    """Groups whose ``rank`` values are not exactly start, start+1, ... without repeats.

    Three mergeable aggregates per group instead of a window over it: a set of n distinct
    integers with minimum ``start`` and maximum ``start + n - 1`` has no hole.
    """
    counts = df.groupBy(*keys, rank).agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.count(F.lit(1)).alias("n_distinct"),
        F.min(rank).cast("long").alias("lowest"), F.max(rank).cast("long").alias("highest"))
    return counts.filter((F.col("lowest") != start) | (F.col("n") != F.col("n_distinct"))
                         | (F.col("highest") != start - 1 + F.col("n")))


def parent_references(
    children: DataFrame, parents: DataFrame, parent_key: str, agree: list[str], scale: Scale = UNKNOWN
) -> DataFrame:
    """Children whose parent is missing, later in the sequence, or of another container."""
    table = parents.select(
        parent_key, F.col("sequence_index").alias("_parent_at"), *[F.col(c).alias(f"_parent_{c}") for c in agree])
    joined = lookup_join(children, table, [parent_key], "left", [F.col("record_id")], scale)
    problem = F.when(F.col("_parent_at").isNull(), "unknown_parent").when(
        F.col("_parent_at") >= F.col("sequence_index"), "later_parent")
    for column in agree:
        problem = problem.when(F.col(f"_parent_{column}") != F.col(column), f"crosses_{column}")
    return joined.select("record_id", parent_key, problem.alias("rule")).filter("rule is not null")


def temporal_flags(
    samples: DataFrame,
    session_key: str,
    lap_key: str,
    order: list[str],
    slot: Column,
    index: Column | None,
    timestamp: Column,
    distance: Column | None,
    expected_period: Column | float | None = None,
    tolerance: Column | float | None = None,
    scale: Scale = UNKNOWN,
) -> DataFrame:
    """Add ``detected``: the temporal flags of each sample, sorted.

    The reference point is the last *known* timestamp, not the highest: after a clock reset
    later rows are compared with the reset clock. Distance is followed per lap, over rows
    that know both their time and their distance.
    """
    carry = {"_ts": ("last", timestamp)}
    if index is not None:
        carry["_ix"] = ("previous", index)
    seen = ordered_scan(samples, [session_key], order, slot, carry, scale)
    delta = timestamp - F.col("_ts")
    flags = []
    if index is not None:
        flags += [F.when(index <= F.col("_ix"), "sample_index_not_increasing"),
                  F.when(index > F.col("_ix") + 1, "sample_index_gap")]
    flags += [F.when(timestamp.isNull(), "timestamp_unavailable"),
              F.when(delta < 0, "clock_reset"), F.when(delta == 0, "duplicate_timestamp")]
    if expected_period is not None and tolerance is not None:
        period = expected_period if isinstance(expected_period, Column) else F.lit(expected_period)
        slack = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
        flags.append(F.when(delta > period + slack, "timestamp_gap"))
    if distance is not None:
        known = F.when(timestamp.isNotNull(), distance)
        seen = ordered_scan(seen, [lap_key], order, slot, {"_at": ("last", known)}, scale)
        flags.append(F.when(known < F.col("_at"), "lap_distance_regression"))
    return seen.withColumn("detected", F.array_sort(F.array_compact(F.array(*flags)))).drop("_ts", "_ix", "_at")


def add_flags(records: DataFrame, detected: str = "detected") -> DataFrame:
    """Merge detected flags into ``quality_flags``, sorted and without repeats."""
    none = F.array().cast("array<string>")
    merged = F.array_sort(F.array_union(F.coalesce("quality_flags", none), F.coalesce(detected, none)))
    return records.withColumn("quality_flags", merged).drop(detected)


def flag_counts(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Records per quality flag."""
    return records.select(*(keys or []), F.explode("quality_flags").alias("flag")).groupBy(
        *(keys or []), "flag").agg(F.count(F.lit(1)).alias("n"))


def bin_sequence(bins: DataFrame, keys: list[str], index: str, start: str, end: str, slot: Column | None = None,
                 scale: Scale = UNKNOWN) -> DataFrame:
    """Distance bins: positive width, first index 0, contiguous, start strictly increasing."""
    seen = ordered_scan(bins, keys, [index], slot if slot is not None else F.floor(F.col(index) / 4096), {
        "_pi": ("previous", F.col(index)), "_ps": ("previous", F.col(start))}, scale)
    return violations(seen, {
        "non_positive_width": F.col(end) > F.col(start),
        "first_index_not_zero": F.col("_pi").isNotNull() | (F.col(index) == 0),
        "index_not_contiguous": F.col(index) == F.col("_pi") + 1,
        "start_not_increasing": F.col(start) > F.col("_ps"),
    }, [*keys, index])


def lap_runs(samples: DataFrame, session_key: str, lap_number: str, order: list[str], slot: Column,
             scale: Scale = UNKNOWN) -> DataFrame:
    """Laps that reappear after another lap, or numbers that go down, per session."""
    seen = ordered_scan(samples, [session_key], order, slot, {"_before": ("previous", F.col(lap_number))}, scale)
    starts = F.col("_before").isNull() | (F.col("_before") != F.col(lap_number))
    return seen.groupBy(session_key, lap_number).agg(
        F.count_if(starts).alias("runs"), F.count_if(F.col("_before") > F.col(lap_number)).alias("regressions"),
    ).filter("runs > 1 or regressions > 0")


def capture_sequence(samples: DataFrame, keys: list[str], sequence: str, order: list[str], slot: Column,
                     declared: DataFrame, scale: Scale = UNKNOWN) -> DataFrame:
    """Per bundle: rows, sequence gaps, non-increasing steps, against declared metrics.

    ``declared`` holds keys, samples_written, samples_dropped.
    """
    seen = ordered_scan(samples, keys, order, slot, {"_p": ("previous", F.col(sequence))}, scale)
    step = F.col(sequence) - F.col("_p")
    counted = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.when(step > 0, step - 1)), F.lit(0)).cast("long").alias("gaps"),
        F.count_if(step <= 0).alias("not_increasing"))
    return declared.join(counted, keys, "full_outer").withColumn("problem", F.when(
        F.col("not_increasing") > 0, "sequence_not_increasing").when(
        F.col("gaps") > F.col("samples_dropped"), "gaps_exceed_declared_drops").when(
        ~F.col("samples_written").eqNullSafe(F.col("n_rows")), "row_count_mismatch"))


def forbidden_values(samples: DataFrame, channel_columns: dict[str, list[str]], unavailable: list[str]) -> DataFrame:
    """Rows holding a value in a column of a channel declared unavailable: (column, n).

    One aggregation with a counter per column, then the single row is turned on its side.
    """
    columns = [c for channel in unavailable for c in channel_columns.get(channel, [])]
    counted = samples.agg(*[F.count(F.when(F.col(c).cast("string") != "", 1)).alias(c) for c in columns])
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])
    return counted.select(F.inline(lines)).filter("n > 0")


def event_log(events: DataFrame, keys: list[str], sequence: str, kind: str, required: Column) -> DataFrame:
    """Per bundle: is the sequence dense from zero, and does the required kind occur."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.min(sequence).alias("lowest"), F.max(sequence).alias("highest"),
        F.count_distinct(sequence).alias("n_distinct"), F.coalesce(F.bool_or(F.col(kind) == required), F.lit(False)).alias("has_required"),
    ).withColumn("problem", F.when(
        (F.col("lowest") != 0) | (F.col("highest") != F.col("n_events") - 1)
        | (F.col("n_distinct") != F.col("n_events")), "sequence_not_dense").when(
        ~F.col("has_required"), "required_kind_missing"))


def event_log_rules(events: DataFrame, metadata: DataFrame, keys: list[str], condition: str, markers: dict[str, str]) -> DataFrame:
    """(keys..., rule) for every broken rule of an event log against its bundle's metadata.

    ``events``: keys, sequence, kind. ``metadata``, one row per bundle: keys, coaching_state, events_written, events_dropped.
    ``condition`` is a kind every log holds; ``markers`` names the kind that a coaching state asks for. A bundle without
    events has written none; events without metadata break metadata_missing alone. Null keys make one bundle.
    One aggregation over the events, whose partial sums are all that is shuffled.
    """
    kinds = {f"_has_{i}": kind for i, kind in enumerate([condition, *markers.values()])}
    counted = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("sequence").alias("_low"), F.max("sequence").alias("_high"),
        F.count_distinct("sequence").alias("_distinct"),
        *[F.coalesce(F.bool_or(F.col("kind") == kind), F.lit(False)).alias(name) for name, kind in kinds.items()])
    declared = metadata.select(*keys, "coaching_state", "events_written", "events_dropped", F.lit(True).alias("_declared"))
    marks = [f"_key_{k}" for k in keys]
    sides = [d.select(*[F.struct(k).alias(m) for k, m in zip(keys, marks)], *[c for c in d.columns if c not in keys])
             for d in (counted, declared)]
    both = sides[0].join(sides[1], marks, "full_outer").select(
        *[F.col(m)[k].alias(k) for k, m in zip(keys, marks)], *[c for d in sides for c in d.columns if c not in marks])
    known, n = F.coalesce("_declared", F.lit(False)), F.coalesce("_n", F.lit(0))

    def has(name: str) -> Column:
        return F.coalesce(name, F.lit(False))

    return violations(both, {
        "metadata_missing": known,
        "sequence_not_dense": ~known | (n == 0) | F.coalesce(
            (F.col("_low") == 0) & (F.col("_high") == n - 1) & (F.col("_distinct") == n), F.lit(False)),
        "condition_missing": ~known | has("_has_0"),
        **{f"marker_missing.{state}": ~known | ~F.col("coaching_state").eqNullSafe(state) | has(f"_has_{i}")
           for i, state in enumerate(markers, 1)},
        "written_mismatch": ~known | F.col("events_written").eqNullSafe(n),
        "dropped_events": ~known | F.col("events_dropped").eqNullSafe(F.lit(0)),
    }, keys)


def lap_table_rules(laps: DataFrame, subject: list[str]) -> DataFrame:
    """Internal agreement of a lap table."""
    return violations(laps, {
        "coverage_fraction": F.abs(
            F.col("coverage_fraction") - F.col("sampled_bins") / F.col("total_bins")) <= 0.00005,
        "valid_lap_with_reasons": ~F.col("is_valid") | (F.coalesce("exclusion_reasons", F.lit("")) == ""),
        "reference_not_valid": ~F.col("is_reference") | F.col("is_valid"),
        "best_not_valid": ~F.col("is_best_valid_lap") | F.col("is_valid"),
    }, subject)


def bin_rules(bins: DataFrame, laps: DataFrame, keys: list[str], subject: list[str],
              scale: Scale = UNKNOWN) -> DataFrame:
    """Every distance bin against its own fields and against its lap."""
    table = laps.select(*keys, F.col("is_valid").alias("_valid"), F.col("is_reference").alias("_reference"))
    joined = lookup_join(bins, table.withColumn("_known", F.lit(True)), keys, "left",
                         [F.col(c) for c in subject], scale)
    channels = [c for c in ("brake", "throttle", "steering_rad", "speed_ms") if c in bins.columns]
    filled = sum((F.col(c).isNotNull().cast("int") for c in channels), F.lit(0))
    return violations(joined, {
        "lap_unknown": F.col("_known").isNotNull(),
        "fraction_range": (F.col("lap_fraction") >= 0) & (F.col("lap_fraction") < 1),
        "has_sample_count": F.col("has_sample") == (F.col("sample_count") > 0),
        "unsampled_with_values": F.col("has_sample") | (filled == 0),
        "sampled_without_values": ~F.col("has_sample") | (filled == len(channels)),
        "validity_disagrees": F.col("lap_is_valid") == F.col("_valid"),
        "reference_disagrees": F.col("lap_is_reference") == F.col("_reference"),
        "brake_range": F.col("brake").between(0, 1) if "brake" in channels else F.lit(True),
        "speed_range": F.col("speed_ms") >= 0 if "speed_ms" in channels else F.lit(True),
    }, subject)


def unit_agreement(df: DataFrame, keys: list[str], pairs: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """Largest difference between a convenience column and its authoritative value.

    ``pairs`` maps a name to (convenience, authoritative in the same unit, tolerance).
    """
    out = df.groupBy(*keys).agg(*[F.max(F.abs(a - b)).alias(f"{n}_error") for n, (a, b, _) in pairs.items()])
    return out.select("*", *[(F.col(f"{n}_error") <= t).alias(f"{n}_agrees") for n, (_, _, t) in pairs.items()])


def bin_totals(bins: DataFrame, laps: DataFrame, keys: list[str]) -> DataFrame:
    """Bin, sample and frame totals per lap against the lap table, both sides kept."""
    counted = bins.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bins"), F.count_if("has_sample").alias("sampled"),
        F.sum("sample_count").alias("frames"))
    return laps.select(*keys, "total_bins", "sampled_bins").join(counted, keys, "full_outer").withColumn(
        "problem", F.when(F.col("bins").isNull(), "lap_without_bins").when(
            F.col("total_bins").isNull(), "bins_without_lap").when(
            (F.col("bins") != F.col("total_bins")) | (F.col("sampled") != F.col("sampled_bins")), "totals_differ"))


def finding_keys(bins: DataFrame, findings: DataFrame, session_key: str, lap: str, at: str,
                 scale: Scale = UNKNOWN) -> DataFrame:
    """Keys listed on bins (space separated) against the findings table.

    Gives one row per key with the range seen and what is wrong with it.
    """
    words = F.filter(F.split(F.coalesce("finding_keys", F.lit("")), " "), lambda w: w != "")
    listed = bins.select(
        session_key, lap, at, F.explode(F.array_distinct(words)).alias("finding_key"),
        (F.size(words) != F.size(F.array_distinct(words))).alias("_repeat"))
    seen = listed.groupBy(session_key, "finding_key").agg(
        F.min(at).alias("first_bin"), F.max(at).alias("last_bin"), F.count_distinct(lap).alias("laps"),
        F.min(lap).alias("_lap"), F.bool_or("_repeat").alias("_repeat"))
    table = findings.select(session_key, "finding_key", F.col(lap).alias("_finding_lap"), "start", "end")
    return seen.join(table, [session_key, "finding_key"], "full_outer").select(
        session_key, "finding_key", "first_bin", "last_bin",
        F.when(F.col("_repeat"), "repeated_key").when(F.col("start").isNull(), "unknown_key").when(
            F.col("first_bin").isNull(), "no_bins").when(
            (F.col("laps") > 1) | (F.col("_lap") != F.col("_finding_lap")), "other_lap").when(
            (F.col("first_bin") < F.floor("start")) | (F.col("last_bin") >= F.ceil("end")), "outside_range",
        ).alias("problem"))


def lap_set_agreement(laps: DataFrame, keys: list[str]) -> DataFrame:
    """Exactly one reviewed and one best lap per bundle; comparable = reference or reviewed."""
    return laps.groupBy(*keys).agg(
        F.count_if("is_reviewed_lap").alias("reviewed"), F.count_if("is_best_valid_lap").alias("best"),
        F.count_if("is_reference").alias("references"),
        F.count_if(F.col("is_reference") | F.col("is_reviewed_lap")).alias("comparable"),
    ).withColumn("problem", F.when(F.col("reviewed") != 1, "reviewed_lap_count").when(
        F.col("best") != 1, "best_lap_count"))


def scan_text(df: DataFrame, subject: list[str], text: str, rules: tuple[tuple[str, tuple[str, ...], str], ...]
              ) -> DataFrame:
    """(subject, rule) for each pattern found anywhere in the whole text."""
    rows = df.select(*subject, text, F.lower(text).alias("_low"))
    hit = {}
    for name, words, pattern in rules:
        near = F.lit(False)
        for word in words:
            near = near | F.contains(F.col("_low"), F.lit(word))
        hit[name] = ~(near & F.col(text).rlike(pattern))
    return violations(rows, hit, subject)


def scan_files(files: DataFrame, group: str, classified: Column) -> DataFrame:
    """File policy over (path, length, and nul_bytes or content): size, extension, place, NUL bytes, group total."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ending = F.regexp_extract(name, r"(\.[a-z0-9]+)$", 1)
    if "nul_bytes" in files.columns:
        nul = F.col("nul_bytes") > 0
    elif dict(files.dtypes)["content"] == "string":
        nul = F.instr("content", "\x00") > 0
    else:
        nul = F.hex("content").rlike("^(?:..)*?00")
    single = violations(files, {
        "large-file": F.col("length") <= MAX_FILE_BYTES,
        "prohibited-extension": ~ending.isin(*PROHIBITED_EXTENSIONS),
        "environment-file": ~((name == ".env") | name.startswith(".env.")),
        "raw-telemetry": ~(name.contains("telemetry") & ending.isin(".csv", ".json", ".jsonl")) | classified,
        "nul-bytes": ~nul | ending.isin(*PROHIBITED_EXTENSIONS),
    }, ["path"])
    total = files.groupBy(group).agg(F.sum("length").alias("_t")).filter(F.col("_t") > MAX_GROUP_BYTES).select(
        F.col(group).alias("path"), F.lit("group-total-size").alias("rule"))
    return single.unionByName(total)


def bucket_fingerprints(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Content hash per key and bucket, of which a row's own hash chooses one of 256: keys, bucket, n_rows, fingerprint.

    Each row's SHA-256 is cut into four 60-bit numbers that are summed: a mergeable sum, so
    no group is ever gathered or sorted.
    """
    rows = df.select(*keys, row_hash(columns).alias("_h"))
    pieces = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"_s{i}")
              for i in range(4)]
    return rows.groupBy(*keys, F.substring("_h", 1, 2).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"), *pieces).select(
        *keys, "bucket", "n_rows",
        F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(4)]),
               256).alias("fingerprint"))


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Content hash per key that ignores row and column order: the root over its buckets' hashes."""
    leaf = F.concat_ws(":", "bucket", "fingerprint")
    return bucket_fingerprints(df, keys, columns).groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(F.sort_array(F.collect_list(leaf)), "|"), 256).alias("fingerprint"))


def differing_buckets(stored: DataFrame, rebuilt: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets in which two datasets differ, so that only their rows need to be compared: keys, bucket, and both counts."""
    on = [*keys, "bucket"]
    sides = [d.select(*on, F.lit(side).alias("_side"), "n_rows", "fingerprint") for side, d in enumerate((stored, rebuilt))]

    def of(side: int, column: str) -> Column:
        return F.max(F.when(F.col("_side") == side, F.col(column)))

    return sides[0].unionByName(sides[1]).groupBy(*on).agg(
        of(0, "n_rows").alias("stored_rows"), of(1, "n_rows").alias("rebuilt_rows"), of(0, "fingerprint").alias("_a"), of(1, "fingerprint").alias("_b"),
    ).where(~F.col("_a").eqNullSafe(F.col("_b"))).drop("_a", "_b")


def table_diff(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with the surplus on the rebuilt side.

    A signed union and one aggregation; duplicates count.
    """
    both = stored.withColumn("_sign", F.lit(-1)).unionByName(rebuilt.withColumn("_sign", F.lit(1)))
    return both.groupBy(*stored.columns).agg(F.sum("_sign").alias("surplus")).filter("surplus <> 0")


def bundle_report(laps: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """Laps by kind, bins, sampled bins and frames per bundle."""
    a = laps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("laps"), F.count_if("is_valid").alias("valid_laps"),
        F.count_if("is_reference").alias("reference_laps"), F.count_if(~F.col("is_valid")).alias("excluded_laps"))
    b = bins.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bins"), F.count_if("has_sample").alias("sampled_bins"),
        F.sum("sample_count").alias("frames"))
    return a.join(b, keys, "full_outer")
