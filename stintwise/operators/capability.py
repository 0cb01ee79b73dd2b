"""Channel-capability reconciliation over many variable inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.operators.audit import violations
from stintwise.operators.spread import UNKNOWN, Scale, lookup_join

# Variable types of an inventory and how a channel can be classified.
SDK_TYPES = ("Bool", "Int", "BitField", "Float", "Double")
UNAVAILABLE = "unavailable"
PARTIAL = "partial_semantically_limited"
CAR_DEPENDENT = "available_car_or_session_dependent"
# The channels of the recorder profile.
PROFILE_CHANNELS = (
    "timestamp", "brake", "throttle", "steering_angle", "speed", "gear", "rpm", "longitudinal_acceleration",
    "lateral_acceleration", "yaw_rate", "wheel_state", "tire_state", "fuel", "setup", "assists", "damage", "flags",
    "weather", "traffic", "track_conditions",
)


def inventory_problems(variables: DataFrame, snapshot: str, types: tuple[str, ...] = SDK_TYPES) -> DataFrame:
    """(snapshot, name, rule): unknown type, count below one, empty or repeated name."""
    single = violations(variables, {
        "unknown_type": F.col("sdk_type").isin(*types), "count_below_one": F.col("count") >= 1,
        "empty_name": F.col("name") != "", "missing_description": F.col("description").isNotNull(),
    }, [snapshot, "name"])
    repeated = variables.groupBy(snapshot, "name").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        snapshot, "name", F.lit("duplicate_name").alias("rule"))
    return single.unionByName(repeated)


def inventory_summary(variables: DataFrame, snapshot: str, enum_prefix: str) -> DataFrame:
    """Counts per snapshot: variables, arrays, sub-sample channels, enumerations."""
    coded = (F.col("sdk_type") == "BitField") | F.coalesce(F.col("unit").startswith(enum_prefix), F.lit(False))
    return variables.groupBy(snapshot).agg(
        F.count(F.lit(1)).alias("variables"), F.count_if(F.col("count") > 1).alias("arrays"),
        F.count_if(F.col("name").endswith("_ST")).alias("sub_sample"), F.count_if(coded).alias("enumerated"))


def inventory_members(variables: DataFrame, snapshot: str, enum_prefix: str) -> DataFrame:
    """(snapshot, list, name): the variables behind the counts of ``inventory_summary``, each name once a list.

    Rows in place of arrays, so that an inventory of any size stays divided.
    """
    coded = (F.col("sdk_type") == "BitField") | F.coalesce(F.col("unit").startswith(enum_prefix), F.lit(False))
    lists = {"arrays": F.col("count") > 1, "sub_sample": F.col("name").endswith("_ST"), "enumerated": coded}
    return variables.select(snapshot, F.explode(F.array_compact(F.array(
        *[F.when(holds, F.lit(name)) for name, holds in lists.items()]))).alias("list"), "name").distinct()


def type_counts(variables: DataFrame, snapshot: str) -> DataFrame:
    """Variables per snapshot and type."""
    return variables.groupBy(snapshot, "sdk_type").agg(F.count(F.lit(1)).alias("n"))


def verify_claims(claims: DataFrame, variables: DataFrame, snapshot: str, scale: Scale = UNKNOWN) -> DataFrame:
    """(snapshot, channel, name, rule) for claims the inventory does not bear out.

    A null in a claim's type, count or unit claims nothing about it.
    """
    facts = ("sdk_type", "count", "unit")
    table = variables.select(snapshot, "name", *[F.col(c).alias(f"_v_{c}") for c in facts], F.lit(True).alias("_known"))
    joined = lookup_join(claims, table, [snapshot, "name"], "left", [F.col("channel")], scale)
    rules = {"absent": F.col("_known").isNotNull()}
    rules.update({f"{c}_differs": F.col("_known").isNull() | F.col(c).isNull() | F.col(c).eqNullSafe(F.col(f"_v_{c}"))
                  for c in facts})
    return violations(joined, rules, [snapshot, "channel", "name"])


def capability_map(channels: DataFrame, claims: DataFrame, snapshot: str) -> DataFrame:
    """Channels with the number of variables behind them; unavailable means none.

    channels: snapshot, channel, classification, ... claims: snapshot, channel, name.
    """
    behind = claims.groupBy(snapshot, "channel").agg(F.count(F.lit(1)).alias("variables"))
    joined = channels.join(behind, [snapshot, "channel"], "left").withColumn(
        "variables", F.coalesce("variables", F.lit(0).cast("long")))
    none = F.col("variables") == 0
    return joined.withColumn("problem", F.when(
        (F.col("classification") == UNAVAILABLE) & ~none, "unavailable_with_variables").when(
        (F.col("classification") != UNAVAILABLE) & none, "available_without_variables"))


def _readiness_lists() -> dict[str, Column]:
    gap = ~F.col("supported")
    return {
        "supported": F.col("supported"),
        "expected_unavailable": F.col("classification") == UNAVAILABLE,
        "car_dependent": F.col("classification") == CAR_DEPENDENT,
        "semantically_limited": F.col("classification") == PARTIAL,
        "blocking": F.col("for_rehearsal") & gap,
        "campaign_gaps": F.col("for_campaign") & gap,
        "optional_gaps": ~F.col("for_campaign") & gap & (F.col("classification") != UNAVAILABLE),
        "partially_captured": F.col("supported") & (F.col("action") == "add_new_capture"),
    }


def readiness_members(channels: DataFrame, snapshot: str, required: tuple[str, ...] = PROFILE_CHANNELS) -> DataFrame:
    """(snapshot, list, channel, position): the channels behind the counts of ``readiness``, each once a list.

    ``position`` is the channel's place in the required list (from 1), null outside it. The list
    ``profile_missing`` has required channels that a snapshot lacks, ``profile_unknown`` channels that are not required.
    """
    listed = channels.select(snapshot, "channel", F.explode(F.array_compact(F.array(
        *[F.when(holds, F.lit(name)) for name, holds in _readiness_lists().items()],
        F.when(~F.coalesce(F.col("channel").isin(*required), F.lit(False)), F.lit("profile_unknown"))))).alias("list")).distinct()
    # Required channels are few and fixed: which a snapshot has is one aggregation of so many flags.
    has = channels.groupBy(snapshot).agg(*[F.max(F.coalesce(F.col("channel") == c, F.lit(False))).alias(f"_has_{k}") for k, c in enumerate(required)])
    missing = has.select(snapshot, F.explode(F.array_compact(F.array(
        *[F.when(~F.col(f"_has_{k}"), F.lit(c)) for k, c in enumerate(required)]))).alias("channel"), F.lit("profile_missing").alias("list"))
    place = F.array_position(F.array(*[F.lit(c) for c in required]), F.col("channel"))
    return listed.unionByName(missing).select(snapshot, "list", "channel", F.when(place > 0, place).alias("position"))


def readiness(channels: DataFrame, snapshot: str, required: tuple[str, ...] = PROFILE_CHANNELS) -> DataFrame:
    """Readiness verdict per snapshot against the required channel list.

    channels: snapshot, channel, classification, supported, action, for_rehearsal,
    for_campaign. The profile mismatch is the symmetric difference of both
    channel sets.
    """
    tally = channels.groupBy(snapshot).agg(*[F.count_if(holds).alias(name) for name, holds in _readiness_lists().items()])
    have = channels.select(snapshot, "channel").distinct()
    wanted = channels.select(snapshot).distinct().select(
        snapshot, F.explode(F.array(*[F.lit(c) for c in required])).alias("channel"))
    mismatch = have.withColumn("_h", F.lit(True)).join(
        wanted.withColumn("_w", F.lit(True)), [snapshot, "channel"], "full_outer").groupBy(snapshot).agg(
        F.count_if(F.col("_h").isNull() | F.col("_w").isNull()).alias("profile_mismatch"))
    ready = (F.col("blocking") == 0) & (F.col("profile_mismatch") == 0)
    return tally.join(mismatch, snapshot).withColumn("ready", ready).withColumn(
        "verdict", F.when(ready, "ready").otherwise("update_required"))
