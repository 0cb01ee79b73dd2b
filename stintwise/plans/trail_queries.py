"""Trail and capability queries (groups H and I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.functions import cells
from stintwise.operators import capability, trail
from stintwise.operators.spread import literal_table, ordered_scan, position_in
from stintwise.plans.bindings import scale_of, table
from stintwise.plans.registry import query

TURN_EDGES = (("system", "user"), ("user", "assistant"), ("assistant", "user"))

CHAIN_SQL = """
WITH t AS (SELECT conv_id, turn, role AS to_state, text, sha256('7:conv_id' || coalesce(length(conv_id::VARCHAR) || ':' || conv_id, '-') || '4:role' || coalesce(strlen(role) || ':' || role, '-')
                   || '4:text' || coalesce(strlen(text) || ':' || text, '-') || '4:turn' || coalesce(length(turn::VARCHAR) || ':' || turn, '-')) AS hash FROM conversations),
s AS (SELECT *, lag(to_state) OVER w AS prior_state, lag(hash) OVER w AS prior_hash, lag(turn) OVER w AS prior_turn
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT *, CASE WHEN turn > 0 THEN CASE WHEN length(text) % 11 = 0 THEN 'user' ELSE prior_state END END AS from_state,
             CASE WHEN turn > 0 THEN CASE WHEN length(text) % 7 = 0 THEN 'tampered' ELSE prior_hash END END AS previous_hash FROM s)"""


def chain(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as chained transitions, some of them damaged."""
    rows = table(spark, sf, "conversations").withColumn("hash", trail.row_hash(["conv_id", "turn", "role", "text"])).withColumn(
        "to_state", F.col("role"))
    seen = ordered_scan(rows, ["conv_id"], ["turn"], F.floor(F.col("turn") / 4096), {
        "_s": ("previous", F.col("to_state")), "_h": ("previous", F.col("hash"))}, scale_of(sf, "conversations"))
    later = F.col("turn") > 0
    return seen.withColumns({
        "from_state": F.when(later, F.when(F.length("text") % 11 == 0, "user").otherwise(F.col("_s"))),
        "previous_hash": F.when(later, F.when(F.length("text") % 7 == 0, "tampered").otherwise(F.col("_h"))),
    }).drop("_s", "_h")


@query("h1_chain_replay", CHAIN_SQL + """
SELECT conv_id, turn, 'sequence_not_contiguous' AS rule FROM c WHERE turn <> coalesce(prior_turn + 1, 0)
UNION ALL SELECT conv_id, turn, 'from_state_mismatch' FROM c WHERE from_state IS DISTINCT FROM prior_state
UNION ALL SELECT conv_id, turn, 'previous_hash_mismatch' FROM c WHERE previous_hash IS DISTINCT FROM prior_hash
UNION ALL SELECT conv_id, turn, 'edge_not_permitted' FROM c WHERE from_state IS NOT NULL
  AND (from_state, to_state) NOT IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))""")
def h1(spark: SparkSession, sf: str) -> DataFrame:
    return trail.replay(chain(spark, sf), "conv_id", "turn", TURN_EDGES, None, scale_of(sf, "conversations"))


LIFECYCLE_SQL = """
WITH t AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'analysis_ready' WHEN '2-HIGH' THEN 'tested' WHEN '3-MEDIUM' THEN 'supported_provisionally'
      WHEN '4-NOT SPECIFIED' THEN 'inconclusive' ELSE 'rejected' END AS to_state,
    o_orderstatus IN ('F', 'O') AS bound, o_orderstatus = 'F' AS has_run, o_totalprice >= 100000 AS run_verified,
    o_totalprice >= 200000 AS run_computed,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'unreviewed' END AS review_state FROM orders)"""


def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as the transitions of one hypothesis."""
    priority = F.col("o_orderpriority")
    status = F.col("o_orderstatus")
    placed = position_in(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "seq",
                         scale_of(sf, "orders"))
    bound = status.isin("F", "O")
    return placed.select(
        "o_custkey", "o_orderkey", "seq",
        F.when(priority == "1-URGENT", "analysis_ready").when(priority == "2-HIGH", "tested").when(
            priority == "3-MEDIUM", "supported_provisionally").when(
            priority == "4-NOT SPECIFIED", "inconclusive").otherwise("rejected").alias("to_state"),
        bound.alias("has_protocol"), bound.alias("has_evidence"), bound.alias("has_definition"),
        (status == "F").alias("has_run"), (F.col("o_totalprice") >= 100000).alias("run_verified"),
        (F.col("o_totalprice") >= 200000).alias("run_computed"),
        F.when(status == "F", "approved").when(status == "O", "pending").otherwise("unreviewed").alias("review_state"))


@query("h1_lifecycle_edges", LIFECYCLE_SQL + """,
p AS (SELECT *, lag(to_state) OVER (PARTITION BY o_custkey ORDER BY seq) AS from_state FROM t)
SELECT o_custkey, seq, 'edge_not_permitted' AS rule FROM p WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (
  ('generated', 'analysis_ready'), ('analysis_ready', 'tested'), ('tested', 'supported_provisionally'), ('tested', 'rejected'),
  ('tested', 'inconclusive'), ('tested', 'replication_required'), ('replication_required', 'tested'),
  ('supported_provisionally', 'replication_required'), ('supported_provisionally', 'rejected'),
  ('supported_provisionally', 'inconclusive'), ('inconclusive', 'analysis_ready'))""")
def h1_edges(spark: SparkSession, sf: str) -> DataFrame:
    scale = scale_of(sf, "orders")
    rows = ordered_scan(lifecycle(spark, sf), ["o_custkey"], ["seq"], F.floor(F.col("seq") / 4096),
                        {"from_state": ("previous", F.col("to_state"))}, scale)
    same = rows.withColumns({"hash": F.lit(None).cast("string"), "previous_hash": F.lit(None).cast("string")})
    return trail.replay(same, "o_custkey", "seq", trail.LIFECYCLE_EDGES, None, scale)


@query("h2_row_hashes", """
SELECT conv_id, turn FROM conversations WHERE role = 'system' AND upper(text) <> text""")
def h2(spark: SparkSession, sf: str) -> DataFrame:
    # The stored hash of system turns was taken over upper-case text.
    cols = ["conv_id", "turn", "role", "text"]
    rows = table(spark, sf, "conversations")
    spoilt = rows.withColumn("text", F.when(F.col("role") == "system", cells.simple_upper(F.col("text"))).otherwise(F.col("text")))
    stored = spoilt.select("conv_id", "turn", trail.row_hash(cols).alias("hash"))
    return trail.hash_mismatches(rows.join(stored, ["conv_id", "turn"]), ["conv_id", "turn"], "hash", cols)


@query("h3_state_entry_rules", LIFECYCLE_SQL + """,
e AS (SELECT *, to_state IN ('tested', 'supported_provisionally', 'rejected', 'inconclusive', 'replication_required') AS bearing FROM t)
SELECT o_orderkey, 'ready_needs_bindings' AS rule FROM e WHERE to_state = 'analysis_ready' AND NOT bound
UNION ALL SELECT o_orderkey, 'ready_before_run' FROM e WHERE to_state = 'analysis_ready' AND has_run
UNION ALL SELECT o_orderkey, 'evidence_needs_bindings' FROM e WHERE bearing AND NOT (bound AND has_run)
UNION ALL SELECT o_orderkey, 'run_not_verified' FROM e WHERE bearing AND has_run AND NOT run_verified
UNION ALL SELECT o_orderkey, 'not_reviewed' FROM e WHERE bearing AND review_state = 'unreviewed'
UNION ALL SELECT o_orderkey, 'support_needs_approval' FROM e WHERE to_state = 'supported_provisionally' AND review_state <> 'approved'
UNION ALL SELECT o_orderkey, 'support_needs_result' FROM e WHERE to_state = 'supported_provisionally' AND NOT run_computed
UNION ALL SELECT o_orderkey, 'inconclusive_needs_review' FROM e WHERE to_state = 'inconclusive' AND run_computed AND review_state NOT IN ('approved', 'pending')""")
def h3(spark: SparkSession, sf: str) -> DataFrame:
    return trail.entry_rules(lifecycle(spark, sf), ["o_orderkey"])


@query("h4_registry_summary", LIFECYCLE_SQL + """
SELECT o_custkey, arg_max(to_state, seq) AS state, count(*) AS transitions, count(*) FILTER (to_state <> 'analysis_ready') AS evidence_bearing
FROM t GROUP BY o_custkey""")
def h4(spark: SparkSession, sf: str) -> DataFrame:
    return trail.registry_summary(lifecycle(spark, sf), "o_custkey", ["seq"])


# The same expressions run in both engines.
FINDING_COLUMNS = {
    "synthetic": "o_custkey % 10 = 0",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'provisional' ELSE 'rejected' END",
    "scientific_gate": "CASE o_orderpriority WHEN '1-URGENT' THEN 'passed' WHEN '2-HIGH' THEN 'passed' "
                       "WHEN '3-MEDIUM' THEN 'failed' ELSE 'unresolved' END",
    "reproducibility_gate": "CASE WHEN o_totalprice >= 100000 THEN 'passed' ELSE 'failed' END",
    "structural_gate": "CASE WHEN o_totalprice >= 50000 THEN 'passed' ELSE 'failed' END",
    "review_state": "CASE WHEN o_custkey % 2 = 0 THEN 'approved' ELSE 'pending' END",
    "replication": "CASE WHEN o_custkey % 3 = 0 THEN 'required_before_validation' ELSE 'not_required' END",
    "analysis_state": "CASE WHEN o_totalprice >= 200000 THEN 'computed' ELSE 'inconclusive' END",
    "hypothesis_state": "CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'supported_provisionally' ELSE 'tested' END",
}
FINDINGS_SQL = "WITH f AS (SELECT o_orderkey, " + ", ".join(
    f"{e} AS {n}" for n, e in FINDING_COLUMNS.items()) + " FROM orders)"


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as findings with the gates and reviews of their validations."""
    return table(spark, sf, "orders").selectExpr("o_orderkey", *[f"{e} AS {n}" for n, e in FINDING_COLUMNS.items()])


@query("h5_recommendation", FINDINGS_SQL + """
SELECT o_orderkey, CASE WHEN synthetic THEN 'do_not_implement'
  WHEN status = 'validated' AND scientific_gate = 'passed' AND reproducibility_gate = 'passed' AND review_state = 'approved'
       AND replication <> 'required_before_validation' THEN 'engineering_review_candidate'
  WHEN replication = 'required_before_validation' AND analysis_state = 'computed' THEN 'replication_required'
  WHEN status = 'provisional' AND hypothesis_state = 'supported_provisionally' THEN 'investigate' ELSE 'none' END AS recommendation FROM f""")
def h5(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).select("o_orderkey", trail.recommendation().alias("recommendation"))


@query("h6_finding_validation_agreement", """
WITH v AS (SELECT CASE WHEN p_retailprice < 1000 THEN p_partkey ELSE -p_partkey END AS p_partkey, p_brand, CASE WHEN p_size > 40 THEN p_size + 1 ELSE p_size END AS p_size,
                  CASE WHEN p_type = 'ECONOMY' THEN NULL ELSE p_type END AS p_type FROM part),
j AS (SELECT p.*, v.p_partkey IS NOT NULL AS known, v.p_size AS vs, v.p_type AS vt FROM part p LEFT JOIN v USING (p_partkey))
SELECT p_partkey, 'validation_missing' AS rule FROM j WHERE NOT known
UNION ALL SELECT p_partkey, 'p_size_differs' FROM j WHERE known AND p_size IS DISTINCT FROM vs
UNION ALL SELECT p_partkey, 'p_type_differs' FROM j WHERE known AND p_type IS DISTINCT FROM vt""")
def h6(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    # Validations of dear parts are filed under another key, so they count as missing.
    artifacts = parts.withColumns({
        "p_partkey": F.when(F.col("p_retailprice") < 1000, F.col("p_partkey")).otherwise(-F.col("p_partkey")),
        "p_size": F.when(F.col("p_size") > 40, F.col("p_size") + 1).otherwise(F.col("p_size")),
        "p_type": F.when(F.col("p_type") != "ECONOMY", F.col("p_type"))})
    return trail.disagreements(parts, artifacts, ["p_partkey"], ["p_brand", "p_size", "p_type"], scale_of(sf, "part"))


@query("h6_gate_rules", FINDINGS_SQL + """
SELECT o_orderkey, 'validated_without_gates' AS rule FROM f WHERE status = 'validated' AND NOT (scientific_gate = 'passed' AND reproducibility_gate = 'passed' AND review_state = 'approved')
UNION ALL SELECT o_orderkey, 'provisional_without_structure' FROM f WHERE status = 'provisional' AND NOT (structural_gate = 'passed' AND review_state = 'approved')
UNION ALL SELECT o_orderkey, 'rejected_without_evidence' FROM f WHERE status = 'rejected' AND NOT (scientific_gate = 'failed' AND review_state = 'approved')
UNION ALL SELECT o_orderkey, 'unresolved_not_inconclusive' FROM f WHERE scientific_gate = 'unresolved' AND status <> 'inconclusive'
UNION ALL SELECT o_orderkey, 'scientific_before_others' FROM f WHERE scientific_gate = 'passed' AND NOT (structural_gate = 'passed' AND reproducibility_gate = 'passed')
UNION ALL SELECT o_orderkey, 'scientific_without_review' FROM f WHERE scientific_gate = 'passed' AND review_state <> 'approved'
UNION ALL SELECT o_orderkey, 'synthetic_promoted' FROM f WHERE synthetic AND (scientific_gate = 'passed' OR review_state = 'approved')""")
def h6_gates(spark: SparkSession, sf: str) -> DataFrame:
    return trail.gate_rules(findings(spark, sf), ["o_orderkey"])


@query("h7_export_references", """
WITH p AS (SELECT CASE WHEN p_retailprice < 2000 THEN p_partkey ELSE -p_partkey END AS p_partkey, p_type = 'ECONOMY' AS synthetic, CASE WHEN p_size > 25 THEN 'validated' ELSE 'provisional' END AS status, p_size > 10 AS safe
           FROM part),
g AS (SELECT l_orderkey, count(*) FILTER (p.p_partkey IS NULL) AS dangling, bool_or(synthetic) AS synthetic, bool_and(status = 'validated') AS val, bool_and(safe) AS safe
      FROM lineitem LEFT JOIN p ON p_partkey = l_partkey GROUP BY l_orderkey),
a AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'recommended' WHEN 'O' THEN 'not_recommended' ELSE 'provisional' END AS recommendation, o_orderpriority = '1-URGENT' AS a_safe, g.* FROM orders JOIN g ON l_orderkey = o_orderkey)
SELECT o_orderkey AS algorithm_id, 'dangling_reference' AS rule FROM a WHERE dangling > 0
UNION ALL SELECT o_orderkey, 'synthetic_support' FROM a WHERE coalesce(synthetic, false) AND (recommendation <> 'not_recommended' OR a_safe)
UNION ALL SELECT o_orderkey, 'recommended_without_validation' FROM a WHERE recommendation = 'recommended' AND NOT coalesce(val, true)
UNION ALL SELECT o_orderkey, 'safe_without_safe_findings' FROM a WHERE a_safe AND NOT coalesce(safe, true)""")
def h7(spark: SparkSession, sf: str) -> DataFrame:
    references = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("algorithm_id"), F.col("l_partkey").alias("finding_id"))
    filed = F.when(F.col("p_retailprice") < 2000, F.col("p_partkey")).otherwise(-F.col("p_partkey"))
    evidence = table(spark, sf, "part").select(
        filed.alias("finding_id"), (F.col("p_type") == "ECONOMY").alias("synthetic"),
        F.when(F.col("p_size") > 25, "validated").otherwise("provisional").alias("status"),
        (F.col("p_size") > 10).alias("safe"))
    algorithms = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("algorithm_id"),
        F.when(F.col("o_orderstatus") == "F", "recommended").when(F.col("o_orderstatus") == "O", "not_recommended")
        .otherwise("provisional").alias("recommendation"),
        (F.col("o_orderpriority") == "1-URGENT").alias("safe"))
    return trail.export_references(references, evidence, algorithms, scale_of(sf, "lineitem"))


@query("h7_unreferenced_artifacts", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def h7_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return trail.unreferenced(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), used, ["o_orderkey"])


@query("h8_first_seen_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
SELECT doc_id, line, min(pos) AS first_at, count(*) AS n FROM l GROUP BY doc_id, line""")
def h8(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return trail.first_seen(lines.withColumn("pos", F.col("pos").cast("long")), ["doc_id"], "line", "pos")


@query("h9_expected_versus_observed", """
WITH o AS (SELECT event_type AS path, count(*) AS value FROM events GROUP BY 1),
e(path, kind, value) AS (SELECT event_type, 'equals', count(value) FILTER (value > 1) FROM events GROUP BY 1
   UNION ALL VALUES ('click', 'at_least', 1000000000), ('view', 'at_least', 1), ('refund', 'equals', 1))
SELECT path, kind, e.value AS expected, o.value AS observed,
       CASE WHEN o.value IS NULL THEN 'nothing_observed' WHEN kind = 'at_least' THEN 'below_expected' ELSE 'differs' END AS problem
FROM e LEFT JOIN o USING (path)
WHERE o.value IS NULL OR (kind = 'at_least' AND o.value < e.value) OR (kind = 'equals' AND o.value <> e.value)""")
def h9(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("event_type").alias("path"), "value")
    observed = events.groupBy("path").agg(F.count(F.lit(1)).alias("value"))
    known = events.groupBy("path").agg(F.count_if(F.col("value") > 1).alias("value")).withColumn("kind", F.lit("equals"))
    fixed = literal_table(spark, "path string, kind string, value bigint",
                          [("click", "at_least", 1000000000), ("view", "at_least", 1), ("refund", "equals", 1)])
    return trail.expectation_mismatches(known.unionByName(fixed), observed, ["path"])


WILDCARDS = [
    ("*.3.1", "at_least", 2), ("click.*.2", "equals", 1), ("view.4.*", "at_least", 3), ("*.*.*", "at_least", 1), ("refund.*.*", "equals", 1),
    ("*.5.*", "one_of_each", None), ("click.1.1", "equals", 0), ("*", "at_least", 1), ("purchase", "one_of_each", None)]


@query("h9_wildcard_expectations", """
WITH o AS (SELECT event_type || '.' || user_id % 10 || '.' || dayofmonth(ts) AS path, count(*) AS value FROM events GROUP BY 1
           UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1),
e(pattern, kind, expected) AS (VALUES """ + ", ".join(
    f"('{p}', '{k}', {'NULL' if v is None else v}::BIGINT)" for p, k, v in WILDCARDS) + """),
f AS (SELECT pattern, kind, expected, path, value AS observed FROM e JOIN o
      ON regexp_full_match(path, replace(replace(pattern, '.', '[.]'), '*', '[^.]+')))
SELECT *, CASE kind WHEN 'equals' THEN 'differs' ELSE 'below_expected' END AS problem FROM f
WHERE (kind = 'equals' AND observed <> expected) OR (kind = 'at_least' AND observed < expected)
UNION ALL SELECT pattern, kind, any_value(expected), min(path), arg_min(observed, path), 'ambiguous' FROM f
WHERE kind = 'one_of_each' GROUP BY pattern, kind HAVING count(*) > 1
UNION ALL SELECT pattern, kind, expected, NULL, NULL, 'nothing_observed' FROM e WHERE pattern NOT IN (SELECT pattern FROM f)""")
def h9_wildcards(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_type", F.concat_ws(
        ".", "event_type", (F.col("user_id") % 10).cast("string"), F.dayofmonth("ts").cast("string")).alias("path"))
    observed = events.groupBy("path").agg(F.count(F.lit(1)).alias("value")).unionByName(
        events.groupBy(F.col("event_type").alias("path")).agg(F.count(F.lit(1)).alias("value")))
    return trail.wildcard_mismatches(literal_table(spark, "pattern string, kind string, value bigint", WILDCARDS), observed)


# ------------------------------------------------------------------ capability

INVENTORY_SQL = """
WITH inv AS (SELECT p_brand AS snapshot, p_name || CASE WHEN p_size % 10 = 0 THEN '_ST' ELSE '' END AS name,
  CASE p_type WHEN 'ECONOMY' THEN 'Float' WHEN 'STANDARD' THEN 'Int' WHEN 'PROMO' THEN 'BitField' WHEN 'SMALL' THEN 'Bool' ELSE p_type END AS sdk_type,
  p_size - 3 AS "count", CASE WHEN p_size > 25 THEN 'irsdk_' || p_type ELSE 'm/s' END AS unit, p_name AS description, p_partkey FROM part)"""


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as the variables of one inventory per brand."""
    kind = F.col("p_type")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("snapshot"),
        F.concat("p_name", F.when(F.col("p_size") % 10 == 0, "_ST").otherwise("")).alias("name"),
        F.when(kind == "ECONOMY", "Float").when(kind == "STANDARD", "Int").when(kind == "PROMO", "BitField").when(
            kind == "SMALL", "Bool").otherwise(kind).alias("sdk_type"),
        (F.col("p_size") - 3).alias("count"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("irsdk_"), kind)).otherwise("m/s").alias("unit"),
        F.col("p_name").alias("description"), "p_partkey")


def distinct_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """One variable per (snapshot, name): the one with the smallest part key."""
    return inventory(spark, sf).groupBy("snapshot", "name").agg(
        F.min_by(F.struct("sdk_type", "count", "unit"), "p_partkey").alias("v")).select("snapshot", "name", "v.*")


@query("i1_inventory_problems", INVENTORY_SQL + """
SELECT snapshot, name, 'unknown_type' AS rule FROM inv WHERE sdk_type NOT IN ('Bool', 'Int', 'BitField', 'Float', 'Double')
UNION ALL SELECT snapshot, name, 'count_below_one' FROM inv WHERE "count" < 1
UNION ALL SELECT snapshot, name, 'duplicate_name' FROM inv GROUP BY snapshot, name HAVING count(*) > 1""")
def i1(spark: SparkSession, sf: str) -> DataFrame:
    return capability.inventory_problems(inventory(spark, sf), "snapshot")


@query("i2_inventory_summary", INVENTORY_SQL + """
SELECT snapshot, count(*) AS variables, count(*) FILTER ("count" > 1) AS arrays, count(*) FILTER (name LIKE '%\\_ST' ESCAPE '\\') AS sub_sample,
       count(*) FILTER (sdk_type = 'BitField' OR unit LIKE 'irsdk%') AS enumerated FROM inv GROUP BY snapshot""")
def i2(spark: SparkSession, sf: str) -> DataFrame:
    return capability.inventory_summary(inventory(spark, sf), "snapshot", "irsdk_")


@query("i2_type_counts", INVENTORY_SQL + """
SELECT snapshot, sdk_type, count(*) AS n FROM inv GROUP BY snapshot, sdk_type""")
def i2_types(spark: SparkSession, sf: str) -> DataFrame:
    return capability.type_counts(inventory(spark, sf), "snapshot")


CLAIMS_SQL = INVENTORY_SQL + """,
v AS (SELECT snapshot, name, arg_min(sdk_type, p_partkey) AS sdk_type, arg_min("count", p_partkey) AS "count", arg_min(unit, p_partkey) AS unit FROM inv GROUP BY ALL),
claims AS (SELECT DISTINCT 'Brand#' || (1 + s_suppkey % 25) AS snapshot, CASE WHEN l_quantity >= 25 THEN 'speed' ELSE 'brake' END AS channel, p_name AS name,
                  'Float' AS sdk_type, CASE WHEN l_linenumber = 1 THEN 8 END AS "count", NULL::VARCHAR AS unit
           FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)"""


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """What line items say about variables: one claim per supplier brand, channel and name."""
    return (
        table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .select(F.concat(F.lit("Brand#"), 1 + F.col("s_suppkey") % 25).alias("snapshot"),
                F.when(F.col("l_quantity") >= 25, "speed").otherwise("brake").alias("channel"), F.col("p_name").alias("name"),
                F.lit("Float").alias("sdk_type"), F.when(F.col("l_linenumber") == 1, 8).alias("count"),
                F.lit(None).cast("string").alias("unit")).distinct())


@query("i3_claims_versus_inventory", CLAIMS_SQL + """,
j AS (SELECT c.*, v.name IS NOT NULL AS known, v.sdk_type AS vt, v."count" AS vc FROM claims c LEFT JOIN v USING (snapshot, name))
SELECT snapshot, channel, name, 'absent' AS rule FROM j WHERE NOT known
UNION ALL SELECT snapshot, channel, name, 'sdk_type_differs' FROM j WHERE known AND sdk_type <> vt
UNION ALL SELECT snapshot, channel, name, 'count_differs' FROM j WHERE known AND "count" <> vc""")
def i3(spark: SparkSession, sf: str) -> DataFrame:
    return capability.verify_claims(claims(spark, sf), distinct_inventory(spark, sf), "snapshot", scale_of(sf, "lineitem"))


CHANNELS_SQL = CLAIMS_SQL + """,
brands AS (SELECT p_brand AS snapshot, sum(p_size) AS s FROM part GROUP BY 1),
channels AS (
  SELECT snapshot, 'speed' AS channel, CASE WHEN s % 2 = 0 THEN 'directly_available' ELSE 'unavailable' END AS classification,
         s % 3 > 0 AS supported, CASE WHEN s % 5 = 0 THEN 'add_new_capture' ELSE 'none' END AS action, true AS for_rehearsal, true AS for_campaign FROM brands
  UNION ALL SELECT snapshot, 'damage', 'unavailable', false, 'none', false, false FROM brands
  UNION ALL SELECT snapshot, 'weather', 'partial_semantically_limited', s % 2 = 0, 'add_new_capture', false, s % 7 = 0 FROM brands
  UNION ALL SELECT snapshot, 'turbo', 'available_car_or_session_dependent', true, 'none', false, false FROM brands WHERE s % 4 = 0)"""


def channels(spark: SparkSession, sf: str) -> DataFrame:
    """A few channel declarations per brand, varied by the brand's total part size."""
    brands = table(spark, sf, "part").groupBy(F.col("p_brand").alias("snapshot")).agg(F.sum("p_size").alias("s"))
    return brands.selectExpr("snapshot", "s", """stack(4,
        'speed', CASE WHEN s % 2 = 0 THEN 'directly_available' ELSE 'unavailable' END, s % 3 > 0,
                 CASE WHEN s % 5 = 0 THEN 'add_new_capture' ELSE 'none' END, true, true,
        'damage', 'unavailable', false, 'none', false, false,
        'weather', 'partial_semantically_limited', s % 2 = 0, 'add_new_capture', false, s % 7 = 0,
        'turbo', 'available_car_or_session_dependent', true, 'none', false, false)
        AS (channel, classification, supported, action, for_rehearsal, for_campaign)""").filter(
        "channel <> 'turbo' or s % 4 = 0").drop("s")


@query("i4_capability_map", CHANNELS_SQL + """,
b AS (SELECT snapshot, channel, count(*) AS variables FROM claims GROUP BY ALL)
SELECT c.*, coalesce(b.variables, 0) AS variables,
       CASE WHEN classification = 'unavailable' AND b.variables IS NOT NULL THEN 'unavailable_with_variables'
            WHEN classification <> 'unavailable' AND b.variables IS NULL THEN 'available_without_variables' END AS problem
FROM channels c LEFT JOIN b USING (snapshot, channel)""")
def i4(spark: SparkSession, sf: str) -> DataFrame:
    return capability.capability_map(channels(spark, sf), claims(spark, sf), "snapshot")


@query("i5_readiness", CHANNELS_SQL + """,
t AS (SELECT snapshot, count(*) FILTER (supported) AS supported, count(*) FILTER (classification = 'unavailable') AS expected_unavailable,
        count(*) FILTER (classification = 'available_car_or_session_dependent') AS car_dependent,
        count(*) FILTER (classification = 'partial_semantically_limited') AS semantically_limited,
        count(*) FILTER (for_rehearsal AND NOT supported) AS blocking, count(*) FILTER (for_campaign AND NOT supported) AS campaign_gaps,
        count(*) FILTER (NOT for_campaign AND NOT supported AND classification <> 'unavailable') AS optional_gaps,
        count(*) FILTER (supported AND action = 'add_new_capture') AS partially_captured,
        count(*) FILTER (channel = 'turbo') AS profile_mismatch FROM channels GROUP BY snapshot)
SELECT *, blocking = 0 AND profile_mismatch = 0 AS ready, CASE WHEN blocking = 0 AND profile_mismatch = 0 THEN 'ready' ELSE 'update_required' END AS verdict FROM t""")
def i5(spark: SparkSession, sf: str) -> DataFrame:
    return capability.readiness(channels(spark, sf), "snapshot", ("speed", "damage", "weather"))


@query("i2_inventory_lists", INVENTORY_SQL + """
SELECT DISTINCT snapshot, u.list, name FROM inv, LATERAL (VALUES ('arrays', "count" > 1), ('sub_sample', name LIKE '%\\_ST' ESCAPE '\\'),
  ('enumerated', sdk_type = 'BitField' OR unit LIKE 'irsdk%')) u(list, holds) WHERE u.holds""")
def i2_lists(spark: SparkSession, sf: str) -> DataFrame:
    return capability.inventory_members(inventory(spark, sf), "snapshot", "irsdk_")


@query("i5_readiness_lists", CHANNELS_SQL + """,
wanted(channel, position) AS (VALUES ('speed', 1), ('damage', 2), ('turbo', 3), ('brake_bias', 4)),
l AS (SELECT DISTINCT snapshot, u.list, channel FROM channels, LATERAL (VALUES
        ('supported', supported), ('expected_unavailable', classification = 'unavailable'),
        ('car_dependent', classification = 'available_car_or_session_dependent'),
        ('semantically_limited', classification = 'partial_semantically_limited'),
        ('blocking', for_rehearsal AND NOT supported), ('campaign_gaps', for_campaign AND NOT supported),
        ('optional_gaps', NOT for_campaign AND NOT supported AND classification <> 'unavailable'),
        ('partially_captured', supported AND action = 'add_new_capture'),
        ('profile_unknown', channel NOT IN (SELECT channel FROM wanted))) u(list, holds) WHERE u.holds
      UNION ALL
      SELECT snapshot, 'profile_missing', w.channel FROM (SELECT DISTINCT snapshot FROM channels) s, wanted w
      WHERE NOT EXISTS (SELECT 1 FROM channels c WHERE c.snapshot = s.snapshot AND c.channel = w.channel))
SELECT l.snapshot, l.list, l.channel, CAST(w.position AS BIGINT) AS position FROM l LEFT JOIN wanted w ON l.channel = w.channel""")
def i5_lists(spark: SparkSession, sf: str) -> DataFrame:
    return capability.readiness_members(channels(spark, sf), "snapshot", ("speed", "damage", "turbo", "brake_bias"))
