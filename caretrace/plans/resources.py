"""Registered queries of sources, validation and normalisation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrace.functions.fhir import text_at
from caretrace.operators import normalize as N
from caretrace.operators import validate as V
from caretrace.plans import windows as WP
from caretrace.plans.adapter import AS_OF, Tables
from caretrace.plans.base import emit, query, rnd, ts
from caretrace.session import shared_root
from caretrace.sources import resources as R
from caretrace.sources import tables as S

RAW_KEYS = ["event_id", "episode_id"]


def terminology(t: Tables) -> DataFrame:
    return S.load_terminology(t.terminology_configs).select("domain", "source_code", "target_code").distinct()


def recent(t: Tables) -> DataFrame:
    """Raw rows with repeating ids, some blank, for the upsert."""
    rid = F.when(F.col("event_id") % 19 == 0, F.lit(" ")).otherwise(F.concat(F.lit("k"), F.col("event_id") % 40))
    return t.raw_resources.withColumn("resource_id", rid)


# --- sources ---------------------------------------------------------------------------------


@query(
    "explode_bundles",
    """SELECT bundle_id, position, json_extract_string(payload, '$.id') AS resource_id, json_extract_string(payload, '$.resourceType') AS resource_type
    FROM v_bundle WHERE user_id % 7 <> 3""",
)
def _(t: Tables) -> DataFrame:
    v = F.try_parse_json("payload")
    rows = R.explode_bundles(t.bundles)
    return emit(rows.select("bundle_id", "position", text_at(v, "$.id").alias("resource_id"), text_at(v, "$.resourceType").alias("resource_type")))


@query(
    "raw_latest",
    f"""WITH x AS (SELECT user_id AS episode_id, CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'Observation' WHEN event_type = 'signup' THEN 'Condition' ELSE 'Procedure' END AS resource_type,
      event_id % 40 AS k, event_id % 19 = 0 AS blank, event_id, ts FROM events)
    SELECT episode_id, resource_type, 'k' || CAST(k AS STRING) AS resource_id, {ts('max(ts)', 'ingested_at')}, arg_max(event_id, ts) AS event_id FROM x WHERE NOT blank GROUP BY ALL
    UNION ALL SELECT -1, 'invalid_skipped', '', NULL, count(*) FILTER (WHERE blank) FROM x""",
)
def _(t: Tables) -> DataFrame:
    latest = R.raw_latest(recent(t), order=("ingested_at", "event_id")).select(*R.RAW_KEYS, "ingested_at", "event_id")
    skipped = R.invalid_skipped(recent(t)).select(
        F.lit(-1).alias("episode_id"),
        F.lit("invalid_skipped").alias("resource_type"),
        F.lit("").alias("resource_id"),
        F.lit(None).cast("timestamp_ntz").alias("ingested_at"),
        F.col("invalid_skipped").alias("event_id"),
    )
    return emit(latest.unionByName(skipped))


@query(
    "referenced_actors",
    """SELECT DISTINCT episode_id, CASE WHEN event_id % 3 = 0 THEN 'PractitionerRole' ELSE 'Practitioner' END AS actor_type, 'p' || CAST(event_id % 50 AS STRING) AS actor_id
    FROM v_raw WHERE kind = 'Procedure' AND payload <> '{broken' AND event_id % 3 < 2""",
)
def _(t: Tables) -> DataFrame:
    return R.referenced_actors(t.raw_resources)


@query(
    "link_encounter",
    """SELECT e.episode_id, e.unit_id, 'p' || CAST(o.pid AS STRING) AS patient_id, CASE WHEN o.k IS NOT NULL THEN 'enc-' || CAST(o.k AS STRING) END AS encounter_id
    FROM v_episode e LEFT JOIN (SELECT user_id, max(event_id) FILTER (WHERE event_id % 3 = 0) AS pid, max(event_id) AS k FROM events WHERE event_type = 'signup' GROUP BY 1) o ON o.user_id = e.episode_id""",
)
def _(t: Tables) -> DataFrame:
    e = t.raw("events").filter(F.col("event_type") == "signup")
    subject = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Patient/p"), F.col("event_id"))).otherwise(F.lit("Group/g"))
    encounters = e.select(
        F.col("user_id").alias("episode_id"),
        F.lit("Encounter").alias("resource_type"),
        F.concat(F.lit("enc-"), F.col("event_id")).alias("resource_id"),
        F.concat(F.lit('{"resourceType":"Encounter","subject":{"reference":"'), subject, F.lit('"}}')).alias("payload"),
        F.col("ts").alias("ingested_at"),
    )
    return R.link_encounter(t.episodes.select("episode_id", "unit_id"), encounters)


@query(
    "load_roster_csv",
    f"""SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS BIGINT) AS unit_id, {ts('l_shipdate', 'start_dt')}, {ts('l_shipdate + INTERVAL 12 HOUR', 'end_dt')},
    CAST(l_quantity AS BIGINT) AS rn_count, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber END AS na_count,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_orderkey % 30 AS BIGINT) END AS patient_census FROM lineitem WHERE l_orderkey % 10 > 1""",
)
def _(t: Tables) -> DataFrame:
    li = t.raw("lineitem")
    start = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")
    end = F.date_format(F.col("l_shipdate") + F.expr("INTERVAL '12' HOUR"), "yyyy-MM-dd HH:mm:ss")
    line = F.concat_ws(
        ",",
        F.when(F.col("l_orderkey") % 10 == 0, F.lit("soon")).otherwise(start),
        F.when(F.col("l_orderkey") % 10 == 1, F.lit("")).otherwise(end),
        F.col("l_quantity").cast("string"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit("")).otherwise(F.col("l_linenumber").cast("string")),
        F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_orderkey") % 30).cast("string")).otherwise(F.lit("")),
    )
    rows = li.select("l_orderkey", "l_linenumber", "l_suppkey", F.from_csv(line, S.ROSTER_SCHEMA).alias("r"))
    flat = rows.select("l_orderkey", "l_linenumber", "l_suppkey", "r.*")
    return emit(S.load_roster_csv(flat, unit_id=F.col("l_suppkey"), keep=["l_orderkey", "l_linenumber"]))


@query(
    "apply_retention",
    f"""SELECT 'anonymize' AS action, event_id, md5(CASE WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY THEN '{{"resourceType":"' || kind || '","id":"r-' || CAST(event_id AS STRING) || '","__redacted__":true,"__redacted_reason__":"retention_policy"}}' ELSE payload END) AS payload_md5,
    CASE WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY THEN false ELSE event_id % 17 <> 0 END AS validation_ok FROM v_raw
    UNION ALL SELECT 'delete', event_id, md5(payload), event_id % 17 <> 0 FROM v_raw WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY""",
)
def _(t: Tables) -> DataFrame:
    raw = t.raw_resources.withColumn("validation_issues", F.array(F.lit("x")))
    kept = [R.apply_retention(raw, now=AS_OF, days=15, action=a).withColumn("action", F.lit(a)) for a in ("anonymize", "delete")]
    both = kept[0].unionByName(kept[1])
    return both.select("action", "event_id", F.md5("payload").alias("payload_md5"), "validation_ok")


@query(
    "retention_dry_run",
    f"SELECT CASE WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY THEN 'delete' ELSE 'keep' END AS action, count(*) AS n FROM events GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    return R.retention_dry_run(t.raw_resources, now=AS_OF, days=15, action="delete")


KEYS_NOW = ["0123456789abcdef", "fedcba9876543210"]


@query("encrypt_payload", "SELECT event_id, md5(payload) AS opened_md5, true AS marked, true AS differs FROM v_raw")
def _(t: Tables) -> DataFrame:
    stored = t.raw_resources.select("event_id", "payload", R.encrypt_payload(F.col("payload"), KEYS_NOW).alias("s"))
    opened = F.md5(R.decrypt_payload(F.col("s"), KEYS_NOW)).alias("opened_md5")
    return stored.select("event_id", opened, F.col("s").startswith(R.ENC_MARK).alias("marked"), (~F.contains("s", "payload")).alias("differs"))


@query(
    "decrypt_payload",
    """SELECT event_id, md5(payload) AS payload_md5, event_id % 4 <> 3 AS readable FROM v_raw WHERE event_id % 4 <> 3
    UNION ALL SELECT event_id, NULL, false FROM v_raw WHERE event_id % 4 = 3""",
)
def _(t: Tables) -> DataFrame:
    # Current key, previous key, plain legacy text, and a key nobody holds any more.
    p, k = F.col("payload"), F.col("event_id") % 4
    stored = (
        F.when(k == 0, R.encrypt_payload(p, KEYS_NOW))
        .when(k == 1, R.encrypt_payload(p, KEYS_NOW[1:]))
        .when(k == 2, p)
        .otherwise(R.encrypt_payload(p, ["lostlostlostlost"]))
    )
    opened = t.raw_resources.select("event_id", stored.alias("s")).select("event_id", R.decrypt_payload(F.col("s"), KEYS_NOW).alias("p"))
    ok = ~F.col("p").startswith(R.ENC_MARK)
    return opened.select("event_id", F.when(ok, F.md5("p")).alias("payload_md5"), ok.alias("readable"))


@query(
    "payload_sha256",
    """SELECT event_id, sha256('{"a":{"x":' || CAST(event_id AS STRING) || ',"y":[1,2]},"id":"r-' || CAST(event_id AS STRING) || '","kind":"' || event_type || '","user":' || CAST(user_id AS STRING) || '}') AS payload_sha256 FROM events""",
)
def _(t: Tables) -> DataFrame:
    n = F.col("event_id").cast("string")
    text = F.concat(
        F.lit('{ "user" : '), F.col("user_id"), F.lit(', "kind":"'), F.col("event_type"), F.lit('", "id":"r-'), n,
        F.lit('", "a": {"y":[1, 2],  "x": '), n, F.lit("}}"),
    )
    return t.raw("events").select("event_id", R.payload_sha256(text).alias("payload_sha256"))


@query(
    "load_terminology",
    """SELECT p_partkey, d.domain, 'N' || CAST(p_partkey % 6 AS STRING) AS source_code, 'T' || CAST(p_partkey % 6 AS STRING) AS target_code
    FROM part, (SELECT unnest(['nanda_to_snomed', 'nic_to_snomed', 'noc_to_loinc']) AS domain) d WHERE p_partkey % 10 <> 9""",
)
def _(t: Tables) -> DataFrame:
    return S.load_terminology(t.terminology_configs)


@query(
    "write_features",
    f"SELECT episode_id, CAST(unit_id AS BIGINT) AS unit_id, window_index, {rnd('delta_ri', 'delta_ri')}, outcome_status FROM v_target",
)
def _(t: Tables) -> DataFrame:
    # Written twice to the shared folder: a full build, then an idempotent rebuild of some units.
    path = f"{shared_root(t.spark)}/features-{uuid.uuid4().hex}"
    rows = WP.target(t).select("episode_id", "unit_id", "window_index", "delta_ri", "outcome_status")
    S.write_features(rows, path, truncate=True)
    S.write_features(rows.filter(F.col("unit_id") % 2 == 0), path)
    return emit(t.spark.read.parquet(path))


@query(
    "batch_gate_all_or_nothing",
    """SELECT event_id, user_id AS episode_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)""",
)
def _(t: Tables) -> DataFrame:
    rows = t.raw_resources.withColumn("ok", F.col("event_id") % 97 != 0)
    return R.batch_gate_all_or_nothing(rows, ok="ok", batch="episode_id").select("event_id", "episode_id")


# --- validation ------------------------------------------------------------------------------

ISSUES_SQL = """list_filter([
 CASE WHEN broken AND m8 IN (0, 7) THEN 'resourceType:missing' END,
 CASE WHEN broken AND m8 = 2 THEN 'id:value_error.missing' END,
 CASE WHEN broken AND m8 = 1 THEN 'resourceType:value_error.resourceType' END,
 CASE WHEN broken AND m8 = 1 THEN 'resourceType:value_error.resourceType' END,
 CASE WHEN broken AND m8 = 3 THEN 'id:value_error.fhir_id' END,
 CASE WHEN broken AND m8 IN (4, 6) THEN 'reference:value_error.fhir_reference' END,
 CASE WHEN kind = 'Observation' AND NOT (broken AND m8 IN (0, 1, 7)) AND (event_id % 6 = 3 OR (broken AND m8 = 5)) THEN 'code.coding:value_error.missing' END,
 CASE WHEN kind IN ('Condition', 'Procedure') AND broken AND m8 = 5 THEN 'code:value_error.missing' END], lambda x: x IS NOT NULL)"""


@query(
    "validate_resource",
    f"""WITH x AS (SELECT event_id, kind, ts, event_id % 17 = 0 AS broken, event_id % 8 AS m8 FROM v_raw)
    SELECT event_id, array_to_string({ISSUES_SQL}, '|') AS issues, len({ISSUES_SQL}) = 0 AS validation_ok,
    {ts("CASE WHEN broken AND m8 IN (0, 7) THEN NULL ELSE ts END", 'last_updated')} FROM x""",
)
def _(t: Tables) -> DataFrame:
    out = V.validate_resource(t.raw_resources.withColumnRenamed("resource_type", "expected"), expected="expected")
    return emit(out.select("event_id", V.issue_names(F.col("issues")).alias("issues"), "validation_ok", "last_updated"))


@query(
    "validate_references",
    r"""WITH x AS (SELECT event_id, regexp_extract_all(payload, '"reference"\s*:\s*"([^"]*)"', 1) AS refs FROM v_raw),
    y AS (SELECT *, list_filter(refs, lambda r: (starts_with(r, 'http://') OR contains(r, '..') OR (NOT contains(r, '/')))) AS bad,
      list_filter(refs, lambda r: NOT regexp_matches(r, '^(Patient|Encounter|Observation|Condition|Procedure|Practitioner|PractitionerRole|RiskAssessment)/[A-Za-z0-9\-.]{1,64}$')) AS bad_secure FROM x)
    SELECT event_id, CAST(len(refs) AS BIGINT) AS n_references, array_to_string(bad, '|') AS bad_references, array_to_string(bad_secure, '|') AS bad_secure FROM y""",
)
def _(t: Tables) -> DataFrame:
    loose = V.validate_references(t.raw_resources)
    strict = F.filter(V.all_references(F.col("payload")), lambda r: V.reference_is_bad(r, secure=True))
    return emit(loose.select("event_id", "n_references", "bad_references", strict.alias("bad_secure")))


BUNDLE_SQL = """
WITH x AS (SELECT b.*, CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'Observation' WHEN event_type = 'signup' THEN 'Condition' ELSE 'Procedure' END AS kind
   FROM v_bundle b JOIN events e USING (event_id)),
i AS (SELECT bundle_id, user_id, event_id, count(*) OVER (PARTITION BY bundle_id) AS n, list_transform(list_filter([
   CASE WHEN broken AND m8 = 0 THEN 'resourceType:value_error.missing' END, CASE WHEN broken AND m8 = 1 THEN 'resourceType:value_error.resourceType' END,
   CASE WHEN broken AND m8 = 3 THEN 'id:value_error.fhir_id' END,
   CASE WHEN broken AND m8 IN (4, 6) THEN 'reference:value_error.fhir_reference' END,
   CASE WHEN kind = 'Observation' AND NOT (broken AND m8 IN (0, 1)) AND (event_id % 6 = 3 OR (broken AND m8 = 5)) THEN 'code.coding:value_error.missing' END,
   CASE WHEN kind IN ('Condition', 'Procedure') AND broken AND m8 = 5 THEN 'code:value_error.missing' END,
   CASE WHEN NOT (broken AND m8 IN (0, 1)) AND event_id % 11 = 0 THEN 'encounter:value_error.missing' END], lambda x: x IS NOT NULL),
   lambda s: 'entry.' || CAST(position AS STRING) || '.resource.' || s) AS issues FROM x),
g AS (SELECT bundle_id, user_id, max(n) AS n, flatten(list(issues)) AS issues FROM i GROUP BY ALL),
h AS (SELECT bundle_id, user_id, n, list_concat(['entry:value_error.missing'], list_sort(list_concat(issues,
   CASE WHEN user_id % 5 = 0 THEN ['entry.' || CAST(n AS STRING) || '.resource.:value_error.missing'] ELSE [] END))) AS issues FROM g)
SELECT bundle_id, CASE WHEN user_id % 7 = 3 THEN 0 ELSE n END AS n_resources, false AS has_encounter,
 CASE WHEN user_id % 7 = 3 THEN 1 ELSE len(issues) END AS n_issues,
 CASE WHEN user_id % 7 = 3 THEN 'resourceType:value_error.bundle' ELSE array_to_string(issues, '|') END AS issues FROM h"""


@query("validate_bundle", BUNDLE_SQL)
def _(t: Tables) -> DataFrame:
    return emit(V.validate_bundle(t.bundles, require_encounter=True))


@query(
    "require_profiles",
    """SELECT event_id, CASE WHEN payload = '{broken' THEN 'http://p/a|http://p/b' WHEN event_id % 5 = 0 THEN 'http://p/b' ELSE '' END AS missing_profiles,
    payload <> '{broken' AND event_id % 5 <> 0 AS profile_ok FROM v_raw""",
)
def _(t: Tables) -> DataFrame:
    out = V.require_profiles(t.raw_resources, ["http://p/a", "http://p/b"])
    return emit(out.select("event_id", "missing_profiles", "profile_ok"))


@query(
    "fhir_quality_by_episode",
    """SELECT episode_id, kind AS resource_type, count(*) AS total, count(*) FILTER (WHERE event_id % 17 <> 0) AS ok, count(*) FILTER (WHERE event_id % 17 = 0) AS bad
    FROM v_raw GROUP BY GROUPING SETS ((episode_id), (episode_id, kind))""",
)
def _(t: Tables) -> DataFrame:
    return V.fhir_quality_by_episode(t.raw_resources)


@query(
    "fhir_bad_examples",
    """WITH x AS (SELECT *, 'r-' || CAST(event_id AS STRING) AS rid FROM v_raw WHERE event_id % 17 = 0),
    y AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY kind, rid) AS n FROM x)
    SELECT episode_id, kind AS resource_type, sha256(rid) AS resource_id_sha256 FROM y WHERE n <= 50""",
)
def _(t: Tables) -> DataFrame:
    return V.bad_examples(t.raw_resources.withColumn("issues", F.lit(None))).drop("issues")


# --- normalisation ---------------------------------------------------------------------------


@query(
    "select_coding",
    """SELECT event_id, CASE choice WHEN 'none' THEN NULL ELSE source_code END AS picked_code, target_code IS NOT NULL AND choice = 'mapped' AS mapped
    FROM v_code WHERE kind = 'Observation'""",
)
def _(t: Tables) -> DataFrame:
    rows = t.raw_resources.filter(F.col("resource_type") == "Observation")
    out = N.select_coding(rows, terminology(t), kind="Observation", keys=RAW_KEYS)
    return out.select("event_id", F.col("coding.code").alias("picked_code"), F.col("mapped_code").isNotNull().alias("mapped"))


@query(
    "unreadable_payloads",
    f"""SELECT CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'Observation' WHEN event_type = 'signup' THEN 'Condition' ELSE 'Procedure' END AS resource_type,
    count(*) AS n, count(*) FILTER (WHERE r.payload = '{{broken') AS unreadable FROM v_raw r JOIN events e USING (event_id) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return N.unreadable_payloads(t.raw_resources)


@query("map_terminology", "SELECT event_id, kind AS resource_type, code_system, code, source_code FROM v_code")
def _(t: Tables) -> DataFrame:
    terms = terminology(t)
    parts = []
    for kind in N.CODING_RULES:
        rows = t.raw_resources.filter(F.col("resource_type") == kind)
        done = N.map_terminology(N.select_coding(rows, terms, kind=kind, keys=RAW_KEYS), kind=kind)
        parts.append(done.select("event_id", "resource_type", "code_system", "code", "source_code"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "normalize_observation",
    f"""SELECT c.event_id, code_system, code, source_code, {rnd("CASE WHEN c.event_id % 7 > 1 THEN e.value END", 'value_num')},
    CASE c.event_id % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'LA1' ELSE '' END AS value_text, CASE WHEN c.event_id % 7 > 1 THEN 'score' ELSE '' END AS unit, {ts('dt', 'effective_dt')}
    FROM v_code c JOIN events e USING (event_id) WHERE kind = 'Observation'""",
)
def _(t: Tables) -> DataFrame:
    out = N.normalize_observation(t.raw_resources, terminology(t), keys=RAW_KEYS)
    return emit(out.select("event_id", "code_system", "code", "source_code", "value_num", "value_text", "unit", "effective_dt"))


@query(
    "normalize_condition",
    f"""SELECT event_id, code_system, code, {ts('dt', 'onset_dt')}, '2024-01-15 00:00:00.000000' AS recorded_dt, 'active' AS clinical_status FROM v_code WHERE kind = 'Condition'""",
)
def _(t: Tables) -> DataFrame:
    out = N.normalize_condition(t.raw_resources, terminology(t), keys=RAW_KEYS)
    return emit(out.select("event_id", "code_system", "code", "onset_dt", "recorded_dt", "clinical_status"))


ROLE_SQL = "CASE event_id % 4 WHEN 0 THEN 'Charge Nurse' WHEN 1 THEN 'Intern' WHEN 2 THEN 'surgeon' ELSE '' END"
REF_SQL = """CASE event_id % 3 WHEN 0 THEN 'PractitionerRole/p' || CAST(event_id % 50 AS STRING) WHEN 1 THEN 'Practitioner/p' || CAST(event_id % 50 AS STRING) ELSE 'Organization/o1' END"""
KNOWN_SQL = """((event_id % 3 = 0 AND event_id % 2 = 0) OR (event_id % 3 = 1 AND event_id % 2 = 1)) AND (event_id % 50) % 6 < 2"""


@query(
    "normalize_procedure",
    f"""SELECT event_id, code_system, code, {ts('dt', 'performed_dt')}, {ROLE_SQL} AS performer_role, {REF_SQL} AS performer_actor_ref,
    split_part({REF_SQL}, '/', 1) AS performer_actor_type, event_id % 4 < 2 AS is_nursing, CASE WHEN event_id % 4 < 2 THEN 'heuristic' ELSE 'unknown' END AS nursing_label_method
    FROM v_code WHERE kind = 'Procedure'""",
)
def _(t: Tables) -> DataFrame:
    out = N.normalize_procedure(t.raw_resources, terminology(t), keys=RAW_KEYS)
    cols = ["code_system", "code", "performed_dt", "performer_role", "performer_actor_ref", "performer_actor_type", "is_nursing", "nursing_label_method"]
    return emit(out.select("event_id", *cols))


@query(
    "nursing_label_heuristic",
    """SELECT p_partkey, regexp_matches(lower(p_name || p_type), 'nurs|rn|enfermer|matrona|auxiliar|tcae') AS is_nursing,
    CASE WHEN regexp_matches(lower(p_name || p_type), 'nurs|rn|enfermer|matrona|auxiliar|tcae') THEN 'heuristic' ELSE 'unknown' END AS nursing_label_method
    FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Matrona ' WHEN 1 THEN 'TCAE ' ELSE '' END || p_name AS p_name, p_type FROM part)""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 5
    role = F.concat(F.when(k == 0, F.lit("Matrona ")).when(k == 1, F.lit("TCAE ")).otherwise(F.lit("")), "p_name", "p_type")
    return N.nursing_label_heuristic(t.raw("part").select("p_partkey", role.alias("performer_role"))).drop("performer_role")


@query(
    "nursing_label_deterministic",
    f"""SELECT event_id, event_id % 4 < 2 OR ({KNOWN_SQL} AND a.user_id IS NOT NULL) AS is_nursing,
    CASE WHEN {KNOWN_SQL} AND a.user_id IS NOT NULL THEN 'deterministic' WHEN event_id % 4 < 2 THEN 'heuristic' ELSE 'unknown' END AS nursing_label_method
    FROM v_code c LEFT JOIN (SELECT DISTINCT user_id, event_id % 50 AS k FROM events) a ON a.user_id = c.episode_id AND a.k = c.event_id % 50 WHERE kind = 'Procedure'""",
)
def _(t: Tables) -> DataFrame:
    actors = N.actor_labels(t.actors)
    out = N.normalize_procedure(t.raw_resources, terminology(t), keys=RAW_KEYS, actors=actors)
    return out.select("event_id", "is_nursing", "nursing_label_method")


@query(
    "parse_timestamp_utc",
    f"""WITH x AS (SELECT event_id, ts, date_trunc('second', ts) AS s, event_id % 6 AS k FROM events)
    SELECT event_id, {ts("CASE k WHEN 0 THEN ts WHEN 1 THEN s WHEN 2 THEN s - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN NULL ELSE s END", 'parsed')} FROM x""",
)
def _(t: Tables) -> DataFrame:
    from caretrace.functions.columns import parse_utc

    k = F.col("event_id") % 6
    sec = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.concat(sec, F.lit("+02:00")))
        .when(k == 3, F.date_format("ts", "yyyy-MM-dd"))
        .when(k == 4, F.lit("last tuesday"))
        .otherwise(F.concat(F.lit(" "), sec, F.lit(" ")))
    )
    return emit(t.raw("events").select("event_id", parse_utc(text).alias("parsed")))


@query(
    "normalize_all",
    """SELECT kind AS resource_type, code_system, count(*) AS n, count(dt) AS n_dated FROM v_code GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    raw = t.raw_resources.select("event_id", "episode_id", "resource_type", "resource_id", "payload")
    actors = t.actors.select(F.lit(-1).cast("long").alias("event_id"), "episode_id", "resource_type", "resource_id", "payload")
    tables = N.normalize_all(raw.unionByName(actors), terminology(t), keys=RAW_KEYS)
    stamp = {"observation": "effective_dt", "condition": "onset_dt", "procedure": "performed_dt"}
    parts = [
        df.groupBy("code_system").agg(F.count(F.lit(1)).alias("n"), F.count(stamp[k]).alias("n_dated")).withColumn("resource_type", F.lit(k.capitalize()))
        for k, df in tables.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
