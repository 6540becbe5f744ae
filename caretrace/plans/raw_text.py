"""Resource JSON text of ``events`` as one expression that Spark SQL and DuckDB read alike.

Every 17th event is broken in one of eight ways, chosen by ``event_id % 8``.
"""

from __future__ import annotations

BROKEN = "event_id % 17 = 0"
N = "CAST(event_id AS STRING)"
M9 = "CAST(event_id % 9 AS STRING)"


def kind_sql() -> str:
    return (
        "CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'Observation' "
        "WHEN event_type = 'signup' THEN 'Condition' ELSE 'Procedure' END"
    )


def payload_sql(iso: str) -> str:
    """``iso`` is the engine's text of ``ts``."""
    kind = kind_sql()
    head = f"""CASE WHEN {BROKEN} AND event_id % 8 = 0 THEN '' WHEN {BROKEN} AND event_id % 8 = 1 THEN '"resourceType":"Immunization",'
 ELSE '"resourceType":"' || {kind} || '",' END"""
    rid = f"""CASE WHEN {BROKEN} AND event_id % 8 = 2 THEN '' WHEN {BROKEN} AND event_id % 8 = 3 THEN 'bad id!' ELSE 'r-' || {N} END"""
    vocabulary = f"CASE {kind} WHEN 'Observation' THEN 'NOC' WHEN 'Condition' THEN 'NANDA' ELSE 'NIC' END"
    preferred = f"""CASE {kind} WHEN 'Observation' THEN '{{"system":"http://loinc.org","code":"85556-9","display":"Acuity"}}'
 ELSE '{{"system":"http://snomed.info/sct","code":"S' || {M9} || '","display":"Finding"}}' END"""
    nursing = f"""'{{"system":"urn:' || {vocabulary} || '","code":" N' || {M9} || ' ","display":"Nursing"}}'"""
    local = f"""'{{"system":"http://local","code":"X' || {M9} || '","display":"Local"}}'"""
    codings = f"""CASE event_id % 6 WHEN 0 THEN {local} || ',' || {preferred} WHEN 1 THEN {nursing} || ',' || {local}
 WHEN 2 THEN {local} || ',' || {nursing} WHEN 3 THEN '' WHEN 4 THEN {preferred} ELSE {local} END"""
    code = f"""CASE WHEN {BROKEN} AND event_id % 8 = 5 THEN '"code":{{}}'
 ELSE '"code":{{"coding":[' || {codings} || ']' || CASE WHEN event_id % 6 = 3 THEN ',"text":"free"' ELSE '' END || '}}' END"""
    subject = f"""CASE WHEN {BROKEN} AND event_id % 8 = 4 THEN 'http://elsewhere/Patient/1' WHEN {BROKEN} AND event_id % 8 = 6 THEN '12345'
 ELSE 'Patient/' || CAST(user_id AS STRING) END"""
    when = f"CASE WHEN event_id % 19 = 0 THEN 'not a date' ELSE {iso} END"
    value = """CASE event_id % 7 WHEN 0 THEN '"valueString":"high"' WHEN 1 THEN '"valueCodeableConcept":{"coding":[{"system":"urn:x","code":"LA1"}]}'
 ELSE '"valueQuantity":{"value":' || CAST(value AS STRING) || ',"unit":"score"}' END"""
    performer = """'"performer":[{' || CASE event_id % 4 WHEN 0 THEN '"function":{"coding":[{"code":"","display":"Charge Nurse"}]},'
 WHEN 1 THEN '"function":{"text":"Intern"},' WHEN 2 THEN '"function":{"coding":[{"code":"surgeon"}]},' ELSE '' END
 || '"actor":{"reference":"' || CASE event_id % 3 WHEN 0 THEN 'PractitionerRole/p' || CAST(event_id % 50 AS STRING)
 WHEN 1 THEN 'Practitioner/p' || CAST(event_id % 50 AS STRING) ELSE 'Organization/o1' END || '"}}]'"""
    tail = f"""CASE {kind} WHEN 'Observation' THEN {value} || ',' || CASE WHEN event_id % 13 = 0 THEN '"effectiveInstant"' ELSE '"effectiveDateTime"' END || ':"' || {when} || '"'
 WHEN 'Condition' THEN '"clinicalStatus":{{"coding":[{{"code":"active"}}]}},"onsetDateTime":"' || {when} || '","recordedDate":"2024-01-15"'
 ELSE {performer} || ',' || CASE WHEN event_id % 13 = 0 THEN '"performedPeriod":{{"start":"' || {when} || '"}}' ELSE '"performedDateTime":"' || {when} || '"' END END"""
    encounter = """CASE WHEN event_id % 11 = 0 THEN '' ELSE '"encounter":{"reference":"Encounter/e' || CAST(user_id AS STRING) || '"},' END"""
    profile = """CASE WHEN event_id % 5 = 0 THEN '"http://p/a"' ELSE '"http://p/b","http://p/a"' END"""
    body = (
        f"'{{' || {head} || '\"id\":\"' || {rid} || '\",\"meta\":{{\"lastUpdated\":\"' || {iso} || '\",\"profile\":[' || {profile} || ']}},' || "
        f"{code} || ',\"subject\":{{\"reference\":\"' || {subject} || '\"}},' || {encounter} || {tail} || '}}'"
    )
    return f"CASE WHEN {BROKEN} AND event_id % 8 = 7 THEN '{{broken' ELSE {body} END"
