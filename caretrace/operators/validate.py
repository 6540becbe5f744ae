"""Resource rules: per-resource invariants, references, bundles, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.functions.columns import compact, parse_utc, string_array
from caretrace.functions.fhir import items_at, text_at

ISSUE = "struct<loc:string,type:string,severity:string,layer:string>"


def issue(condition: Column, loc: str, kind: str, *, severity: str = "error", layer: str = "basic") -> Column:
    return F.when(
        condition,
        F.struct(F.lit(loc).alias("loc"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(layer).alias("layer")),
    )


def all_references(payload: Column) -> Column:
    """Every nested ``reference`` text of a resource."""
    return F.regexp_extract_all(payload, F.lit(r'"reference"\s*:\s*"([^"]*)"'), F.lit(1))


def reference_is_bad(ref: Column, *, secure: bool = False) -> Column:
    ref = F.trim(ref)
    outside = ref.startswith("http://") | ref.startswith("https://") | ref.contains("..")
    opaque = ref.startswith("urn:uuid:") | ref.startswith("urn:oid:") | ref.startswith("#")
    unsafe = F.lit(True) if secure else ~ref.contains("/")
    return (ref != "") & (outside | (~opaque & ~ref.rlike(C.REFERENCE_PATTERN) & unsafe))


def validate_references(rows: DataFrame, *, payload: str = "payload", secure: bool = False) -> DataFrame:
    """Adds ``n_references`` and ``bad_references``."""
    refs = all_references(F.col(payload))
    return rows.withColumn("n_references", F.size(refs)).withColumn(
        "bad_references", F.filter(refs, lambda r: reference_is_bad(r, secure=secure))
    )


def _facts(v: Column, payload: Column, kind: Column, *, secure: bool) -> dict[str, Column]:
    """What the rules of one resource read, as columns: each is worked out once a row and not once per rule that reads it."""
    code = F.try_variant_get(v, "$.code", "variant")
    code_text = text_at(v, "$.code")
    code_object = F.try_variant_get(v, "$.code", "map<string,variant>")
    codings = items_at(v, "$.code.coding")
    notes = F.transform(
        F.coalesce(items_at(v, "$.note"), F.array().cast("array<variant>")), lambda n: F.coalesce(text_at(n, "$.text"), F.lit(""))
    )
    said = F.lower(F.concat_ws(" ", F.array_join(notes, " "), F.coalesce(text_at(v, "$.text.div"), F.lit(""))))
    exposes = F.exists(
        F.coalesce(items_at(v, "$.prediction"), F.array().cast("array<variant>")),
        lambda p: F.try_variant_get(p, "$.probabilityDecimal", "variant").isNotNull()
        | F.try_variant_get(p, "$.probabilityRange", "variant").isNotNull()
        | F.try_variant_get(p, "$.qualitativeRisk", "variant").isNotNull(),
    )
    return {
        "_kind": kind,
        "_rid": text_at(v, "$.id"),
        "_has_coding": F.coalesce(F.size(codings) > 0, F.lit(False)),
        "_has_text": F.coalesce(text_at(v, "$.code.text") != "", F.lit(False)),
        # A falsy code (absent, null, "", [], {}) counts as an empty object.
        "_not_object": code.isNotNull() & code_object.isNull() & ~F.coalesce(code_text.isin("", "0", "false"), F.lit(True)),
        "_bad_refs": F.size(F.filter(all_references(payload), lambda r: reference_is_bad(r, secure=secure))) > 0,
        "_open_risk": F.when(kind == "RiskAssessment", ~said.contains("shadow-only") | exposes),
    }


def _local_issues() -> list[Column]:
    """Findings of the rules of one resource on the columns of :func:`_facts`."""
    kind, resource_id, not_object, has_coding = (F.col(c) for c in ("_kind", "_rid", "_not_object", "_has_coding"))
    known = F.coalesce(F.trim(kind), F.lit("")) != ""
    return [
        issue(~known, "resourceType", "value_error.missing"),
        issue(known & ~kind.isin(list(C.RESOURCE_TYPES)), "resourceType", "value_error.resourceType"),
        issue(known & (resource_id != "") & ~resource_id.rlike(C.RESOURCE_ID_PATTERN), "id", "value_error.fhir_id"),
        issue(known & F.col("_bad_refs"), "reference", "value_error.fhir_reference"),
        issue((kind == "Observation") & not_object, "code", "value_error.code"),
        issue((kind == "Observation") & ~not_object & ~has_coding, "code.coding", "value_error.missing"),
        issue(kind.isin("Condition", "Procedure") & (not_object | ~(has_coding | F.col("_has_text"))), "code", "value_error.missing"),
        issue(F.col("_open_risk"), "RiskAssessment", "value_error.shadow_only"),
    ]


def validate_resource(
    rows: DataFrame,
    *,
    payload: str = "payload",
    expected: str | None = None,
    secure: bool = False,
    profiles: Sequence[str] = (),
) -> DataFrame:
    """Adds resource_type, resource_id, validation_ok, issues and last_updated to rows of JSON text.

    ``expected`` names a column with the wanted type. ``profiles`` switches the strict profile rule on.
    """
    v, kind, rid = F.col("_v"), F.col("_kind"), F.col("_rid")
    facts = _facts(v, F.col(payload), text_at(v, "$.resourceType"), secure=secure)
    if profiles:
        facts["_no_profile"] = missing_profiles(v, profiles) != F.array().cast("array<string>")
    readable = kind.isNotNull()
    checks = [
        issue(~readable, "resourceType", "missing"),
        issue(readable & (rid.isNull() | (rid == "")) & (kind != "Bundle"), "id", "value_error.missing"),
    ]
    if expected:
        checks.append(issue(readable & (kind != F.col(expected)), "resourceType", "value_error.resourceType"))
    local = [F.when(readable, i) for i in _local_issues()]
    if profiles:
        local.append(F.when(readable & (kind != "Bundle"), issue(F.col("_no_profile"), "meta.profile", "value_error.profile", layer="strict")))
    return (
        rows.withColumn("_v", F.try_parse_json(payload))
        .withColumns({**facts, "_updated": text_at(v, "$.meta.lastUpdated")})
        .withColumns({"resource_type": kind, "resource_id": rid, "issues": compact(*checks, *local), "last_updated": F.when(readable, parse_utc("_updated"))})
        .withColumn("validation_ok", ~F.exists("issues", lambda i: i["severity"] == "error"))
        .drop("_v", "_updated", *facts)
    )


def missing_profiles(v: Column, required: Sequence[str]) -> Column:
    have = F.coalesce(F.try_variant_get(v, "$.meta.profile", "array<string>"), F.array().cast("array<string>"))
    return F.array_except(string_array(required), have)


def require_profiles(rows: DataFrame, required: Sequence[str], *, payload: str = "payload") -> DataFrame:
    """Adds ``missing_profiles`` and ``profile_ok``."""
    return rows.withColumn("missing_profiles", missing_profiles(F.try_parse_json(payload), required)).withColumn(
        "profile_ok", F.size("missing_profiles") == 0
    )


def issue_names(issues: Column) -> Column:
    """``loc:type`` texts in order."""
    return F.transform(issues, lambda i: F.concat(i["loc"], F.lit(":"), i["type"]))


def validate_bundle(
    bundles: DataFrame, *, require_encounter: bool = False, secure: bool = False
) -> DataFrame:
    """(bundle_id, n_resources, has_encounter, n_issues, issues) with entry-prefixed resource issues."""
    v = F.try_parse_json("payload")
    parsed = bundles.select("bundle_id", v.alias("_v")).withColumn("_bundle", F.coalesce(text_at(F.col("_v"), "$.resourceType") == "Bundle", F.lit(False)))
    # A bundle without entries, and what is no bundle, go on as one row without a position: nothing is read twice.
    items = F.when(F.col("_bundle"), items_at(F.col("_v"), "$.entry"))
    entries = (
        parsed.select("bundle_id", "_bundle", F.posexplode_outer(items).alias("_pos", "_e"))
        .withColumn("_r", F.try_variant_get("_e", "$.resource", "variant"))
        .withColumn("_json", F.to_json("_r"))
    )
    r, kind = F.col("_r"), F.col("_kind")
    usable = F.coalesce(~F.col("_json").isin("null", "{}"), F.lit(False)) & F.coalesce(F.col("_json").startswith("{"), F.lit(False))
    facts = _facts(r, F.col("_json"), F.coalesce(text_at(r, "$.resourceType"), F.lit("")), secure=secure)
    facts |= {"_usable": usable, "_encounter": F.coalesce(F.trim(text_at(r, "$.encounter.reference")), F.lit(""))}
    checks = [F.when(F.col("_usable"), i) for i in _local_issues()]
    checks.append(issue(~F.col("_usable"), "", "value_error.missing"))
    if require_encounter:
        wants = kind.isin("Observation", "Condition", "Procedure", "RiskAssessment")
        checks.append(issue(F.col("_usable") & wants & (F.col("_encounter") == ""), "encounter", "value_error.missing"))
    named = F.transform(
        compact(*checks), lambda i: F.concat(F.lit("entry."), F.col("_pos"), F.lit(".resource."), i["loc"], F.lit(":"), i["type"])
    )
    # Rows without an id have no entries of their own.
    there = F.col("_pos").isNotNull() & F.col("bundle_id").isNotNull()
    per_entry = entries.withColumns(facts).select(
        "bundle_id",
        F.when(F.coalesce(F.col("_pos"), F.lit(0)) == 0, F.col("_bundle")).alias("_first"),
        (there & F.col("_usable")).alias("_ok"),
        (there & F.col("_usable") & (kind == "Encounter")).alias("_enc"),
        F.when(there, named).alias("_i"),
    )
    per_bundle = per_entry.groupBy("bundle_id").agg(
        F.count_if("_first").alias("_bundles"),
        F.count_if(~F.col("_first")).alias("_others"),
        F.count_if("_ok").alias("n_resources"),
        F.bool_or("_enc").alias("_has"),
        F.array_sort(F.flatten(F.collect_list("_i"))).alias("_entry_issues"),
    )
    # One row per row of the input: an id that comes twice has the entries of both in each.
    times = lambda flag, n: F.array_repeat(F.lit(flag), F.col(n).cast("int"))
    out = per_bundle.withColumn("_bundle", F.explode(F.concat(times(True, "_bundles"), times(False, "_others"))))
    has = F.coalesce("_has", F.lit(False))
    top = compact(
        F.when(~F.col("_bundle"), F.lit("resourceType:value_error.bundle")),
        F.when(F.col("_bundle") & F.lit(require_encounter) & ~has, F.lit("entry:value_error.missing")),
    )
    issues = F.concat(top, F.coalesce("_entry_issues", F.array().cast("array<string>")))
    return out.select(
        "bundle_id",
        F.coalesce("n_resources", F.lit(0)).alias("n_resources"),
        has.alias("has_encounter"),
        F.size(issues).alias("n_issues"),
        issues.alias("issues"),
    )


def fhir_quality_by_episode(raw: DataFrame) -> DataFrame:
    """total / ok / bad per episode (resource_type NULL) and per episode and type, in one pass."""
    ok = F.coalesce(F.col("validation_ok"), F.lit(False))
    return (
        raw.groupingSets([["episode_id"], ["episode_id", "resource_type"]], "episode_id", "resource_type")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"))
    )


def bad_examples(raw: DataFrame, *, limit: int = 50) -> DataFrame:
    """Up to ``limit`` invalid resources per episode with hashed ids.

    A bounded top-k: candidates are cut per (episode, salt) before the final cut, so one episode with
    most of the invalid rows is not ranked in a single task.
    """
    from pyspark.sql import Window

    bad = raw.filter(~F.coalesce(F.col("validation_ok"), F.lit(False))).withColumn(
        "_salt", F.pmod(F.xxhash64("resource_id"), F.lit(64))
    )
    order = [F.col("resource_type"), F.col("resource_id")]
    first = bad.withColumn("_n", F.row_number().over(Window.partitionBy("episode_id", "_salt").orderBy(*order))).filter(
        F.col("_n") <= limit
    )
    return (
        first.withColumn("_n", F.row_number().over(Window.partitionBy("episode_id").orderBy(*order)))
        .filter(F.col("_n") <= limit)
        .select("episode_id", "resource_type", F.sha2("resource_id", 256).alias("resource_id_sha256"), "issues")
    )
