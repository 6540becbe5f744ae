"""Clinical resource files: bundles, raw upserts, references, retention, encryption."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrace.functions.columns import is_blank
from caretrace.functions.fhir import canonical_json, items_at, text_at
from caretrace.functions.tables import latest_by

RAW_KEYS = ["episode_id", "resource_type", "resource_id"]


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file -> (bundle_id, payload)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("bundle_id"), F.col("value").alias("payload")
    )


def explode_bundles(bundles: DataFrame) -> DataFrame:
    """(bundle_id, position, payload) per ``entry[].resource``; anything that is not a Bundle gives no rows."""
    b = bundles.select("bundle_id", F.try_parse_json("payload").alias("_v"))
    # Texts are made where the entries are exploded, and rows are dropped after that: a filter below would parse and write
    # everything once more.
    items = F.when(text_at(F.col("_v"), "$.resourceType") == "Bundle", items_at(F.col("_v"), "$.entry"))
    texts = F.transform(items, lambda e: F.to_json(F.try_variant_get(e, "$.resource", "variant")))
    entries = b.select("bundle_id", F.posexplode_outer(texts).alias("position", "payload"))
    return entries.filter(F.col("payload").isNotNull() & ~F.col("payload").isin("null", "{}"))


def paged_resources(bundles: DataFrame, bundle_issues: DataFrame | None = None) -> DataFrame:
    """Union of all pages; bundle-level issues stay visible as synthetic ``Bundle`` rows."""
    rows = explode_bundles(bundles).withColumn("resource_type", text_at(F.try_parse_json("payload"), "$.resourceType"))
    rows = rows.withColumn("issue", F.lit(None).cast("string"))
    if bundle_issues is None:
        return rows
    synthetic = bundle_issues.select(
        "bundle_id",
        F.lit(-1).alias("position"),
        F.lit(None).cast("string").alias("payload"),
        F.lit("Bundle").alias("resource_type"),
        "issue",
    )
    return rows.unionByName(synthetic)


def raw_latest(raw: DataFrame, *, order: Sequence[str] = ("ingested_at",)) -> DataFrame:
    """Last write per (episode, type, id); rows without an id are left out."""
    return latest_by(raw.filter(~is_blank("resource_id")), RAW_KEYS, list(order))


def invalid_skipped(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count_if(is_blank("resource_id")).alias("invalid_skipped"))


def referenced_actors(raw: DataFrame) -> DataFrame:
    """Distinct practitioner references of all Procedure performers."""
    performers = raw.filter(F.col("resource_type") == "Procedure").select(
        "episode_id", F.explode(items_at(F.try_parse_json("payload"), "$.performer")).alias("_p")
    )
    ref = performers.select("episode_id", text_at(F.col("_p"), "$.actor.reference").alias("_ref"))
    parts = F.split("_ref", "/", 2)
    return (
        ref.filter(F.col("_ref").contains("/"))
        .select("episode_id", parts[0].alias("actor_type"), parts[1].alias("actor_id"))
        .filter(F.col("actor_type").isin("PractitionerRole", "Practitioner"))
        .dropDuplicates()
    )


def link_encounter(episodes: DataFrame, raw: DataFrame) -> DataFrame:
    """Episodes with the patient id and encounter id of their latest Encounter resource."""
    encounters = raw_latest(raw.filter(F.col("resource_type") == "Encounter"))
    subject = text_at(F.try_parse_json("payload"), "$.subject.reference")
    known = F.nullif(F.regexp_extract(subject, "^Patient/(.*)$", 1), F.lit(""))
    linked = (
        encounters.withColumn("_patient", known)
        .groupBy("episode_id")
        .agg(
            # An encounter without a patient subject leaves the id known so far in place.
            F.max_by("_patient", F.when(F.col("_patient").isNotNull(), F.struct("ingested_at", "resource_id"))).alias("patient_id"),
            F.max_by("resource_id", F.struct("ingested_at", "resource_id")).alias("encounter_id"),
        )
    )
    return episodes.join(linked, "episode_id", "left")


def payload_sha256(payload: Column) -> Column:
    """SHA-256 of the canonical JSON text."""
    return F.sha2(canonical_json(payload), 256)


# --- retention -------------------------------------------------------------------------------


def _expired(now: datetime | str, days: int) -> Column:
    if days <= 0:
        raise ValueError("retention days must be positive")
    return F.col("ingested_at") < F.lit(str(now)).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(days)}' DAY")


def apply_retention(raw: DataFrame, *, now: datetime | str, days: int, action: str = "delete") -> DataFrame:
    """Raw table after retention; write it to a new location and swap.

    ``delete`` drops expired rows; ``anonymize`` keeps a stub with type and id only.
    """
    expired = F.coalesce(_expired(now, days), F.lit(False))
    if action == "delete":
        return raw.filter(~expired)
    if action != "anonymize":
        raise ValueError(f"unknown action {action}")
    stub = F.to_json(
        F.struct(
            F.col("resource_type").alias("resourceType"),
            F.col("resource_id").alias("id"),
            F.lit(True).alias("__redacted__"),
            F.lit("retention_policy").alias("__redacted_reason__"),
        )
    )
    return raw.withColumns(
        {
            "payload": F.when(expired, stub).otherwise(F.col("payload")),
            "validation_ok": F.when(expired, F.lit(False)).otherwise(F.col("validation_ok")),
            "validation_issues": F.when(expired, F.array().cast("array<string>")).otherwise(F.col("validation_issues")),
        }
    )


def retention_dry_run(raw: DataFrame, *, now: datetime | str, days: int, action: str) -> DataFrame:
    effect = F.when(F.coalesce(_expired(now, days), F.lit(False)), F.lit(action)).otherwise(F.lit("keep"))
    return raw.groupBy(effect.alias("action")).agg(F.count(F.lit(1)).alias("n"))


# --- encryption ------------------------------------------------------------------------------

ENC_MARK = "enc:gcm:"


def encrypt_payload(payload: Column, keys: Sequence[str]) -> Column:
    """Encrypted text under the first (newest) key; NULL stays NULL."""
    return F.concat(F.lit(ENC_MARK), F.base64(F.aes_encrypt(F.encode(payload, "utf-8"), F.lit(keys[0]), F.lit("GCM"))))


def decrypt_payload(stored: Column, keys: Sequence[str]) -> Column:
    """Every key is tried in turn; plain legacy rows and undecryptable rows come back unchanged."""
    cipher = F.try_to_binary(F.substring(stored, len(ENC_MARK) + 1, 1 << 30), F.lit("base64"))
    tried = [F.decode(F.try_aes_decrypt(cipher, F.lit(k), F.lit("GCM")), "utf-8") for k in keys]
    return F.when(stored.startswith(ENC_MARK), F.coalesce(*tried, stored)).otherwise(stored)


# --- strict batches --------------------------------------------------------------------------


def batch_gate_all_or_nothing(rows: DataFrame, *, ok: str, batch: str | None = None) -> DataFrame:
    """Rows of batches without a single invalid row.

    Without ``batch`` the whole input is one batch, gated by one scalar subquery.
    """
    bad = ~F.coalesce(F.col(ok), F.lit(False))
    if batch is None:
        verdict = rows.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"))
        return rows.withColumn("_bad", verdict.scalar()).filter(~F.col("_bad")).drop("_bad")
    return rows.join(rows.filter(bad).select(batch).distinct(), batch, "left_anti")
