"""Canonical observation, condition and procedure tables from raw resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.functions.columns import parse_utc
from caretrace.functions.fhir import blank_to_null, codings_at, first_coding, items_at, present_at, text_at

# Per resource type: preferred system needles, nursing vocabulary needle, terminology domain, target system.
CODING_RULES = {
    "Observation": (("loinc",), "noc", "noc_to_loinc", "http://loinc.org"),
    "Condition": (("snomed", "sct"), "nanda", "nanda_to_snomed", "http://snomed.info/sct"),
    "Procedure": (("snomed", "sct"), "nic", "nic_to_snomed", "http://snomed.info/sct"),
}


def _system(c: Column) -> Column:
    return F.lower(F.trim(c["system"]))


def _has(c: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | _system(c).contains(n)
    return out


def select_coding(rows: DataFrame, terminology: DataFrame, *, kind: str, keys: list[str], payload: str = "payload") -> DataFrame:
    """Adds ``coding`` (the chosen source coding, NULL when there is none) and ``mapped_code``.

    Order: preferred system, then the first coding with an approved mapping, then the first coding.
    Only resources that carry a nursing-vocabulary coding meet the terminology; they are exploded,
    joined on the code and folded back by their unique key. All others stay in place, unshuffled. Rows whose payload
    cannot be read drop out here; ``unreadable_payloads`` counts them.
    """
    prefer, needle, domain, _ = CODING_RULES[kind]
    terms = terminology.filter(F.col("domain") == domain).select(
        F.col("source_code").alias("_code"), F.col("target_code").alias("_target")
    )
    # Unreadable rows give NULL and drop out after the explode, so that no filter below parses the payload again.
    read = rows.withColumn("_v", F.try_parse_json(payload))
    codings = F.when(F.col("_v").isNotNull(), codings_at(F.col("_v"), "$.code"))
    coded = read.select(*rows.columns, F.explode_outer(F.array(codings)).alias("_codings")).filter(F.col("_codings").isNotNull())
    meets = F.exists("_codings", lambda c: _has(c, (needle,)))
    no_hits = F.array().cast("array<struct<pos:int,target:string>>")
    plain = coded.filter(~meets).withColumn("_hits", no_hits)
    rest = [c for c in coded.columns if c not in keys]
    exploded = coded.filter(meets).select("*", F.posexplode("_codings").alias("_pos", "_c"))
    matched = exploded.withColumn("_code", F.when(_has(F.col("_c"), (needle,)), F.trim(F.col("_c.code")))).join(
        terms, "_code", "left"
    )
    hit = F.when(F.col("_target").isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col("_target").alias("target")))
    folded = matched.groupBy(*keys).agg(
        F.first(F.struct(*rest)).alias("_r"), F.array_sort(F.collect_list(hit)).cast("array<struct<pos:int,target:string>>").alias("_hits")
    )
    needy = folded.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], "_hits")
    both = plain.select(*keys, *rest, "_hits").unionByName(needy)
    preferred = F.array_position(F.transform("_codings", lambda c: _has(c, prefer)), True)
    first_hit = first_coding(F.col("_hits"))
    index = (
        F.when(preferred > 0, preferred)
        .when(first_hit.isNotNull(), first_hit["pos"] + 1)
        .when(F.size("_codings") > 0, F.lit(1))
    )
    at_index = first_coding(F.filter("_hits", lambda h: h["pos"] + 1 == F.col("_i")))
    return (
        both.withColumn("_i", index)
        .withColumn("coding", F.when(F.col("_i").isNotNull(), F.try_element_at("_codings", F.col("_i").cast("int"))))
        .withColumn("mapped_code", at_index["target"])
        .drop("_codings", "_hits", "_i")
    )


def map_terminology(picked: DataFrame, *, kind: str) -> DataFrame:
    """Canonical code_system / code / display from ``coding`` and ``mapped_code``; source triplet kept."""
    _, needle, _, target_system = CODING_RULES[kind]
    c, mapped = F.col("coding"), F.col("mapped_code")
    nursing = _has(c, (needle,))
    system = (
        F.when(c.isNull(), F.lit("unknown"))
        .when(mapped.isNotNull(), F.lit(target_system))
        .when(nursing, F.lit("unmapped"))
        .otherwise(F.coalesce(blank_to_null(c["system"]), F.lit("unknown")))
    )
    code = (
        F.when(c.isNull(), F.lit("unknown"))
        .when(mapped.isNotNull(), mapped)
        .when(nursing, F.coalesce(blank_to_null(c["code"]), F.lit("unmapped")))
        .otherwise(F.coalesce(blank_to_null(c["code"]), F.lit("unknown")))
    )
    empty = F.lit("")
    return picked.withColumns(
        {
            "code_system": system,
            "code": code,
            "display": F.coalesce(c["display"], empty),
            "source_code_system": F.coalesce(c["system"], empty),
            "source_code": F.coalesce(c["code"], empty),
            "source_display": F.coalesce(c["display"], empty),
        }
    ).drop("coding", "mapped_code")


CANONICAL = ["code_system", "code", "display", "source_code_system", "source_code", "source_display"]


def unreadable_payloads(raw: DataFrame) -> DataFrame:
    """(resource_type, n, unreadable): rows per type and those whose payload is no JSON, which normalisation leaves out."""
    return raw.groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.try_parse_json("payload").isNull()).alias("unreadable"))


def _coded(raw: DataFrame, terminology: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    rows = raw.filter(F.col("resource_type") == kind)
    return map_terminology(select_coding(rows, terminology, kind=kind, keys=keys), kind=kind)


def normalize_observation(raw: DataFrame, terminology: DataFrame, *, keys: list[str]) -> DataFrame:
    """The value branch is chosen by which key is present, not by which value is non-NULL."""
    v = F.try_parse_json("payload")
    has_quantity, has_string = present_at(v, "$.valueQuantity"), present_at(v, "$.valueString")
    concept = first_coding(codings_at(v, "$.valueCodeableConcept"))
    effective = F.coalesce(blank_to_null(text_at(v, "$.effectiveDateTime")), text_at(v, "$.effectiveInstant"))
    return _coded(raw, terminology, "Observation", keys).select(
        *keys,
        *CANONICAL,
        F.when(has_quantity, F.try_variant_get(v, "$.valueQuantity.value", "double")).alias("value_num"),
        F.when(has_quantity, F.lit(""))
        .when(has_string, F.coalesce(text_at(v, "$.valueString"), F.lit("")))
        .otherwise(F.coalesce(concept["code"], F.lit("")))
        .alias("value_text"),
        F.when(has_quantity, F.coalesce(text_at(v, "$.valueQuantity.unit"), F.lit(""))).otherwise(F.lit("")).alias("unit"),
        parse_utc(effective).alias("effective_dt"),
    )


def normalize_condition(raw: DataFrame, terminology: DataFrame, *, keys: list[str]) -> DataFrame:
    v = F.try_parse_json("payload")
    return _coded(raw, terminology, "Condition", keys).select(
        *keys,
        *CANONICAL,
        parse_utc(text_at(v, "$.onsetDateTime")).alias("onset_dt"),
        parse_utc(text_at(v, "$.recordedDate")).alias("recorded_dt"),
        F.coalesce(first_coding(codings_at(v, "$.clinicalStatus"))["code"], F.lit("")).alias("clinical_status"),
    )


def nursing_keyword(text: Column) -> Column:
    """Substring test; short keywords also hit longer words such as "intern"."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(C.NURSING_KEYWORD_PATTERN)


def nursing_label_heuristic(procedures: DataFrame) -> DataFrame:
    hit = nursing_keyword(F.col("performer_role"))
    return procedures.withColumn("is_nursing", hit).withColumn(
        "nursing_label_method", F.when(hit, F.lit("heuristic")).otherwise(F.lit("unknown"))
    )


def actor_labels(raw: DataFrame) -> DataFrame:
    """(episode_id, actor_type, actor_id, actor_is_nursing) from practitioner resources."""
    v = F.try_parse_json("payload")
    role = F.col("resource_type") == "PractitionerRole"
    none = F.array().cast("array<variant>")
    concepts = F.when(
        role, F.concat(F.coalesce(items_at(v, "$.code"), none), F.coalesce(items_at(v, "$.specialty"), none))
    ).otherwise(F.transform(F.coalesce(items_at(v, "$.qualification"), none), lambda q: F.try_variant_get(q, "$.code", "variant")))
    texts = F.transform(concepts, lambda c: first_coding(codings_at(c, "$")))
    hit = F.exists(
        texts, lambda c: nursing_keyword(c["code"]) | nursing_keyword(c["display"]) | nursing_keyword(c["system"])
    )
    free = F.when(role, nursing_keyword(text_at(v, "$.text"))).otherwise(F.lit(False))
    return (
        raw.filter(F.col("resource_type").isin("PractitionerRole", "Practitioner"))
        .select(
            "episode_id",
            F.col("resource_type").alias("actor_type"),
            F.col("resource_id").alias("actor_id"),
            (F.coalesce(hit, F.lit(False)) | free).alias("_hit"),
        )
        .groupBy("episode_id", "actor_type", "actor_id")
        .agg(F.bool_or("_hit").alias("actor_is_nursing"))
    )


def nursing_label_deterministic(procedures: DataFrame, actors: DataFrame) -> DataFrame:
    """Actors resolved inside the episode override the role heuristic."""
    parts = F.split("performer_actor_ref", "/", 2)
    typed = F.col("performer_actor_ref").contains("/")
    keyed = procedures.withColumn("actor_type", F.when(typed, parts[0])).withColumn("actor_id", F.when(typed, parts[1]))
    sure = F.coalesce(F.col("actor_is_nursing"), F.lit(False))
    return (
        keyed.join(actors, ["episode_id", "actor_type", "actor_id"], "left")
        .withColumn("is_nursing", F.col("is_nursing") | sure)
        .withColumn("nursing_label_method", F.when(sure, F.lit("deterministic")).otherwise(F.col("nursing_label_method")))
        .drop("actor_type", "actor_id", "actor_is_nursing")
    )


def normalize_procedure(raw: DataFrame, terminology: DataFrame, *, keys: list[str], actors: DataFrame | None = None) -> DataFrame:
    """First performer only; labels from its role text and, given ``actors``, from the resolved actor."""
    v = F.try_parse_json("payload")
    p0 = "$.performer[0]"
    function = first_coding(codings_at(v, f"{p0}.function"))
    role = F.coalesce(
        blank_to_null(function["code"]), blank_to_null(function["display"]), text_at(v, f"{p0}.function.text"), F.lit("")
    )
    ref = F.coalesce(text_at(v, f"{p0}.actor.reference"), F.lit(""))
    performed = F.coalesce(blank_to_null(text_at(v, "$.performedDateTime")), text_at(v, "$.performedPeriod.start"))
    base = _coded(raw, terminology, "Procedure", keys).select(
        *keys,
        *CANONICAL,
        parse_utc(performed).alias("performed_dt"),
        role.alias("performer_role"),
        ref.alias("performer_actor_ref"),
        F.when(ref.contains("/"), F.split(ref, "/", 2)[0]).otherwise(F.lit("")).alias("performer_actor_type"),
    )
    labelled = nursing_label_heuristic(base)
    return labelled if actors is None else nursing_label_deterministic(labelled, actors)


def normalize_all(raw: DataFrame, terminology: DataFrame, *, keys: list[str]) -> dict[str, DataFrame]:
    """The three canonical tables of one raw table."""
    return {
        "observation": normalize_observation(raw, terminology, keys=keys),
        "condition": normalize_condition(raw, terminology, keys=keys),
        "procedure": normalize_procedure(raw, terminology, keys=keys, actors=actor_labels(raw)),
    }


def normalized_counts(raw: DataFrame) -> DataFrame:
    return (
        raw.filter(F.col("resource_type").isin("Observation", "Condition", "Procedure"))
        .groupBy("resource_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
