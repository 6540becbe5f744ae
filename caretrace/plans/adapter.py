"""Views of the driver tables in the shapes the operators expect, in Spark and in DuckDB SQL.

Every view reads the given tables; nothing is generated beside the shift calendar of the roster,
which is spread over the units of ``nation``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrace import constants as C
from caretrace.plans.raw_text import kind_sql, payload_sql

AS_OF = "2024-02-01 00:00:00"
WINDOW_HOURS = 24
FOLLOW_UP_HOURS = 72
LOINC = "http://loinc.org"
ROSTER_START = "2024-01-01 00:00:00"


class Tables:
    """Lazy views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def units(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("unit_id"), F.col("n_regionkey").alias("hospital_id"))

    @cached_property
    def episodes(self) -> DataFrame:
        e = self.raw("events").select("user_id", "ts", "event_id", "event_type", "value")
        bought = F.col("event_type") == "purchase"
        order = F.when(bought, F.struct("ts", "event_id"))
        spans = e.groupBy(F.col("user_id").alias("episode_id")).agg(
            F.min("ts").alias("admission"),
            F.max("ts").alias("_last"),
            F.min_by("value", order).alias("ri_initial"),
            F.max_by("value", order).alias("ri_final"),
        )
        # One episode in ten is still open.
        discharge = F.when(F.col("episode_id") % 10 != 0, F.col("_last"))
        patients = self.raw("customer").select(F.col("c_custkey").alias("episode_id"), F.col("c_nationkey").alias("unit_id"))
        return spans.join(patients, "episode_id").join(self.units, "unit_id").select(
            "episode_id", "unit_id", "hospital_id", "admission", discharge.alias("discharge"), "ri_initial", "ri_final"
        )

    @cached_property
    def observations(self) -> DataFrame:
        kind = F.col("event_type")
        code = (
            F.when(kind == "purchase", F.when(F.col("event_id") % 29 == 0, F.lit("RI")).otherwise(F.lit(C.ACUITY_CODE)))
            .when(kind == "view", F.lit("8867-4"))
            .otherwise(F.lit("8480-6"))
        )
        return self.raw("events").filter(kind.isin("purchase", "view", "click")).select(
            F.col("event_id").alias("obs_id"),
            F.col("user_id").alias("episode_id"),
            F.when(F.col("event_id") % 31 == 0, F.lit("urn:local")).otherwise(F.lit(LOINC)).alias("code_system"),
            code.alias("code"),
            F.when(kind == "purchase", F.lit("Acuity")).otherwise(F.lit("Vital")).alias("display"),
            F.when(F.col("event_id") % 23 != 0, F.col("value")).alias("value_num"),
            F.col("ts").alias("effective_dt"),
        )

    @cached_property
    def procedures(self) -> DataFrame:
        nursing = F.col("event_type") == "error"
        return self.raw("events").filter(F.col("event_type").isin("signup", "error")).select(
            F.col("event_id").alias("proc_id"),
            F.col("user_id").alias("episode_id"),
            F.col("ts").alias("performed_dt"),
            F.when(nursing, F.lit("Registered Nurse")).when(F.col("event_id") % 7 == 0, F.lit("Intern")).otherwise(F.lit("")).alias("performer_role"),
            F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("Practitioner/nurse-"), F.col("event_id") % 7)).alias("performer_actor_ref"),
            nursing.alias("is_nursing"),
        )

    @cached_property
    def shifts(self) -> DataFrame:
        days = self.units.select("unit_id", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("day"))
        halves = days.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
        start = F.lit(ROSTER_START).cast("timestamp_ntz") + F.make_dt_interval(F.col("day"), F.col("half") * 12)
        return halves.select(
            (F.col("unit_id") * 1000 + F.col("day") * 10 + F.col("half")).alias("shift_id"),
            "unit_id",
            start.alias("start_dt"),
            (start + F.expr("INTERVAL '12' HOUR")).alias("end_dt"),
            (1 + (F.col("unit_id") + F.col("day")) % 4).alias("rn_count"),
            (F.col("unit_id") % 3).alias("na_count"),
            F.when((F.col("unit_id") + F.col("day")) % 5 != 0, 1 + F.col("day") % 6).alias("patient_census"),
        )

    @cached_property
    def raw_resources(self) -> DataFrame:
        """Events as stored resource texts."""
        iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
        return self.raw("events").select(
            F.col("event_id"),
            F.col("user_id").alias("episode_id"),
            F.expr(kind_sql()).alias("resource_type"),
            F.concat(F.lit("r-"), F.col("event_id")).alias("resource_id"),
            F.expr(payload_sql(iso)).alias("payload"),
            F.col("ts").alias("ingested_at"),
            (F.col("event_id") % 17 != 0).alias("validation_ok"),
        )

    @cached_property
    def actors(self) -> DataFrame:
        """Practitioner resources of every episode."""
        a = self.raw("events").select(F.col("user_id").alias("episode_id"), (F.col("event_id") % 50).alias("k")).distinct()
        kind = F.when(F.col("k") % 2 == 0, F.lit("PractitionerRole")).otherwise(F.lit("Practitioner"))
        word = F.when(F.col("k") % 6 < 2, F.lit("nurse")).otherwise(F.lit("physician"))
        coding = F.concat(F.lit('{"coding":[{"system":"http://role","code":"'), word, F.lit('"}]}'))
        inner = F.when(F.col("k") % 2 == 0, F.concat(F.lit('"code":['), coding, F.lit("]"))).otherwise(
            F.concat(F.lit('"qualification":[{"code":'), coding, F.lit("}]"))
        )
        return a.select(
            "episode_id",
            kind.alias("resource_type"),
            F.concat(F.lit("p"), F.col("k")).alias("resource_id"),
            F.concat(F.lit('{"resourceType":"'), kind, F.lit('",'), inner, F.lit("}")).alias("payload"),
        )

    @cached_property
    def bundles(self) -> DataFrame:
        """One bundle per episode and day; every fifth also has an empty entry, every seventh is not a Bundle."""
        day = F.date_format("ingested_at", "yyyy-MM-dd")
        r = self.raw_resources.filter(~F.col("payload").startswith("{broken")).withColumn("day", day)
        entry = F.concat(F.lit('{"resource":'), F.col("payload"), F.lit("}"))
        b = r.groupBy("episode_id", "day").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))), lambda x: x["e"]).alias("es")
        )
        kind = F.when(F.pmod(F.col("episode_id"), F.lit(7)) == 3, F.lit("Parameters")).otherwise(F.lit("Bundle"))
        odd = F.when(F.col("episode_id") % 5 == 0, F.lit(',{"resource":{}}')).otherwise(F.lit(""))
        return b.select(
            F.concat("episode_id", F.lit("/"), "day").alias("bundle_id"),
            F.concat(F.lit('{"resourceType":"'), kind, F.lit('","entry":['), F.array_join("es", ","), odd, F.lit("]}")).alias("payload"),
        )

    @cached_property
    def terminology_configs(self) -> DataFrame:
        """One small mapping document per part."""
        k = (F.col("p_partkey") % 6).cast("string")
        pair = F.concat(F.lit('" N'), k, F.lit('":"T'), k, F.lit(' "'))
        text = F.concat(
            F.lit('{"nanda_to_snomed":{'), pair, F.lit('},"nic_to_snomed":{'), pair, F.lit(',"":"x"},"noc_to_loinc":{'), pair, F.lit(',"y":""}}')
        )
        text = F.when(F.col("p_partkey") % 10 == 9, F.lit("{bad")).otherwise(text)
        return self.raw("part").select("p_partkey", text.alias("config"))

    @cached_property
    def cohort(self) -> DataFrame:
        """Order lines as cohort rows for models and effects."""
        li = self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_suppkey"
        )
        return li.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
            F.col("l_orderkey").alias("episode_id"),
            F.col("l_suppkey").alias("unit_id"),
            F.col("l_quantity").alias("nurse_hppd"),
            F.col("l_discount").alias("nurse_skillmix"),
            F.col("l_tax").alias("ri_initial"),
            (F.col("l_extendedprice") / 1000.0).alias("delta_ri"),
            F.col("l_returnflag").alias("flag"),
        )

    @cached_property
    def feat(self) -> DataFrame:
        """Order lines as feature rows with missing flags."""
        li = self.raw("lineitem")
        k, n = F.col("l_orderkey"), F.col("l_linenumber")
        hr = ((k + n) % 9 == 0).cast("double")
        return li.select(
            (k * 10 + n).alias("row_id"),
            k.alias("episode_id"),
            F.col("l_suppkey").alias("unit_id"),
            F.col("l_shipdate").alias("start_dt"),
            (F.col("l_shipdate") + F.expr("INTERVAL '12' HOUR")).alias("end_dt"),
            F.col("l_quantity").alias("nurse_hppd"),
            F.col("l_discount").alias("nurse_skillmix"),
            F.col("l_tax").alias("ri_initial"),
            (n % 4).cast("double").alias("nurse_proc_count"),
            (n % 3).cast("double").alias("nurse_proc_count_det"),
            F.when(k % 50 != 0, F.col("l_extendedprice") / 1000.0).alias("delta_ri"),
            hr.alias("missing_vs_hr_last"),
            F.when(k % 3 != 0, hr).alias("missing_loinc_8867_4"),
            (k % 8 == 0).cast("double").alias("missing_loinc_85556_9_t0"),
            (k % 10 == 0).cast("double").alias("missing_loinc_85556_9_t1"),
        )

    @cached_property
    def guarded(self) -> DataFrame:
        """Orders as rows with a temporal specification; ``order % 16`` picks the defect."""
        k, d = F.col("o_orderkey") % 16, F.col("o_orderdate")
        iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        h = lambda n: F.expr(f"INTERVAL '{n}' HOUR")
        full = F.create_map(
            F.lit("temporal_spec_version"), F.lit(C.TEMPORAL_SPEC_VERSION),
            F.lit("index_time"), iso(F.when(k == 5, d + h(13)).otherwise(d)),
            F.lit("feature_window_start"), iso(F.when(k == 2, d + h(13)).otherwise(d)),
            F.lit("feature_window_end"), F.when(k == 1, F.lit("soon")).otherwise(iso(d + h(12))),
            F.lit("outcome_window_start"), iso(F.when(k == 4, d + h(11)).otherwise(d + h(12))),
            F.lit("outcome_window_end"), iso(F.when(k == 3, d + h(11)).otherwise(d + h(24))),
            F.lit("censoring_reason"), F.when(k == 7, F.lit("discharged_before_outcome_window_end")).otherwise(F.lit("not_censored")),
            F.lit("outcome_status"), F.when(k == 6, F.lit(C.STATUS_LEGACY)).otherwise(F.lit(C.STATUS_DEFENSIBLE)),
        )
        stamps = F.create_map(
            F.lit("sbp"), F.when(k == 10, iso(d + h(14))).otherwise(iso(d)),
            F.lit("hr"), F.when(k == 9, F.lit("yesterday")).when(k == 10, iso(d + h(13))).when(k == 11, F.lit("")).otherwise(iso(d + h(12))),
        )
        return self.raw("orders").select(
            F.col("o_orderkey").alias("row_id"),
            F.when(k == 0, F.map_filter(full, lambda a, b: ~a.isin("censoring_reason", "index_time"))).otherwise(full).alias("temporal_spec"),
            stamps.alias("feature_timestamps"),
            (d + h(12)).alias("feature_window_end"),
            F.when(k != 8, F.col("o_totalprice")).alias("delta_ri"),
        )

    @cached_property
    def external(self) -> DataFrame:
        """Orders as rows of an outside feature provider."""
        k = F.col("o_orderkey")
        base = F.create_map(
            F.lit("ri_initial"), F.col("o_totalprice") / 3e5,
            F.lit("nurse_hppd"), (F.col("o_custkey") % 10).cast("double"),
            F.lit("proc_count"), F.when(k % 7 != 0, (k % 5).cast("double")),
            F.lit("nurse_skillmix"), F.lit(0.5),
        )
        no_ts = F.lit(None).cast("timestamp_ntz")
        return self.raw("orders").select(
            k.alias("idx"),
            F.when(k % 9 != 0, F.concat(F.lit("x"), k)).alias("row_id"),
            F.when(k % 4 != 0, F.concat(F.lit("e"), F.col("o_custkey"))).alias("episode_id"),
            F.lit(None).cast("string").alias("window_id"),
            F.when(k % 5 == 0, F.lit("pk")).alias("patient_key"),
            (F.col("o_custkey") % 25).alias("unit_id"),
            F.when(k % 2 == 0, F.col("o_orderdate") - F.expr("INTERVAL '1' HOUR")).alias("start_dt"),
            no_ts.alias("end_dt"),
            F.col("o_orderdate").alias("clinical_timestamp"),
            F.when(k % 19 != 0, F.col("o_orderdate")).alias("recorded_timestamp"),
            F.when(k % 6 == 1, F.map_filter(base, lambda a, b: a != "nurse_skillmix")).otherwise(base).alias("features"),
            F.create_map(F.lit("ri_initial"), F.when(k % 11 == 0, F.lit(" Yes ")).otherwise(F.lit("no")), F.lit("missing_gcs"), F.when(k % 3 == 0, F.lit("1"))).alias("missingness_flags"),
            F.lit(None).cast("map<string,double>").alias("staff_shares"),
            F.lit(None).cast("double").alias("staff_reliability"),
            F.when(k % 13 == 0, F.lit("v0")).otherwise(F.lit("v1")).alias("contract_version"),
            F.lit("feeds").alias("source_repo"),
            F.when(k % 17 == 0, F.lit("window")).otherwise(F.lit("episode")).alias("source_grain"),
            (k % 23 != 0).alias("shadow_mode"),
            F.lit(True).alias("non_individual_use"),
        )

    @cached_property
    def components(self) -> DataFrame:
        """Orders as rows of normalised components; some are unavailable."""
        k, x = F.col("o_orderkey"), F.col("o_totalprice")
        return self.raw("orders").select(
            k.alias("row_id"),
            F.lit("episode").alias("grain"),
            F.col("o_custkey").alias("episode_id"),
            F.when(k % 10 != 0, x / 3e5 - 0.8).alias("benefit"),
            F.when(k % 15 != 1, (k % 7 - 3) / 2.0).alias("attribution"),
            F.when(k % 3 != 0, (k % 5 - 2) / 4.0).alias("causal"),
            F.when(k % 20 != 3, (k % 11 - 5) / 3.0).alias("quality"),
            F.when(k % 25 != 4, (k % 9 - 4) / 2.0).alias("uncertainty"),
            F.when(k % 25 != 4, (k % 100) / 100.0).alias("raw_uncertainty"),
            F.when(k % 12 == 0, F.lit(0.4)).otherwise(F.lit(0.0)).alias("low_support_burden"),
            F.when(k % 14 == 0, F.lit(0.2)).when(k % 2 == 0, F.lit(0.0)).alias("ood_burden"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Orders as scored rows."""
        o = self.raw("orders").join(self.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        status = (
            F.when(F.col("o_orderstatus") == "F", F.lit("complete"))
            .when(F.col("o_orderstatus") == "O", F.lit("provisional"))
            .otherwise(F.lit("insufficient_evidence"))
        )
        score = F.when(
            F.col("o_orderstatus") != "P", F.lit(100.0) / (F.lit(1.0) + F.exp(-(F.col("o_totalprice") - 2e5) / 1e5))
        )
        return o.select(
            F.col("o_orderkey").alias("row_id"),
            F.col("o_orderkey").cast("string").alias("episode_id"),
            F.concat(F.lit("w"), F.col("o_orderkey") % 500).alias("window_id"),
            F.concat(F.lit("p"), F.col("o_custkey")).alias("patient_key"),
            F.col("c_nationkey").alias("unit_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("start_dt"),
            score.alias("score"),
            status.alias("status"),
            (F.col("o_custkey") % 3).cast("double").alias("severity_weight"),
            F.when(F.col("o_orderkey") % 4 == 0, F.lit(0.5)).otherwise(F.lit(1.0)).alias("exposure_share"),
            F.when(
                F.col("o_orderkey") % 10 != 0,
                F.create_map(F.concat(F.lit("nurse-"), F.col("o_custkey") % 7), F.lit(1.0)),
            ).alias("staff_shares"),
            F.create_map(
                F.lit("benefit"),
                F.col("o_totalprice") / 1e5,
                F.lit("quality"),
                F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 9).cast("double")),
            ).alias("components"),
            F.filter(
                F.array(
                    F.when(F.col("o_orderstatus") == "O", F.lit("causal_unavailable_score_is_provisional")),
                    F.when(F.col("o_orderkey") % 6 == 0, F.lit("low_support")),
                ),
                lambda x: x.isNotNull(),
            ).alias("warnings"),
        )


# DuckDB definitions of the same views, in dependency order.
CTES: dict[str, str] = {
    "v_unit": "SELECT n_nationkey AS unit_id, n_regionkey AS hospital_id FROM nation",
    "v_episode": """
SELECT e.user_id AS episode_id, u.unit_id, u.hospital_id, e.admission,
       CASE WHEN e.user_id % 10 <> 0 THEN e.last_ts END AS discharge, e.ri_initial, e.ri_final
FROM (SELECT user_id, min(ts) AS admission, max(ts) AS last_ts,
             arg_min(value, ts) FILTER (WHERE event_type = 'purchase') AS ri_initial,
             arg_max(value, ts) FILTER (WHERE event_type = 'purchase') AS ri_final
      FROM events GROUP BY user_id) e
JOIN customer c ON c.c_custkey = e.user_id JOIN v_unit u ON u.unit_id = c.c_nationkey""",
    "v_obs": """
SELECT event_id AS obs_id, user_id AS episode_id,
       CASE WHEN event_id % 31 = 0 THEN 'urn:local' ELSE 'http://loinc.org' END AS code_system,
       CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 29 = 0 THEN 'RI' ELSE '85556-9' END
                       WHEN 'view' THEN '8867-4' ELSE '8480-6' END AS code,
       CASE WHEN event_type = 'purchase' THEN 'Acuity' ELSE 'Vital' END AS display,
       CASE WHEN event_id % 23 <> 0 THEN value END AS value_num, ts AS effective_dt
FROM events WHERE event_type IN ('purchase', 'view', 'click')""",
    "v_proc": """
SELECT event_id AS proc_id, user_id AS episode_id, ts AS performed_dt,
       CASE WHEN event_type = 'error' THEN 'Registered Nurse' WHEN event_id % 7 = 0 THEN 'Intern' ELSE '' END AS performer_role,
       CASE WHEN event_id % 10 <> 0 THEN 'Practitioner/nurse-' || CAST(event_id % 7 AS VARCHAR) END AS performer_actor_ref,
       event_type = 'error' AS is_nursing
FROM events WHERE event_type IN ('signup', 'error')""",
    "v_shift": """
SELECT unit_id * 1000 + day * 10 + half AS shift_id, unit_id,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(day * 24 + half * 12) AS start_dt,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(day * 24 + half * 12 + 12) AS end_dt,
       1 + (unit_id + day) % 4 AS rn_count, unit_id % 3 AS na_count,
       CASE WHEN (unit_id + day) % 5 <> 0 THEN 1 + day % 6 END AS patient_census
FROM v_unit, (SELECT unnest(range(0, 31)) AS day), (SELECT unnest([0, 1]) AS half)""",
    "v_espec": """
SELECT *, admission AS feature_window_start,
       least(admission + INTERVAL 24 HOUR, coalesce(discharge, TIMESTAMP '2024-02-01 00:00:00')) AS feature_window_end
FROM v_episode""",
    "v_window": """
SELECT e.*, CAST(i AS INTEGER) AS window_index, e.admission + to_hours(i * 24) AS start_dt,
       least(e.admission + to_hours(i * 24 + 24), e.last_dt) AS end_dt
FROM (SELECT *, coalesce(discharge, TIMESTAMP '2024-02-01 00:00:00') AS last_dt FROM v_episode) e,
     (SELECT unnest(range(0, 60)) AS i)
WHERE e.admission + to_hours(i * 24) < e.last_dt""",
    "v_wspec": """
SELECT *, end_dt AS outcome_start,
       CASE WHEN discharge IS NULL THEN NULL ELSE least(discharge, end_dt + INTERVAL 72 HOUR) END AS outcome_end,
       CASE WHEN discharge IS NULL THEN 'open_episode_outcome_window_unobserved'
            WHEN discharge < end_dt + INTERVAL 72 HOUR THEN 'discharged_before_outcome_window_end'
            ELSE 'not_censored' END AS censoring_reason
FROM v_window""",
    "v_series": """
SELECT episode_id, obs_id, effective_dt, value_num FROM v_obs
WHERE value_num IS NOT NULL AND lower(code_system) LIKE '%loinc%' AND (code = '85556-9' OR lower(code) IN ('rothman', 'ri'))""",
    "v_overlap": """
SELECT w.episode_id, w.window_index, w.unit_id, s.shift_id, greatest(s.start_dt, w.start_dt) AS overlap_start,
       least(s.end_dt, w.end_dt) AS overlap_end,
       (epoch_us(least(s.end_dt, w.end_dt)) - epoch_us(greatest(s.start_dt, w.start_dt))) / 3600000000.0 AS overlap_hours,
       s.rn_count, s.na_count, s.patient_census
FROM v_window w JOIN v_shift s ON s.unit_id = w.unit_id AND s.end_dt > w.start_dt AND s.start_dt < w.end_dt""",
    "v_census": """
SELECT o.*, greatest(coalesce(o.patient_census, c.n, 0), 1) AS census FROM v_overlap o LEFT JOIN
 (SELECT q.unit_id, q.overlap_start, q.overlap_end, count(*) AS n
  FROM (SELECT DISTINCT unit_id, overlap_start, overlap_end FROM v_overlap WHERE patient_census IS NULL) q
  JOIN v_episode e ON e.unit_id = q.unit_id AND e.admission <= q.overlap_end
       AND (e.discharge IS NULL OR e.discharge >= q.overlap_start) GROUP BY ALL) c
 ON c.unit_id = o.unit_id AND c.overlap_start = o.overlap_start AND c.overlap_end = o.overlap_end""",
    "v_staff": """
SELECT episode_id, window_index, sum(greatest(rn_count + na_count, 0) * overlap_hours) AS nurse_hours,
       sum(greatest(rn_count, 0) * overlap_hours) AS rn_hours, sum(census * overlap_hours) AS patient_hours
FROM v_census GROUP BY ALL""",
    "v_bounds": """
SELECT w.*, CASE WHEN s.n >= 2 THEN s.a END AS ri_start, CASE WHEN s.n >= 2 THEN s.b END AS ri_end
FROM v_wspec w LEFT JOIN
 (SELECT w.episode_id, w.window_index, count(*) AS n, arg_min(p.value_num, p.effective_dt) AS a, arg_max(p.value_num, p.effective_dt) AS b
  FROM v_wspec w JOIN v_series p ON p.episode_id = w.episode_id AND p.effective_dt BETWEEN w.outcome_start AND w.outcome_end
  GROUP BY ALL) s USING (episode_id, window_index)""",
    "v_target": """
SELECT *, ri_end - ri_start AS delta_ri,
       CASE WHEN ri_start IS NULL OR ri_end IS NULL THEN 'insufficient_outcome_evidence' ELSE 'defensible_fixed_horizon' END AS outcome_status,
       CAST(ri_start IS NULL AS BIGINT) AS missing_t0, CAST(ri_end IS NULL AS BIGINT) AS missing_t1,
       CAST(ri_start IS NULL OR ri_end IS NULL AS BIGINT) AS missing_delta_ri,
       CASE WHEN ri_start IS NULL OR ri_end IS NULL THEN 0.0 ELSE ri_start END AS ri_window_start
FROM v_bounds""",
    "v_vitals": """
SELECT w.episode_id, w.window_index,
       arg_max(o.value_num, o.effective_dt) FILTER (WHERE o.code = '8867-4') AS hr,
       arg_max(o.value_num, o.effective_dt) FILTER (WHERE o.code = '8480-6') AS sbp
FROM v_window w JOIN v_obs o ON o.episode_id = w.episode_id AND o.effective_dt >= w.start_dt AND o.effective_dt < w.end_dt
WHERE o.value_num IS NOT NULL AND lower(o.code_system) LIKE '%loinc%' GROUP BY ALL""",
    "v_counts": """
SELECT w.episode_id, w.window_index, count(*) AS proc_count,
       count(*) FILTER (WHERE regexp_matches(p.performer_role, '(nurs|rn|enfermer|tcae|aux)', 'i')) AS nurse_proc_count,
       count(*) FILTER (WHERE p.is_nursing) AS nurse_proc_count_det
FROM v_window w JOIN v_proc p ON p.episode_id = w.episode_id AND p.performed_dt >= w.start_dt AND p.performed_dt < w.end_dt
GROUP BY ALL""",
    "v_raw": f"""
SELECT event_id, user_id AS episode_id, ts, {kind_sql()} AS kind, {payload_sql("strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')")} AS payload FROM events""",
    "v_bundle": """
SELECT CAST(user_id AS STRING) || '/' || strftime(ts, '%Y-%m-%d') AS bundle_id, event_id, user_id, event_id % 8 AS m8, event_id % 17 = 0 AS broken,
  row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS position, payload
FROM (SELECT event_id, episode_id AS user_id, ts, payload FROM v_raw WHERE payload <> '{broken')""",
    "v_term": """
SELECT DISTINCT d.domain, 'N' || CAST(p_partkey % 6 AS STRING) AS source_code, 'T' || CAST(p_partkey % 6 AS STRING) AS target_code
FROM part, (SELECT unnest(['nanda_to_snomed', 'nic_to_snomed', 'noc_to_loinc']) AS domain) d WHERE p_partkey % 10 <> 9""",
    "v_pick": """
SELECT r.*, CASE WHEN event_id % 6 IN (1, 2) AND t.target_code IS NOT NULL THEN 'mapped'
                 WHEN event_id % 17 = 0 AND event_id % 8 = 5 THEN 'none'
                 WHEN event_id % 6 = 1 THEN 'nursing' WHEN event_id % 6 IN (0, 4) THEN 'preferred' WHEN event_id % 6 = 3 THEN 'none' ELSE 'local' END AS choice,
  t.target_code, 'N' || CAST(event_id % 9 AS STRING) AS ncode
FROM v_raw r LEFT JOIN v_term t ON NOT (r.event_id % 17 = 0 AND r.event_id % 8 = 5) AND t.source_code = 'N' || CAST(r.event_id % 9 AS STRING)
  AND t.domain = CASE r.kind WHEN 'Observation' THEN 'noc_to_loinc' WHEN 'Condition' THEN 'nanda_to_snomed' ELSE 'nic_to_snomed' END
WHERE payload <> '{broken'""",
    "v_code": """
SELECT *, CASE choice WHEN 'none' THEN 'unknown' WHEN 'mapped' THEN CASE kind WHEN 'Observation' THEN 'http://loinc.org' ELSE 'http://snomed.info/sct' END
   WHEN 'nursing' THEN 'unmapped' WHEN 'local' THEN 'http://local' ELSE CASE kind WHEN 'Observation' THEN 'http://loinc.org' ELSE 'http://snomed.info/sct' END END AS code_system,
  CASE choice WHEN 'none' THEN 'unknown' WHEN 'mapped' THEN target_code WHEN 'nursing' THEN ' ' || ncode || ' ' WHEN 'local' THEN 'X' || CAST(event_id % 9 AS STRING)
   ELSE CASE kind WHEN 'Observation' THEN '85556-9' ELSE 'S' || CAST(event_id % 9 AS STRING) END END AS code,
  CASE choice WHEN 'none' THEN '' WHEN 'mapped' THEN ' ' || ncode || ' ' WHEN 'nursing' THEN ' ' || ncode || ' ' WHEN 'local' THEN 'X' || CAST(event_id % 9 AS STRING)
   ELSE CASE kind WHEN 'Observation' THEN '85556-9' ELSE 'S' || CAST(event_id % 9 AS STRING) END END AS source_code,
  CASE WHEN event_id % 19 <> 0 THEN ts END AS dt
FROM v_pick""",
    "v_cohort": """
SELECT l_orderkey * 10 + l_linenumber AS row_id, l_orderkey AS episode_id, l_suppkey AS unit_id, l_quantity AS nurse_hppd,
       l_discount AS nurse_skillmix, l_tax AS ri_initial, l_extendedprice / 1000.0 AS delta_ri, l_returnflag AS flag
FROM lineitem""",
    "v_feat": """
SELECT l_orderkey * 10 + l_linenumber AS row_id, l_orderkey AS episode_id, l_suppkey AS unit_id, l_shipdate AS start_dt, l_shipdate + INTERVAL 12 HOUR AS end_dt,
  l_quantity AS nurse_hppd, l_discount AS nurse_skillmix, l_tax AS ri_initial, CAST(l_linenumber % 4 AS DOUBLE) AS nurse_proc_count, CAST(l_linenumber % 3 AS DOUBLE) AS nurse_proc_count_det,
  CASE WHEN l_orderkey % 50 <> 0 THEN l_extendedprice / 1000.0 END AS delta_ri, CAST((l_orderkey + l_linenumber) % 9 = 0 AS DOUBLE) AS missing_vs_hr_last,
  CASE WHEN l_orderkey % 3 <> 0 THEN CAST((l_orderkey + l_linenumber) % 9 = 0 AS DOUBLE) END AS missing_loinc_8867_4,
  CAST(l_orderkey % 8 = 0 AS DOUBLE) AS missing_loinc_85556_9_t0, CAST(l_orderkey % 10 = 0 AS DOUBLE) AS missing_loinc_85556_9_t1 FROM lineitem""",
    "v_comp": """
SELECT o_orderkey AS row_id, o_custkey AS episode_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice / 3e5 - 0.8 END AS benefit,
  CASE WHEN o_orderkey % 15 <> 1 THEN (o_orderkey % 7 - 3) / 2.0 END AS attribution, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 5 - 2) / 4.0 END AS causal,
  CASE WHEN o_orderkey % 20 <> 3 THEN (o_orderkey % 11 - 5) / 3.0 END AS quality, CASE WHEN o_orderkey % 25 <> 4 THEN (o_orderkey % 9 - 4) / 2.0 END AS uncertainty,
  CASE WHEN o_orderkey % 25 <> 4 THEN (o_orderkey % 100) / 100.0 END AS raw_uncertainty FROM orders""",
    "v_row": """
SELECT *, CASE WHEN blocked THEN NULL ELSE benefit + attribution + quality - uncertainty + coalesce(causal, 0) END AS raw_score,
  CASE WHEN blocked THEN 'insufficient_evidence' WHEN causal IS NULL THEN 'provisional' ELSE 'complete' END AS status,
  coalesce(raw_uncertainty, 0) >= 0.25 AND uncertainty IS NOT NULL AS low, coalesce(raw_uncertainty, 0) >= 0.6 AS high
FROM (SELECT *, benefit IS NULL OR attribution IS NULL OR quality IS NULL OR uncertainty IS NULL AS blocked FROM v_comp)""",
    "v_rowscore": """
SELECT *, CASE WHEN NOT blocked THEN 100.0 / (1 + exp(-least(greatest(raw_score, -20), 20))) END AS score,
  list_sort(list_filter([CASE WHEN attribution IS NULL THEN 'missing_required_component:attribution' END, CASE WHEN benefit IS NULL THEN 'missing_required_component:benefit' END,
    CASE WHEN quality IS NULL THEN 'missing_required_component:quality' END, CASE WHEN uncertainty IS NULL THEN 'missing_required_component:uncertainty' END,
    CASE WHEN status = 'provisional' THEN 'causal_unavailable_score_is_provisional' END, CASE WHEN high THEN 'high_uncertainty' END, CASE WHEN low THEN 'low_support' END], lambda x: x IS NOT NULL)) AS warnings,
  least(greatest((1 - coalesce(raw_uncertainty, 0)) * CASE WHEN status = 'provisional' THEN 0.85 ELSE 1 END * CASE WHEN blocked THEN 0.25 ELSE 1 END, 0.05), 1.0) AS confidence FROM v_row""",
    "v_ext": """
SELECT *, coalesce('x' || CAST(CASE WHEN k % 9 <> 0 THEN k END AS STRING), 'row:' || CAST(k AS STRING)) AS row_id,
  list_filter([CASE WHEN k % 13 = 0 THEN 'contract_version_mismatch' END, CASE WHEN k % 23 = 0 THEN 'governance_flags_missing' END,
    CASE WHEN k % 17 = 0 THEN 'grain_mismatch' END, CASE WHEN k % 19 = 0 THEN 'temporal_context_missing' END], lambda x: x IS NOT NULL) AS ctx,
  k % 6 = 1 AS gap, k % 7 = 0 OR k % 11 = 0 AS hard,
  list_filter([CASE WHEN k % 7 = 0 THEN 'proc_count' END, CASE WHEN k % 11 = 0 THEN 'ri_initial' END], lambda x: x IS NOT NULL) AS critical
FROM (SELECT *, o_orderkey AS k FROM orders)""",
    "v_issue": """
SELECT *, CASE WHEN len(ctx) > 0 THEN 'contract_mismatch' WHEN gap AND NOT hard THEN 'low_feature_coverage' WHEN gap THEN 'contract_mismatch' WHEN hard THEN 'insufficient_evidence' END AS status,
  CASE WHEN len(ctx) > 0 THEN ctx WHEN gap AND NOT hard THEN ['low_feature_coverage'] WHEN gap THEN ['model_feature_space_mismatch'] WHEN hard THEN ['missing_critical_features'] END AS warnings
FROM v_ext""",
    "v_scored": """
SELECT o_orderkey AS row_id, CAST(o_orderkey AS VARCHAR) AS episode_id, 'w' || CAST(o_orderkey % 500 AS VARCHAR) AS window_id,
       'p' || CAST(o_custkey AS VARCHAR) AS patient_key, c_nationkey AS unit_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS start_dt,
       CASE WHEN o_orderstatus <> 'P' THEN 100.0 / (1.0 + exp(-(o_totalprice - 2e5) / 1e5)) END AS score,
       CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'provisional' ELSE 'insufficient_evidence' END AS status,
       CAST(o_custkey % 3 AS DOUBLE) AS severity_weight, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 1.0 END AS exposure_share,
       CASE WHEN o_orderkey % 10 <> 0 THEN 'nurse-' || CAST(o_custkey % 7 AS VARCHAR) END AS staff,
       o_totalprice / 1e5 AS c_benefit, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 9 AS DOUBLE) END AS c_quality,
       list_filter([CASE WHEN o_orderstatus = 'O' THEN 'causal_unavailable_score_is_provisional' END,
                    CASE WHEN o_orderkey % 6 = 0 THEN 'low_support' END], lambda x: x IS NOT NULL) AS warnings
FROM orders JOIN customer ON o_custkey = c_custkey""",
}
