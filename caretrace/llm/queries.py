"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrace.llm.common import table
from caretrace.llm.exact import exact_duplicates
from caretrace.llm.licenses import scan_licences
from caretrace.llm.lines import fuzzy_lines
from caretrace.llm.minhash import near_duplicates
from caretrace.llm.mixing import mix_sources
from caretrace.llm.periods import periodic_runs
from caretrace.llm.phrases import collocations
from caretrace.llm.pieces import encode_documents
from caretrace.llm.quality import held_out, score_quality, train
from caretrace.llm.secrets import scan_secrets
from caretrace.llm.spans import repeated_spans
from caretrace.llm.substrings import repeated_bytes
from caretrace.llm.topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The tokenizer file's place on driver and executors.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return wrap


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("spans_text").alias("spans"), "n_confirmed")


@query(
    "op6_exact_dedup",
    """
    WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.array_max("ends").cast("long").alias("covered_bytes"),
    )


@query("op10_mix_sources")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(
    "op3_topk",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


@query("op5_minhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op2_licenses")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = [F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in ("source", "lang", "doc_id")]
    files = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", *part))
    found = scan_licences(files)
    return found.select("doc_id", "path", "licence", "found", F.round("cosine", 6).alias("cosine"), "start", "from_dir")


@query("op7_sentence_spans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of which something is removed."""
    return repeated_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.aggregate("sentence_runs", F.lit(0), lambda n, r: n + r["b"] - r["a"]).cast("long").alias("n_removed"),
        F.array_join(F.transform("sentence_runs", lambda r: F.concat_ws(":", r["a"].cast("string"), r["b"].cast("string"))), ",").alias("removed_sentences"),
        "first_ids",
    )


@query("op9_fuzzy_lines")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = fuzzy_lines(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"))


@query("op11_suffix_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = repeated_bytes(table(spark, sf_dir, "documents"), limit=100)
    return marks.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def looped(doc_id: object, n: int) -> np.ndarray | None:
    """Word numbers of a document of n words of which one in ten ends in a loop: from word a on, the p words there repeat."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=looped)
    longest = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    found = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("CAST(floor(1000 * -best.l / best.p) AS BIGINT)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op13_phrases",
    """
    WITH pieces AS (
        SELECT lang, rowno, unnest(list_transform(cut, lambda x, i: {'piece': i, 'body': x}), recursive := true) FROM (
            SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS rowno,
                string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS cut FROM documents)
    ), words AS (
        SELECT lang, rowno, piece, unnest(list_transform(w, lambda x, i: {'pos': i, 'word': x}), recursive := true)
        FROM (SELECT lang, rowno, piece, list_filter(string_split_regex(body, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces)
    ), grams AS (
        SELECT lang, word AS w1, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY rowno, piece ORDER BY pos)
    ), f AS (
        SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM grams GROUP BY ALL
        UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM grams WHERE w2 IS NOT NULL GROUP BY ALL
        UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM grams WHERE w3 IS NOT NULL GROUP BY ALL
    ), candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
    cuts AS (
        SELECT lang, phrase, f AS a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM candidates
        UNION ALL SELECT lang, phrase, f, 2, array_to_string(w[:2], ' '), w[3] FROM candidates WHERE size = 3
    ), scored AS (
        SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, k, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail
    ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (
        SELECT lang, part, max(f) AS f FROM (
            SELECT lang, array_to_string(w[:2], ' ') AS part, f FROM candidates WHERE size = 3
            UNION ALL SELECT lang, array_to_string(w[2:], ' '), f FROM candidates WHERE size = 3) GROUP BY ALL
    ), kept AS (
        SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.part = b.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * b.a
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM ranked JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) USING (lang) WHERE rank <= 2000
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), min_count=10, most=3, cover_percent=50, top=2000)
