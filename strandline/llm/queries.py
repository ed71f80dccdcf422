"""The opN queries: each operator on its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, lines, maxent, mixing, secrets, simhash, toxicity, urls, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


#: The contract's rules: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op5_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_line_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its lines, those that go, and digests of what stays."""
    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_before", "lines_removed", F.length("text").alias("chars_kept"), F.xxhash64("text").alias("text_hash"))


def op9_secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a candidate; the value itself only as a digest."""
    out = secrets.scan(_table(spark, sf_dir, "documents"), path="source")
    return out.select("doc_id", "start", F.length("value").alias("length"), "kind", secrets.digest(F.col("value")).alias("value_sha256"), "score", "secret")


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_maxent_scores, op2_source_mix, op3_vector_duplicates, op4_url_verdicts, op5_license_notices, op6_benchmark_leaks, op7_toxicity, op8_line_copies, op9_secret_findings, op10_simhash_groups)
}

_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

ORACLES: dict[str, str] = {
    "op3_vector_duplicates": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, l.w FROM r JOIN l ON r.t = l.u),
        c AS (SELECT s, min(t) AS component_id FROM r GROUP BY s),
        n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
        SELECT m.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, m.vec_id = c.component_id AS kept
        FROM embeddings m JOIN c ON c.s = m.vec_id LEFT JOIN n ON n.u = m.vec_id""",
    "op4_url_verdicts": f"""
        WITH rules(rh, rp, rv) AS (VALUES {_VALUES}),
        p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        q AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^?#]*') AS rest FROM p),
        s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM q),
        d AS (SELECT DISTINCT host, path FROM s),
        b AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
              FROM d JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
        SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM s LEFT JOIN b ON b.host = s.host AND b.path = s.path""",
}
