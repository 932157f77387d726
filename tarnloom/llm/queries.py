"""The queries over these operators with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audio, common, fingerprints, htmltext, lm, mixing, neardups, packing, toxicity, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), keep_ids=False)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(_table(spark, sf_dir, "pages"), common.work_path(spark, "warc"))
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    doc_id = F.col("_row.doc_id")
    return scored.select(
        doc_id.alias("doc_id"),
        (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.col("flagged").cast("int").alias("flagged"),
    )


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.link(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.search(_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_packing, op2_html, op3_warc, op4_fingerprints, op5_toxicity, op6_lm_scores, op7_near_dups, op8_url_filters, op9_audio, op10_mixing)}

_BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {1 + 5 * k}, 5))::INT) >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0)
)

ORACLE_SQL = {
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT page_id, strlen(html) AS payload_bytes, {_BASE32_SQL} AS payload_digest,
                     max(page_id) OVER (PARTITION BY html) AS largest FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < largest THEN largest END AS refers_to FROM g""",
    "op8_url_filters": """
        WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        n AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
        r(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
            ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        m AS (SELECT n.*, rule_host || rule_path AS rule, verdict,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
              FROM n LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
    "op10_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                          md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size,
                     ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
        c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s),
        l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0) AS budget,
                     sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weights
              FROM c WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, least(cap, w * max(budget / weights) OVER ()) AS target FROM l),
        q AS (SELECT d.*, source_size, target, round(target)::BIGINT AS quota,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS whole FROM q)
        SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, quota - whole * source_size - before)))::BIGINT AS taken FROM e""",
    "op7_near_dups": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
        x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        c AS (SELECT a AS node, b AS reach FROM l UNION SELECT c.node, l.b FROM c JOIN l ON c.reach = l.a)
        SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(reach), s.doc_id)) AS component_id,
               s.doc_id <= coalesce(min(reach), s.doc_id) AS kept
        FROM s LEFT JOIN c ON c.node = s.doc_id GROUP BY s.doc_id, len(sh)""",
}
