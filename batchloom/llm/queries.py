"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm import decontaminate, language_id, license_scan, line_dedup, media_ts, mixing, near_dedup, suffix_dedup, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Windows as hex, as texts may hold any bytes; stretches of removed bytes are runs of window starts at most 50 apart.
OP1_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d)
), f AS (
  SELECT doc_id, p FROM w JOIN (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)) USING (s) WHERE first < doc_id
), g AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM f
), r AS (
  SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p - q > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g
), spans AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, run
), gaps AS (
  SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS last FROM spans
), k AS (
  SELECT doc_id, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY run) AS head, max(b) AS tail, sum(b - a) AS gone, count(*) AS n_spans
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, _table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, then the smallest document that each one reaches.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[j : j + 4], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS j FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT u, v FROM pairs JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)
), e AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(doc_id, c) AS (
  SELECT DISTINCT u, u FROM e UNION SELECT e.v, reach.c FROM reach JOIN e ON e.u = reach.doc_id
), component AS (
  SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN component USING (doc_id)
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it contains."""
    return decontaminate.contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines, and the SHA-256 of what is left."""
    out = line_dedup.remove_spread_lines(spark, _table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH l AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS t
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), spread AS (
  SELECT t FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}
), per AS (
  SELECT doc_id, count(*) FILTER (t <> '') AS n, count(*) FILTER (t <> '' AND t IN (SELECT t FROM spread)) AS gone,
    string_agg(line, chr(10) ORDER BY pos) FILTER (t NOT IN (SELECT t FROM spread)) AS rest
  FROM l GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_lines, CAST(gone AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone > 0 THEN coalesce(rest, '') ELSE text END) AS kept_sha256
FROM documents d JOIN per USING (doc_id)
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, _table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(spark, _table(spark, sf_dir, "documents"))


def _template_rows() -> str:
    return ", ".join(f"('{t.license}', [{', '.join(repr(w) for w in t.words)}], {t.step}, {t.least})" for t in license_scan.TEMPLATES)


OP7_SQL = rf"""
WITH t0(license, tw, step, least) AS (VALUES {_template_rows()}),
t AS (
  SELECT license, array_to_string(tw, ' ') AS name, least, step, len(tw) + step - 1 AS l, least(5, len(tw)) AS k,
    list_distinct([array_to_string(tw[j : j + least(5, len(tw)) - 1], ' ') FOR j IN range(1, greatest(len(tw) - 4, 1) + 1)]) AS s FROM t0
), ts AS (
  SELECT license, name, least, step, l, k, len(s) AS ns, unnest(s) AS shingle FROM t
), d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS pos FROM d, (SELECT DISTINCT k FROM t)
), hits AS (
  SELECT doc_id, license, name, least, step, l, k, ns, pos, shingle
  FROM (SELECT doc_id, k, pos, array_to_string(w[pos : pos + k - 1], ' ') AS shingle FROM p) JOIN ts USING (k, shingle)
), starts AS (
  SELECT DISTINCT doc_id, license, name, i * step + 1 AS i
  FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((pos + k - 1 - l) / step) AS BIGINT)), (pos - 1) // step + 1)) AS i FROM hits)
), z AS (
  SELECT doc_id, license, i, max(least) AS least, count(DISTINCT shingle) / max(ns) AS c
  FROM starts JOIN hits USING (doc_id, license, name) WHERE pos >= i AND pos + k - 1 <= i + l - 1 GROUP BY doc_id, license, name, i
)
SELECT doc_id, license, max(c) AS containment, CAST(count(DISTINCT i) AS BIGINT) AS n_windows, CAST(min(i) AS BIGINT) AS first_word
FROM z WHERE c >= least GROUP BY doc_id, license
"""


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its record as read back, and its place in the merged index."""
    out = warc.archive_pages(spark, _table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "rank")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner,
    lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query
  FROM pages
), k AS (
  SELECT *, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id & 268435455), '%Y%m%d%H%M%S') AS ts,
    CASE WHEN coalesce(url, '') = '' THEN '-' ELSE lower(array_to_string(list_reverse(string_split(regexp_replace(host, '^www\.', ''), '.')), ',') || ')'
      || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END) END AS url_key
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND owner <> page_id THEN owner END AS refers_to, url_key, ts,
  row_number() OVER (ORDER BY url_key, ts, page_id NULLS FIRST) AS rank
FROM k
"""


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.media_columns(spark, _table(spark, sf_dir, "documents"))


def document_quality(labels: DataFrame) -> DataFrame:
    """Sampling weight per labelled document: 0.5 for quality 0 up to 2 for quality 1."""
    return labels.groupBy("doc_id").agg((F.avg("quality") * 1.5 + 0.5).alias("quality"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents"), document_quality(_table(spark, sf_dir, "labels")))


OP10_SQL = r"""
WITH q AS (SELECT doc_id, avg(quality) * 1.5 + 0.5 AS q FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    -ln((('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / CASE WHEN q > 0 THEN q ELSE 1 END AS key
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS n, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source
), level AS (
  SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM s
), t AS (SELECT source, n, least(2 * n, max(l) OVER () * w) AS target FROM level),
p AS (
  SELECT doc_id, size, n, target, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS reached
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
  CAST(epochs * size + greatest(0, least(size, floor(target - epochs * n) - reached)) AS BIGINT) AS taken
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_near_dedup": op3_near_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_line_dedup": op5_line_dedup,
        "op6_language_id": op6_language_id,
        "op7_license_scan": op7_license_scan,
        "op8_warc_archive": op8_warc_archive,
        "op9_media_columns": op9_media_columns,
        "op10_source_mix": op10_source_mix,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op3_near_dedup": OP3_SQL, "op5_line_dedup": OP5_SQL, "op7_license_scan": OP7_SQL, "op8_warc_archive": OP8_SQL, "op10_source_mix": OP10_SQL}
