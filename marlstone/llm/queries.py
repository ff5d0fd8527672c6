"""The driver's queries over these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import secrets
from .decontaminate import contaminated_words, contamination
from .exact_dedup import exact_groups
from .kneser_ney import quality
from .language_id import train_and_predict
from .license_scan import license_labels, scan_licenses
from .near_dedup import near_duplicates
from .packing import packed
from .sharding import interleaved_shards
from .warc import archived_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_strings(spark))
    return secrets.secret_counts(secrets.find_secrets(table(spark, sf_dir, "documents"), model))


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op4_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_predict(table(spark, sf_dir, "documents"))


def op5_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(table(spark, sf_dir, "documents"))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality(table(spark, sf_dir, "documents"), trusted)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(scan_licenses(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_words(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_mixture_packing, op3_warc_revisits, op4_language_codes, op5_interleaved_shards, op6_kneser_ney_quality, op7_license_scan, op8_decontamination, op9_near_dedup, op10_exact_dedup)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(sha1(h), {5 * k + 1}, 5) AS INTEGER) >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0)
)

ORACLE_SQL = {
    "op3_warc_revisits": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        m AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS best FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < best THEN best END AS refers_to
        FROM m
    """,
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS key
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ),
        sizes AS (SELECT DISTINCT n FROM win),
        seen AS (
            SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes)
        ),
        hits AS (SELECT s.doc_id, s.i, s.n, win.item_id FROM seen s JOIN win ON s.n = win.n AND s.key = win.key),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        ),
        wt AS (SELECT key, n, unnest(range(0, n)) AS o, unnest(string_split(key, ' ')) AS t FROM (SELECT DISTINCT key, n FROM win)),
        dt AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM d),
        few AS (
            SELECT doc_id, key, n FROM (SELECT DISTINCT doc_id, t FROM dt) JOIN (SELECT DISTINCT key, n, t FROM wt) USING (t)
            GROUP BY doc_id, key, n HAVING count(*) = len(list_distinct(string_split(key, ' ')))
        ),
        laid AS (
            SELECT few.doc_id, few.key, few.n, p - o + delta AS s FROM few JOIN wt USING (key) JOIN dt ON dt.doc_id = few.doc_id AND dt.t = wt.t
            CROSS JOIN (SELECT unnest(range(-2, 3)) AS delta) GROUP BY ALL HAVING count(DISTINCT o) = few.n
        ),
        near AS (
            SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_near FROM (SELECT DISTINCT doc_id, key FROM laid) JOIN win USING (key)
            ANTI JOIN (SELECT DISTINCT doc_id, item_id FROM hits) USING (doc_id, item_id) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
               coalesce(n_near, 0) AS n_near_items
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
    """,
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t
    """,
}
