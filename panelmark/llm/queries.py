"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.llm import exact, langmodel, licenses, minhash, mixing, pieces, quality, simhash, substrings, urls
from panelmark.llm.common import in_fold, partitions, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, ranking).select("doc_id", in_fold(F.col("doc_id"), quality.FOLDS).alias("held_out"), "score", "predicted")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes its ids again."""
    own = pieces.encoded(table(spark, sf_dir, "documents"), decode=True)
    return own.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents"), partitions(spark))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.scored(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x.stop - x.start)
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = urls.labelled(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return urls.judged(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_mix_sources, op3_sentencepiece, op4_license_scan, op5_document_fingerprints, op6_lm_scoring, op7_simhash_near_dedup, op8_suffix_array_dedup, op9_exact_dedup, op10_url_filters)
}

ORACLES = {
    "op10_url_filters": """
        WITH numbered AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), own AS (
            SELECT doc_id, CASE WHEN avg(quality) < 0.5 THEN 1 ELSE 0 END AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
        ), p AS (
            SELECT page_id, host, path, bad,
                   list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR length(x) > 40 THEN '*' ELSE x END) AS segs
            FROM numbered LEFT JOIN own ON doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\\.[a-z]+)?/?$', 1), '') AS BIGINT)
        ), seen AS (
            SELECT host, segs, count(*) AS pages, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p GROUP BY host, segs
        ), places AS (
            SELECT host, segs, pages, unnest(range(len(segs))) AS place FROM seen
        ), nodes AS (
            SELECT *, segs[place + 1] AS seg, array_to_string(segs[1:place], '/') AS branch FROM places
        ), counted AS (
            SELECT host, place, branch, seg, sum(pages) AS pages FROM nodes GROUP BY ALL
        ), varied AS (
            SELECT host, place, branch, true AS varies FROM counted GROUP BY host, place, branch HAVING count(*) >= 20 AND count(*) >= 0.5 * sum(pages)
        ), general AS (
            SELECT host, segs, list(CASE WHEN varies THEN '*' ELSE seg END ORDER BY place) AS general FROM nodes LEFT JOIN varied USING (host, place, branch) GROUP BY host, segs
        ), leaves AS (
            SELECT host, segs, n, bad, coalesce(general, []) AS general FROM seen LEFT JOIN general USING (host, segs)
        ), leaf AS (
            SELECT host, general, sum(n) AS n, sum(bad) AS bad, array_to_string(general[2:], '/') AS rest, len(general) AS depth FROM leaves GROUP BY host, general
        ), pooled AS (
            SELECT *, bad / greatest(n, 1) AS share, sum(bad) OVER s / greatest(sum(n) OVER s, 1) AS pooled FROM leaf WINDOW s AS (PARTITION BY host, depth, rest)
        ), named AS (
            SELECT host, general, n, bad, '/' || CASE WHEN depth > 0 AND (n = 0 OR abs(share - pooled) < 2.0 * sqrt(greatest(pooled * (1 - pooled), 1e-4) / greatest(n, 1)))
                THEN '*' || CASE WHEN rest = '' THEN '' ELSE '/' || rest END ELSE array_to_string(general, '/') END AS template FROM pooled
        ), whole AS (
            SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 10.0) AS whole FROM named
        ), hosts AS (
            SELECT host, (sum(bad) + 10.0 * any_value(whole)) / (sum(n) + 10.0) AS prior FROM named CROSS JOIN whole GROUP BY host
        ), scored AS (
            SELECT host, template, (sum(bad) + 10.0 * any_value(prior)) / (sum(n) + 10.0) AS share FROM named JOIN hosts USING (host) GROUP BY host, template
        ), judged AS (
            SELECT host, segs, share FROM leaves JOIN named USING (host, general) JOIN scored USING (host, template)
        ), ruled AS (
            SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
        )
        SELECT page_id, ruled.host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN 1 - share <= 0.5 THEN 'block' ELSE 'allow' END END AS verdict
        FROM ruled LEFT JOIN judged USING (host, segs)
    """,
    "op9_exact_dedup": """
        WITH norm AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
            FROM documents
        ), ranked AS (
            SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                   first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
            FROM norm WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST)
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
    """,
}
