"""One registered query for each operator, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, filter_audit, html_text, jaccard_join, langid, packing, pii, quality, substring_dedup, token_files, toxicity, whitening

#: The tokenizer's file, a parameter of op2, op5 and op11; the operators take any path.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path(TOKENIZER))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_language_id": op7_language_id,
    "op8_html_extraction": op8_html_extraction,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_token_files": op11_token_files,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op4_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)""",
    "op9_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
        k AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ') || CASE WHEN n < 5 THEN '#' || n ELSE '' END) AS h FROM s),
        z AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM k x JOIN k y USING (h) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN z u ON u.doc_id = a JOIN z v ON v.doc_id = b WHERE 100 * inter >= 80 * (u.n + v.n - inter)),
        r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.a)
        SELECT r.a AS doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.c) AS component_id
        FROM r LEFT JOIN z ON z.doc_id = r.a GROUP BY r.a""",
    "op10_substring_dedup": """
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
        k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM s),
        f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (h) WHERE doc_id > first),
        g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
        o AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id))
        SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
            sha256(array_to_string(list_filter(w, lambda x, j: NOT list_contains(gone, j)), ' ')) AS kept_sha256
        FROM o""",
    "op12_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
        l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
            [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS f
            FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
        c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
        a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM a, a b, a c, a d, a e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, step, strpos('ABCDE', substr(filter_order, step, 1)) AS k FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
        r AS (SELECT part, filter_order, step, k, f, n, good, toxic, f[k] AS fails,
            coalesce(list_bool_or(list_transform(range(1, step), lambda i: f[strpos('ABCDE', substr(filter_order, i, 1))])), false) AS gone FROM c, s),
        z AS (SELECT part, filter_order, step, k,
            coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
            coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails AND len(list_filter(f, lambda x: x)) = 1), 0) AS unique_fails,
            coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
            FROM r GROUP BY ALL)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
            good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
        FROM z""",
}
