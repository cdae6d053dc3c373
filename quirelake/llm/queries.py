"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .embed_dedup import embedding_dedup
from .ngram_join import ngram_join
from .packing import pack_documents
from .phrase_dedup import phrase_dedup
from .quality_fm import quality_scores
from .suffix_dedup import suffix_dedup
from .token_binary import token_binary
from .token_counts import edited_counts
from .warc import warc_records


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the machine keeps its public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, d: str) -> DataFrame:
    return quality_scores(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op2(spark: SparkSession, d: str) -> DataFrame:
    return phrase_dedup(_table(spark, d, "documents"))


def op3(spark: SparkSession, d: str) -> DataFrame:
    return token_binary(_table(spark, d, "documents"), tokenizer_path())


def op4(spark: SparkSession, d: str) -> DataFrame:
    return edited_counts(_table(spark, d, "documents"), tokenizer_path())


def op5(spark: SparkSession, d: str) -> DataFrame:
    return warc_records(_table(spark, d, "pages"))


def op6(spark: SparkSession, d: str) -> DataFrame:
    hits = decontaminate(_table(spark, d, "documents"), _table(spark, d, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup(_table(spark, d, "documents"))


def op8(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup(_table(spark, d, "embeddings"))


def op9(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(_table(spark, d, "documents"), tokenizer=tokenizer_path())


def op10(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join(_table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1,
    "op2_substring_dedup": op2,
    "op3_token_binary": op3,
    "op4_token_counts": op4,
    "op5_warc": op5,
    "op6_decontamination": op6,
    "op7_suffix_array_dedup": op7,
    "op8_embedding_dedup": op8,
    "op9_packing": op9,
    "op10_ngram_join": op10,
}

SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
        gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS g FROM late GROUP BY doc_id),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        gi AS (SELECT doc_id, unnest(g) AS i FROM gone),
        kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t, count(*) AS n FROM words ANTI JOIN gi ON words.doc_id = gi.doc_id AND words.i = gi.i GROUP BY words.doc_id)
        SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, (coalesce(len(w), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(t, '') AS text
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
    "op5_warc": r"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        bits AS (SELECT page_id, payload_bytes, h, list_aggregate(list_transform(string_split(h, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), 'string_agg', '') AS b FROM p),
        d AS (SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, 5 * i + 1, 1)::INTEGER + 8 * substr(b, 5 * i + 2, 1)::INTEGER + 4 * substr(b, 5 * i + 3, 1)::INTEGER + 2 * substr(b, 5 * i + 4, 1)::INTEGER + substr(b, 5 * i + 5, 1)::INTEGER, 1)), 'string_agg', '') AS payload_digest FROM bits)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = max(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type, nullif(max(page_id) OVER (PARTITION BY h), page_id) AS refers_to FROM d
    """,
    "op6_decontamination": r"""
        WITH lowered AS (SELECT 0 AS item, item_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark UNION ALL SELECT 1, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM documents),
        w AS (SELECT item, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lowered),
        iw AS (SELECT id AS item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT id, w, least(13, len(w)) AS m FROM w WHERE item = 0 AND len(w) > 0))),
        ms AS (SELECT DISTINCT m FROM iw),
        dw AS (SELECT id AS doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, ms WHERE item = 1 AND len(w) >= m)),
        hit AS (SELECT DISTINCT doc_id, i, m FROM dw WHERE (m, s) IN (SELECT m, s FROM iw)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM dw JOIN iw ON dw.m = iw.m AND dw.s = iw.s) GROUP BY doc_id)
        SELECT w.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM w LEFT JOIN pos ON w.id = pos.doc_id LEFT JOIN its ON w.id = its.doc_id WHERE item = 1
    """,
    "op7_suffix_array_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
        win AS (SELECT r, i, md5_number(substr(h, 2 * i - 1, 800)) AS w FROM (SELECT r, h, unnest(range(1, n - 398)) AS i FROM d WHERE n >= 400)),
        again AS (SELECT r, i FROM win WHERE w IN (SELECT w FROM win GROUP BY w HAVING count(*) > 1)),
        runs AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM again)) GROUP BY r, run),
        cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS s, row_number() OVER (PARTITION BY r ORDER BY a DESC) = 1 AS final FROM runs),
        part AS (SELECT cut.r, s, substr(h, 2 * s - 1, 2 * (a - s)) AS p FROM cut JOIN d ON cut.r = d.r UNION ALL SELECT cut.r, b, substr(h, 2 * b - 1) FROM cut JOIN d ON cut.r = d.r WHERE final),
        whole AS (SELECT r, string_agg(p, '' ORDER BY s) AS k, string_agg(decode(unhex(regexp_replace(regexp_replace(p, '^([89AB][0-9A-F])+', ''), '(C[0-9A-F]|D[0-9A-F]|E[0-9A-F]|E[0-9A-F][89AB][0-9A-F]|F[0-9A-F]([89AB][0-9A-F]){0,2})$', ''))), '' ORDER BY s) AS t FROM part GROUP BY r),
        size AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256, coalesce(t, decode(unhex(h))) AS text
        FROM d LEFT JOIN whole ON d.r = whole.r LEFT JOIN size ON d.r = size.r
    """,
    "op8_embedding_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
        reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
        root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT root.a AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, root.a = component_id AS kept FROM root LEFT JOIN n ON root.a = n.a
    """,
    "op10_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '' ORDER BY g)) AS s FROM g GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE k >= 0.8 * (p.n + q.n - k) - 1e-9),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
        root AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a), d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT root.a AS doc_id, coalesce(n.n, 0)::BIGINT AS n_grams, CASE WHEN n.s IS NULL THEN root.a ELSE min(root.a) OVER (PARTITION BY n.s) END AS copy_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, class_id = root.a AS kept
        FROM root LEFT JOIN n ON root.a = n.doc_id LEFT JOIN d ON root.a = d.a
    """,
}
