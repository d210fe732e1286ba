"""Registered queries of this package and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopygrid.llm import (
    collocations, fim, langid, media, mixing, packing, pii, quality, secrets, simhash, tokenfiles, topk, vectors,
)
from canopygrid.llm.tables import table


def op1_media_columns(spark: SparkSession, sf: str) -> DataFrame:
    return media.digests(table(spark, sf, "documents"))


def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.report(table(spark, sf, "documents"))


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.rates(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op6_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.report(table(spark, sf, "documents"))


def op7_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.every_fiftieth(table(spark, sf, "embeddings"))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokenfiles.read_tokens(spark, tokenfiles.write_tokens(table(spark, sf, "documents")))


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents"))


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


def op12_vector_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return fim.digests(table(spark, sf, "documents"))


QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_top_k": op7_top_k,
    "op8_quality": op8_quality,
    "op9_token_files": op9_token_files,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_vector_neighbours": op12_vector_neighbours,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op7_top_k": """
WITH v AS (
    SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT
        q.place,
        q.vec_id AS query_id,
        c.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
""",
    "op11_collocations": r"""
WITH p AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws
    FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
        FROM documents
    )
),
g AS (
    SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
    FROM (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4), (5)) AS s(k))
),
t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
cuts AS (
    SELECT c.lang, c.phrase, c.a, t.n, j, l.f AS l, r.f AS r,
        CAST((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : j], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j + 1 : c.k], ' ')
    JOIN t ON t.lang = c.lang
),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
    SELECT lang, phrase, max(a) AS a
    FROM (
        SELECT lang, a, array_to_string(ws[i : i + m - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))
    ) GROUP BY ALL
),
best AS (
    SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, low.a DESC, low.phrase) AS rank
    FROM low LEFT JOIN inside i ON i.lang = low.lang AND i.phrase = low.phrase
    WHERE i.a IS NULL OR 100 * i.a < 100 * low.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM best WHERE rank <= 2000
""",
    "op12_vector_neighbours": """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS size
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9
),
reach AS (
    SELECT a AS node, b AS other FROM links
    UNION
    SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT node AS vec_id, least(min(other), node) AS component_id FROM reach GROUP BY node)
SELECT
    vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
    coalesce(component_id, vec_id) = vec_id AS kept
FROM (SELECT vec_id FROM embeddings) LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
""",
    "op13_fill_in_middle": """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS s
    FROM documents
),
h AS (
    SELECT doc_id, t, n,
        CAST('0x' || s[1:8] AS BIGINT) % (n + 1) AS p1, CAST('0x' || s[9:16] AS BIGINT) % (n + 1) AS p2,
        CASE
            WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || s[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
            WHEN CAST('0x' || s[25:32] AS BIGINT) % 100 < 20 THEN 'spm'
            ELSE 'psm'
        END AS form
    FROM d
),
q AS (
    SELECT *, least(p1, p2) AS lo, greatest(p1, p2) AS hi,
        substr(t, 1, least(p1, p2)) AS p, substr(t, least(p1, p2) + 1, abs(p1 - p2)) AS m, substr(t, greatest(p1, p2) + 1) AS s
    FROM h
)
SELECT
    doc_id, n, form,
    CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
    sha256(CASE form
        WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
        ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM q
""",
}
