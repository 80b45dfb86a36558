"""The registered queries of this subpackage: thin digests over its operators, each on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, langid, license_scan, lm_scoring, mixing, near_dup, quality, suffix_dedup, topk
from ._spark import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.stupid_backoff(table(spark, sf_dir, "documents"), order=3)
    return out.select("doc_id", "n_tokens", "n_backoff", F.round("log_score", 3).alias("log_score"), F.round("score", 6).alias("score"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings")).withColumn("rank", F.col("rank").cast("int"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    held = F.coalesce(held, F.lit(False))
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~held))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), with_text=False)
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("q_doc", "q_path", "q_score", "t_doc", "t_path", "t_score")), "keep")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_license_scan, op3_decontaminate, op4_topk, op5_language_id, op6_html_extract, op7_suffix_dedup, op8_mix_sources, op9_quality, op10_near_dup)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Whole results of the operators that SQL can express, over the same whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_lm_scoring": rf"""WITH t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t), p AS (SELECT *, lag(w) OVER v AS b, lag(w, 2) OVER v AS a FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
        u AS (SELECT w, count(*) AS c FROM x GROUP BY 1), g AS (SELECT b, w, count(*) AS c FROM p WHERE b IS NOT NULL GROUP BY 1, 2), h AS (SELECT a, b, w, count(*) AS c FROM p WHERE a IS NOT NULL GROUP BY 1, 2, 3), n AS (SELECT count(*) AS n FROM x),
        s AS (SELECT doc_id, CASE WHEN h.c >= 2 THEN ln(h.c) - ln(gb.c) WHEN g.c >= 2 THEN (p.a IS NOT NULL)::INTEGER * ln(0.4) + ln(g.c) - ln(ub.c) ELSE ((p.a IS NOT NULL)::INTEGER + (p.b IS NOT NULL)::INTEGER) * ln(0.4) + ln(u.c) - ln(n) END AS l,
            CASE WHEN p.a IS NOT NULL THEN h.c < 2 WHEN p.b IS NOT NULL THEN g.c < 2 ELSE false END::BIGINT AS k
            FROM p CROSS JOIN n JOIN u ON u.w = p.w LEFT JOIN g ON g.b = p.b AND g.w = p.w LEFT JOIN u ub ON ub.w = p.b LEFT JOIN h ON h.a = p.a AND h.b = p.b AND h.w = p.w LEFT JOIN g gb ON gb.b = p.a AND gb.w = p.b)
        SELECT t.doc_id, count(s.l)::BIGINT AS n_tokens, coalesce(sum(k), 0)::BIGINT AS n_backoff, round(coalesce(sum(l), 0.0), 3) AS log_score, round(sum(l) / nullif(count(l), 0), 6) AS score FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY 1""",
    "op4_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        r AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r) WHERE rank <= 5""",
    "op3_decontaminate": r"""WITH b AS (SELECT DISTINCT text AS item, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS iw FROM benchmark WHERE text IS NOT NULL), i AS (SELECT item, iw, len(iw) AS m, least(len(iw), 5) AS q FROM b WHERE len(iw) > 0),
        ig AS (SELECT item, m, q, k AS idx, array_to_string(iw[k + 1 : k + q], ' ') AS gram FROM i, LATERAL unnest(generate_series(0, m - q)) t(k)), ic AS (SELECT item, gram, count(*) AS c FROM ig GROUP BY 1, 2), im AS (SELECT item, sum(c) AS total FROM ic GROUP BY 1),
        d AS (SELECT DISTINCT text AS doc, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS dw FROM documents WHERE text IS NOT NULL), dq AS (SELECT doc, dw, len(dw) AS n, q FROM d, (SELECT DISTINCT q FROM i) WHERE len(dw) >= q),
        dg AS (SELECT doc, n, q, k AS pos, array_to_string(dw[k + 1 : k + q], ' ') AS gram FROM dq, LATERAL unnest(generate_series(0, n - q)) t(k)),
        w AS (SELECT DISTINCT dg.doc, ig.item, ig.q, greatest(pos - idx, 0) AS start, least(pos - idx + m, n) AS stop FROM dg JOIN ig ON ig.gram = dg.gram AND ig.q = dg.q),
        c AS (SELECT w.doc, w.item, w.start, dg.gram, count(*) AS c FROM w JOIN dg ON dg.doc = w.doc AND dg.q = w.q AND dg.pos BETWEEN w.start AND w.stop - w.q GROUP BY ALL),
        s AS (SELECT c.doc, c.item, c.start, sum(c.c) AS total, sum(coalesce(least(c.c, ic.c), 0)) AS inter FROM c LEFT JOIN ic ON ic.item = c.item AND ic.gram = c.gram GROUP BY ALL),
        r AS (SELECT doc, s.item, start, inter::DOUBLE / (s.total + im.total - inter) AS similarity FROM s JOIN im ON im.item = s.item), x AS (SELECT *, row_number() OVER (PARTITION BY doc, item ORDER BY similarity DESC, start) AS k FROM r WHERE similarity >= 0.8)
        SELECT documents.doc_id, n.item_id, round(similarity, 6) AS similarity, start::BIGINT AS start FROM x JOIN documents ON documents.text = x.doc JOIN (SELECT DISTINCT item_id, text FROM benchmark) n ON n.text = x.item WHERE k = 1""",
    "op8_mix_sources": r"""WITH b AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS h FROM documents),
        k AS (SELECT *, length(bin(size)) * 512 + (size >> greatest(length(bin(size)) - 9, 0)::BIGINT) AS class FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, substr(h, 1, 3), size, doc_id NULLS FIRST, h) - 1 AS place FROM k),
        z AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY 1), o AS (SELECT *, source_size * 2.0::DOUBLE AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM z),
        l AS (SELECT *, cap / w AS ratio, row_number() OVER v AS nth, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o WINDOW v AS (ORDER BY cap / w, source NULLS LAST)),
        t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, nth) FROM l WHERE level <= ratio), 'inf'::DOUBLE) * w) AS target, ('0x' || substr(md5('17:' || coalesce(source, chr(1) || 'null')), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u FROM l),
        r AS (SELECT p.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, round(target, 3) AS target, (least(floor((place + 1) * rate + u) - floor(place * rate + u), 2) * size)::BIGINT AS taken FROM r""",
}
