"""The registered queries of the operators, one each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import (
    alignment,
    conversation_repair,
    decontaminate,
    exact_dedup,
    html_text,
    line_templates,
    mixing,
    near_dedup,
    passages,
    prefix_bpe,
    secrets,
    token_counts,
    toxicity,
)
from scoreloom.queries.frame import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


@_query()
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf, "documents").select("doc_id", "text"))


@_query()
def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_report(secrets.find_secrets(table(spark, sf, "documents")))


@_query(
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
      doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    WINDOW g AS (PARTITION BY text_sha256)
    """
)
def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@_query(
    """
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, i, [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END
                              FOR t IN regexp_extract_all(ls[i], '[^ \\t\\r]+')] AS toks
          FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
    lines AS (SELECT *, len(toks) || ' ' || array_to_string(toks[1:3], ' ') AS leaf FROM l WHERE len(toks) > 0),
    crowded AS (SELECT leaf FROM lines GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
    cells AS (SELECT leaf, toks, unnest(range(1, len(toks) + 1)) AS p FROM lines SEMI JOIN crowded USING (leaf)),
    votes AS (SELECT leaf, p, toks[p] AS tok, count(*) AS n FROM cells GROUP BY ALL),
    shapes AS (SELECT c.leaf, c.toks, list(CASE WHEN c.toks[c.p] <> '<*>' AND v.n >= 10 THEN c.toks[c.p] ELSE '<*>' END ORDER BY c.p) AS tpl
               FROM (SELECT DISTINCT leaf, toks, p FROM cells) c JOIN votes v ON v.leaf = c.leaf AND v.p = c.p AND v.tok = c.toks[c.p]
               GROUP BY c.leaf, c.toks),
    fits AS (SELECT doc_id, i, leaf, tpl FROM lines JOIN shapes USING (leaf, toks)
             WHERE len([t FOR t IN tpl IF t <> '<*>']) >= 0.5 * len(tpl)),
    gone AS (SELECT doc_id, list(i) AS xs FROM fits JOIN (SELECT leaf, tpl FROM fits GROUP BY leaf, tpl HAVING count(DISTINCT doc_id) >= 10)
               USING (leaf, tpl) GROUP BY doc_id),
    kept AS (SELECT doc_id, coalesce(len(ls), 0) AS n, coalesce(len(xs), 0) AS g,
               CASE WHEN xs IS NULL THEN coalesce(text, '')
                    ELSE array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(xs, i)], chr(10)) END AS t
             FROM d LEFT JOIN gone USING (doc_id))
    SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(g AS BIGINT) AS n_dropped, CAST(length(t) AS BIGINT) AS n_chars,
      sha256(t) AS clean_sha256
    FROM kept
    """
)
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = line_templates.drop_template_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "n_lines", "n_dropped", F.length("clean_text").cast("long").alias("n_chars"),
        F.sha2("clean_text", 256).alias("clean_sha256"),
    )


@_query()
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


_WORDS = """[x FOR x IN regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF x <> '']"""


@_query(
    f"""
    WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    bw AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
           FROM b WHERE len(w) > 0),
    wins AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM bw),
    d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    ks AS (SELECT DISTINCT k FROM wins),
    dw AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
    hits AS (SELECT doc_id, item, i, dw.k AS k FROM dw JOIN wins
             ON dw.k = wins.k AND array_to_string(dw.w[i:i + dw.k - 1], ' ') = win),
    covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
    """
)
def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return decontaminate.contamination(found)


@_query(
    """
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    links AS (
      SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
                        GROUP BY u, v)
      JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS id, doc_id AS other FROM d UNION SELECT reach.id, links.v FROM reach JOIN links ON links.u = reach.other),
    comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM d JOIN comp ON comp.id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
    """
)
def op7_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, width=2).drop("text_hash")


@_query(
    """
    WITH RECURSIVE d AS (
      SELECT doc_id, source, md5(doc_id || ':0') AS place,
        CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS n FROM documents),
    src AS (SELECT source, CAST(sum(n) AS BIGINT) AS t, sum(n) / CAST(sum(sum(n)) OVER () AS DOUBLE) AS p FROM d GROUP BY source),
    bisect AS (
      SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
      UNION ALL
      SELECT step + 1, CASE WHEN over THEN (lo + hi) / 2 ELSE lo END, CASE WHEN over THEN hi ELSE (lo + hi) / 2 END
      FROM (SELECT step, lo, hi, max(pow(p, (lo + hi) / 2 - 1)) / min(pow(p, (lo + hi) / 2 - 1)) > 4 AS over
            FROM bisect, src WHERE p > 0 AND step < 40 GROUP BY step, lo, hi)),
    ex AS (SELECT round(CASE WHEN (SELECT max(1 / p) / min(1 / p) > 4 FROM src WHERE p > 0) THEN hi ELSE 0 END, 6) AS a
           FROM bisect WHERE step = 40),
    z AS (SELECT a, sum(pow(p, a)) AS z, min(pow(p, a - 1)) / sum(pow(p, a)) AS least FROM src, ex WHERE p > 0 GROUP BY a),
    plan AS (SELECT source, t, pow(p, a) / z AS w, CAST(floor(pow(p, a) / z * ((SELECT sum(t) FROM src) / least) + 0.5) AS BIGINT) AS own
             FROM src, z),
    sums AS (SELECT d.*, w, own // t AS passes, own - own // t * t AS rest,
               sum(n) OVER (PARTITION BY d.source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto
             FROM d JOIN plan ON d.source = plan.source),
    reads AS (SELECT *, unnest(range(1, passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END + 1)) AS epoch FROM sums)
    SELECT doc_id, source, n AS n_tokens, round(w, 9) AS source_weight, epoch,
      md5(place[1:3] || ':' || epoch)[1:8] || ':' || md5(place || ':' || epoch) AS read_order
    FROM reads
    """
)
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, mixing.Target(repetitions=4.0)).drop("text")


@_query()
def op9_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return html_text.extract_main_text(pages).select("page_id", "url", "text", "n_chars")


@_query()
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@_query()
def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = alignment.align_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    )
    return alignment.digest(aligned, "doc_id")


@_query()
def op12_prefix_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return prefix_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@_query()
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_repair.repair_report(table(spark, sf, "conversations"))
