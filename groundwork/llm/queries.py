"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread
from . import alignment, ann, bpe, conversations, decontaminate, dedup, html, jaccard, langid, pack, pii, shard, substr
from .queries_sql import OP11_SQL, OP12_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), keep_ids=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_iban", "top_score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(_table(spark, sf_dir, "documents"), shards=40)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(_table(spark, sf_dir, "documents"), pack.default_ranks())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.substring_dedup(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), _vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_language_id": op3_language_id,
        "op4_pii": op4_pii,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_sharding": op7_sharding,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_decontamination": op12_decontamination,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"

OP5_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS k FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, y AS reach FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach),
m AS (SELECT doc_id, min(reach) AS reach FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.reach, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP10_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM h JOIN m USING (k) WHERE doc_id > first),
x AS (SELECT doc_id, generate_subscripts(ws, 1) AS j, unnest(ws) AS word FROM w),
y AS (SELECT x.doc_id, count(*) AS n_words, count(c.doc_id) AS n_removed, string_agg(word, ' ' ORDER BY x.j) FILTER (c.doc_id IS NULL) AS kept
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j GROUP BY x.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN y USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op10_substring_dedup": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_decontamination": OP12_SQL}
