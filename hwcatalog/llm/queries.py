"""The queries opN_<name> and pipeline, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_lines

    out = drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs, drop_text=True).select(F.col("doc_id").cast("long").alias("doc_id"), *names)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op6_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_edits

    return compare_with_edits(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import document_token_counts

    return document_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Fixed by the contract: (action, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "action string, host string, path string"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op11_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .log_replay import log_of, replay

    return replay(log_of(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import trie

    return trie(_table(spark, sf_dir, "conversations"))


def op13_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_table

    return shard_table(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_line_dedup, op3_quality_rules, op4_byte_bpe, op5_warc, op6_syncmer_fingerprints, op7_token_counts, op8_source_mixing, op9_url_filter, op10_html_text, op11_log_replay, op12_conversation_trie, op13_feistel_shards, pipeline)}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Exact links over all shingles, and their closure.
OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [concat('short ', array_to_string(w, ' '))] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS doc_id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

#: Counts, rule failures, and the beta posterior by host.
OP3 = f"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3), g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM t),
r AS (SELECT doc_id, count(DISTINCT i + k) AS rep FROM g, (SELECT unnest([0, 1, 2]) AS k) AS o WHERE n > 1 GROUP BY doc_id),
d AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) AS u WHERE translate(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '') <> '' GROUP BY doc_id),
b AS (SELECT w.doc_id, source, len(w) AS n_words, length(translate(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b), h AS (SELECT *, base_failed OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 60 * n_lines AS failed FROM f),
s AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS x FROM h GROUP BY source), m AS (SELECT coalesce(avg(x / n) FILTER (n > 1), sum(x) / sum(n), 0) AS m, coalesce(var_pop(x / n) FILTER (n > 1), 0) AS v FROM s),
z AS (SELECT source, (x + m * k) / (n + k) AS rate FROM s, (SELECT m, CASE WHEN v > 0 THEN least(1000, greatest(1, m * (1 - m) / v - 1)) ELSE 1000 END AS k FROM m) AS q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.8 AS kept FROM h LEFT JOIN z ON h.source IS NOT DISTINCT FROM z.source"""

OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> head THEN head END AS refers_to FROM p"""

#: The rules; the test tables' pages have no canonical links or refreshes, so no url has an alias there.
OP9 = """WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(a, h, p)),
m AS (SELECT page_id, max_by(concat(h, p), length(concat(h, p))) AS rule, max_by(a, length(concat(h, p))) AS verdict FROM u JOIN r ON (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id"""


def oracle_sql() -> dict[str, str]:
    from .oracles import OP11, OP12, OP13

    return {"op1_minhash_near_dedup": OP1, "op3_quality_rules": OP3, "op5_warc": OP5, "op9_url_filter": OP9, "op11_log_replay": OP11, "op12_conversation_trie": OP12, "op13_feistel_shards": OP13}
